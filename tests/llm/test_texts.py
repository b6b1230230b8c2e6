"""Operators 3, 9 and 10 against brute force and held-out labels."""

import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rxflow.llm import personal as P
from rxflow.llm import quality as Q
from rxflow.llm import toxicity as T


def documents(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("kept", F.lit(1))


# ---- toxicity -------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    syllables = ["ka", "lo", "mi", "ten", "ra", "su", "vo", "pel"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randrange(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "grumf" + rng.choice(["", "er", "ish", word()]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark, corpus):
    docs, labels = corpus
    scored = T.score(docs, T.fit(docs, labels)).join(labels, "doc_id").withColumn("h", T.held_out(F.col("doc_id"))).collect()
    out = [r for r in scored if r["h"]]
    assert 200 < len(out) < 400 and all(0 <= r["score"] <= 1 for r in scored)
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.97 * len(out)


def test_many_mildly_toxic_words_are_found(spark):
    rng = random.Random(6)
    syllables = ["ka", "lo", "mi", "ten", "ra", "su", "vo", "pel"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randrange(40, 80))]
        kind = i % 8
        if kind == 0:  # a loud expression
            words[3:3] = ["grumfzwixelg"] * 2
        elif kind == 1:  # ordinary syllables in an order that ordinary words hardly have
            words[5:5] = ["tentenlo" + word() for _ in range(8)]
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind < 2)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = [r for r in T.score(docs, T.fit(docs, labels)).withColumn("h", T.held_out(F.col("doc_id"))).collect() if r["h"]]
    for kinds, least in (({0}, 0.97), ({1}, 0.8)):
        found = [r["predicted"] for r in out if r["doc_id"] % 8 in kinds]
        assert sum(found) >= least * len(found)
    clean = [r["predicted"] for r in out if r["doc_id"] % 8 > 1]
    assert sum(clean) <= 0.02 * len(clean)


def test_held_out_labels_are_never_used(spark, corpus):
    docs, labels = corpus
    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (T.score(docs, T.fit(docs, x)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert [r["score"] for r in a] == [r["score"] for r in b]


def test_odd_texts_are_scored(spark, corpus):
    docs, labels = corpus
    scorer = T.fit(docs, labels)
    odd = documents(spark, [None, "", "!!!", "grumf " * 5000, "ka lo", "ka lo"])
    got = T.score(odd, scorer).orderBy("doc_id").collect()
    assert [r["predicted"] for r in got] == [0, 0, 0, 1, 0, 0] and got[4]["score"] == got[5]["score"]
    assert T.score(odd.limit(0), scorer).count() == 0
    nobody = T.fit(docs, labels.limit(0))
    assert [r["score"] for r in T.score(odd, nobody).collect()] == [0.0] * 6
    nulls = labels.unionByName(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int"))
    assert T.fit(docs, nulls).model is not None


def test_probabilities_sum_to_one(spark):
    model = T.Model([{"abc": 3, "abd": 1, "bcd": 2}, {"abc": 1, "zzz": 2}])
    letters = sorted({c for w in ("abc", "abd", "bcd", "zzz") for c in w}) + ["\x03"]
    for context in ("", "a", "ab", "zz"):
        totals = []
        for c in (0, 1):
            total = 0.0
            for letter in letters:
                flat, at, _ = T._letters([context + letter.replace("\x03", "")])
                p = np.full(len(at), model.bottom)
                for n, (gram, ctx) in enumerate(T._grams(flat, at), 1):
                    level = model.shared[n - 1] if n <= T.SHARED else model.own[c][n - T.SHARED - 1]
                    p = level.up(gram, ctx, p)
                total += p[len(context)]
            totals.append(total)
        assert all(0.5 < x <= 1 + 1e-9 for x in totals)


def test_all_labelled_texts_make_the_models(spark, corpus):
    docs, labels = corpus
    known = docs.join(labels, "doc_id").where(~T.held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id")).collect()
    curve = {r["doc_id"] for c in (0, 1) for r in sorted((r for r in known if r["toxic"] == c and r["h"] % 4 == 0), key=lambda r: r["h"])[:5]}
    counts = [{}, {}]
    for r in known:
        if r["doc_id"] not in curve:
            for w in r["text"].lower().split():
                counts[r["toxic"]][w] = counts[r["toxic"]].get(w, 0) + 1
    got, want = T.fit(docs.unionByName(docs.limit(50)), labels, sample=5).model, T.Model(counts)  # a sample of 5 bounds the curve alone
    for a, b in zip([*got.shared, *got.own[0], *got.own[1]], [*want.shared, *want.own[0], *want.own[1]], strict=True):
        for name in ("grams", "shares", "contexts", "left"):
            assert np.array_equal(getattr(a, name), getattr(b, name))


# ---- quality --------------------------------------------------------------------------


def brute_repeats(words, least):
    n, longest, hit = len(words), 0, set()
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
            if k >= least:
                hit |= set(range(i, i + k)) | set(range(j, j + k))
    return len(hit), longest


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.integers(1, 5))
def test_repetition_is_exact(words, least):
    ids = np.array([sorted(set(words)).index(w) for w in words], np.int64)
    covered, longest = Q.repetition(ids, least)
    want = brute_repeats(words, least)
    if len(words) > least:
        assert (covered, longest) == (want if want[1] >= least else (0, want[1]))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab#|\n\t \x0b", max_size=80))
def test_base_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(line in lines[:i] and bool(re.search(r"[^\x20\x09-\x0D]", line)) for i, line in enumerate(lines))
    assert Q.measure(text)[:5] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit))


def test_verdicts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    clean = " ".join(word() for _ in range(200))
    passage = " ".join(word() for _ in range(130))
    texts = [clean, "spam " * 200, "too short", None, "", f"{clean} {passage} {clean[::-1]} {passage}", "x" * 100_000 + " " + clean]
    docs = documents(spark, texts)
    got = Q.judge(docs).orderBy("doc_id").collect()
    assert [r["kept"] for r in got] == [True, False, False, False, False, False, True]
    assert [r["base_failed"] for r in got] == [False, True, True, True, True, False, False]
    assert got[5]["longest_repeat"] == 130
    left = Q.passed(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 6]
    assert Q.judge(docs.limit(0)).count() == 0


def test_repeats_that_only_the_suffix_array_tells():
    words = iter(f"w{i}" for i in range(10_000))
    some = lambda n: " ".join(next(words) for _ in range(n))
    passage, short, lines = some(119), some(60), some(12)
    thrice = " ".join([some(200), passage, some(200), passage, some(243), passage])  # 1,000 words, 36 % in repeats
    long_once_more = " ".join([some(400), short, some(400), short])  # 13 %, but 60 words in a row
    many = " ".join(f"{some(30)} {lines}" for _ in range(5))  # 29 % in short repeats
    light = " ".join([some(300), lines, some(300), lines])
    for text, want in ((thrice, False), (long_once_more, False), (many, False), (light, True)):
        m = Q.measure(text)
        assert not Q.base_failed(m[0], m[4]) and Q.kept(m) is want


# ---- personal data --------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 14 <= len(digits(m[0])) <= 19 and P.luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a1.@+- 0259()%é", max_size=50))
def test_base_spans_match_the_patterns(text):
    base, every = P.find(text)
    assert base == brute(text) and set(base) <= set(every)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail jane.doe [at] mail1 [dot] example [dot] com now", "email", "jane.doe [at] mail1 [dot] example [dot] com"),
        ("write to jane at example dot com please", "email", "jane at example dot com"),
        ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("x jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("call plus one seven two four five five five seven zero five eight ok", "phone", "plus one seven two four five five five seven zero five eight"),
        ("+1 (724) 555-7О58!", "phone", "+1 (724) 555-7О58"),
        ("ip one nine two dot one six eight dot one dot one zero", "ip", "one nine two dot one six eight dot one dot one zero"),
        ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("a​b@ex​ample.com", "email", "a​b@ex​ample.com"),
        ("to jane at mail dot example (dot) co dot uk now", "email", "jane at mail dot example (dot) co dot uk"),
        ("jane (at) example.com", "email", "jane (at) example.com"),
        ("a at b [.] org", "email", "a at b [.] org"),
        ("juan arroba correo punto es", "email", "juan arroba correo punto es"),
        ("paul arobase poste point fr", "email", "paul arobase poste point fr"),
        ("host 192 dot 168 dot 1 dot 1 up", "ip", "192 dot 168 dot 1 dot 1"),
        ("host 192[.]168[.]1[.]1 up", "ip", "192[.]168[.]1[.]1"),
    ],
)
def test_disguises(text, kind, found):
    assert (kind, found) in [(k, text[a:b]) for k, a, b in P.find(text)[1]]


@pytest.mark.parametrize("text", ["Look at this dot com bubble", "one two three", "meet me at noon. Then go", "at at dot dot", "l0l 1O"])
def test_plain_texts_have_no_spans(text):
    assert P.find(text)[1] == []


def test_prose_with_at_has_no_added_spans():
    """A thousand sentences in which something is at a host, a time or a place, and dots are points."""
    rng = random.Random(11)
    hosts = ["example.com", "hotel.com", "10.0.0.1", "noon.Then", "work.We", "node-7.internal", "v2.1", "3.14", "www.site.org/a"]
    ways = [
        "Look at {h} for more.", "We met at {h} yesterday", "The class starts at {h} we left.", "the servers at {h} fail", "she looked at polka dot {w}",
        "arrived at meeting point {w}", "at the dot in {w}", "Find it at {h}, at {h} or at {w} dot {w}.", "they point at {w}. At {h} dot", "rates at {n} dot {n} percent", "at {w} point {w} dot it is",
    ]
    words = ["dresses", "three", "night", "home", "is", "in", "me", "so", "be", "at", "blue", "line"]
    for _ in range(1000):
        text = rng.choice(ways)
        for mark, some in (("{h}", hosts), ("{w}", words)):
            while mark in text:
                text = text.replace(mark, rng.choice(some), 1)
        base, every = P.find("Note: " + text.replace("{n}", "5") + " and so on")
        assert base == every, text


def test_addresses_as_they_stand_are_not_swallowed():
    text = "root [at] 10.0.0.1 or x@y.com dot end"
    assert [(k, text[a:b]) for k, a, b in P.find(text)[1]] == [("ip", "10.0.0.1"), ("email", "x@y.com")]


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1(" * 60_000, "a@" * 60_000, "one " * 50_000, "(at)" * 40_000, "a at " * 40_000, "a at b dot " * 20_000, "1 dot " * 40_000, "a@" + "b dot " * 40_000):
        P.find(text)


def test_detect_and_redact(spark):
    docs = documents(spark, [None, "", "é me@x.org, 10.0.0.1 or +1 (724) 555-7058", "me at x dot org", "plain"])
    got = P.detect(docs).orderBy("doc_id").collect()
    assert (got[2]["n_email"], got[2]["n_ip"], got[2]["n_phone"], got[2]["n_card"]) == (1, 1, 1, 0)
    assert got[2]["spans"] == "email:2:10,ip:12:20,phone:24:41" and got[0]["spans"] == got[1]["spans"] == ""
    assert got[3]["n_email"] == 0 and got[3]["n_added"] == 1
    red = {r["doc_id"]: r["text"] for r in P.redact(docs).collect()}
    assert red == {0: None, 1: "", 2: "é [EMAIL], [IP] or [PHONE]", 3: "[EMAIL]", 4: "plain"}
    assert P.redact(docs).columns == docs.columns and P.detect(docs.limit(0)).count() == 0


def test_many_spans_take_linear_time():
    text = " ".join(f"u{i}@h{i}.org or v{i} [at] h{i} [dot] org" for i in range(20_000))
    start = time.perf_counter()
    base, every = P.find(text)
    assert len(base) == 20_000 and len(every) == 40_000 and time.perf_counter() - start < 20


def test_long_runs_of_spelled_digits_are_one_number():
    digits = "four " + "one " * 15
    assert ("card", 3, 3 + len(digits) - 1) in P.find("no " + digits + "end")[1]
    long = "one " * 200
    assert P.find(long)[1] == []  # 200 digits are no card, wherever one might cut them


def test_planted_disguises_are_found_where_they_stand():
    rng = random.Random(8)
    words = "the a report of data shows that many small rivers run over old stone near town".split()
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    alike = {"a": "а", "e": "е", "o": "о", "c": "с", "p": "р", "x": "х"}
    names = "zero one two three four five six seven eight nine".split()
    caught = 0
    for _ in range(300):
        user, host = "".join(rng.choice("abcdexop") for _ in range(6)), "".join(rng.choice("abcdexop") for _ in range(5))
        kind = rng.randrange(4)
        if kind == 0:
            said, of = f"{user} [at] {host} (dot) org", "email"
        elif kind == 1:
            said, of = "".join(alike.get(c, c) if rng.random() < 0.5 else c for c in f"{user}{host}") + f"@{host}.org", "email"
        elif kind == 2:
            said, of = f"{user} at {host} dot org", "email"
        else:
            said, of = "plus " + " ".join(names[rng.randrange(10)] for _ in range(12)), "phone"
        before = prose(rng.randrange(3, 20)) + ": "
        spans = P.find(before + said + ", " + prose(10))[1]
        caught += (of, len(before), len(before) + len(said)) in spans
        assert all(k == of and a >= len(before) and b <= len(before) + len(said) for k, a, b in spans)
    assert caught >= 295
    assert all(P.find(prose(200))[1] == [] for _ in range(50))


def test_models_match_a_plain_kneser_ney():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    counts = [{w: rng.randrange(1, 6) for w in rng.sample(words, 35)} for _ in (0, 1)]
    letters = lambda w: "\x02" * (T.ORDER - 1) + w + "\x03"

    def grams(of, k):  # with the number of times that each stands in the words
        out = {}
        for w, n in of.items():
            t = letters(w)
            for i in range(T.ORDER - 1, len(t)):
                g = t[i - k + 1 : i + 1]
                out[g] = out.get(g, 0) + n
        return out

    def level(of, k):
        if k == T.ORDER:
            held = grams(of, k)
        else:
            held = {}
            for longer in grams(of, k + 1):
                held[longer[1:]] = held.get(longer[1:], 0) + 1
        context = {}
        for g, n in held.items():
            total, types = context.get(g[:-1], (0, 0))
            context[g[:-1]] = total + n, types + 1
        return held, context

    every = {w: 1 for c in counts for w in c}
    shared = [level(every, k) for k in range(1, T.SHARED + 1)]
    own = [shared + [level(c, k) for k in range(T.SHARED + 1, T.ORDER + 1)] for c in counts]

    def log_likelihood(levels, w):
        t, out = letters(w), 0.0
        for i in range(T.ORDER - 1, len(t)):
            p = 1 / (len(shared[0][0]) + 1)
            for k, (held, context) in enumerate(levels, 1):
                g = t[i - k + 1 : i + 1]
                if g[:-1] in context:
                    total, types = context[g[:-1]]
                    p = max(held.get(g, 0) - T.DISCOUNT, 0) / total + T.DISCOUNT * types / total * p
            out += math.log(p)
        return out

    asked = words + ["zzz", "abcdz", "a"]
    want = [log_likelihood(own[1], w) - log_likelihood(own[0], w) for w in asked]
    assert T.Model(counts).evidence(asked).tolist() == pytest.approx(want, abs=1e-9)
