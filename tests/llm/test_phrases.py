"""Operator 11 against counts in memory."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rxflow.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, f string"


def pieces(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            yield "und" if lang is None else lang, [w for w in re.split(r"[\x20\x09]+", piece) if w]


def expected(rows, longest=5, least=100, first=2000):
    f, n = Counter(), Counter()
    for lang, words in pieces(rows):
        n[lang] += len(words)
        for k in range(1, longest + 1):
            for i in range(len(words) - k + 1):
                f[lang, tuple(words[i : i + k])] += 1
    often = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, p), a in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside[lang, p[i : i + k]], a)
    out = []
    for (lang, p), a in often.items():
        if inside[lang, p] >= a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    found, rank = [], Counter()
    for r in out:
        rank[r[0]] += 1
        if rank[r[0]] <= first:
            found.append((r[0], rank[r[0]], *r[1:]))
    return found


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, phrases.mine(docs, **options).collect()))


def prose(seed, n=120):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "ünder", "ÜNDER", "x", "tab\there", "nul\x00l", "日本", "é"]
    ends = [" ", " ", " ", " ", ", ", ". ", "\n", "\t ", "!?", "  ", "\x0b", "\x85", " "]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(60)))
        if i % 3 == 0:
            text += " strong coffee in the morning "
        rows.append((i, text, rng.choice(["en", "en", None, "und", ""]), "clash", 1, None))
    return rows + [(None, None, "en", None, None, None), (1, "", None, None, None, None), (2, " .,; \t", "en", None, None, None)]


@pytest.mark.parametrize("seed,least", [(1, 5), (2, 20), (3, 1)])
def test_equals_counts_in_memory(spark, seed, least):
    rows = prose(seed)
    rows += rows[:20]  # repeated rows
    want = sorted(expected(rows, least=least, first=40))
    assert run(spark, rows, least=least, first=40) == want and want


def test_runs_overlaps_and_very_long_texts(spark):
    rows = [(1, "a " * 30_000, "en", None, None, None), (2, "b" * 100_000 + " c" * 150, "de", None, None, None)]
    want = expected(rows)
    assert run(spark, rows) == sorted(want) and {r[2] for r in want} == {"a a", "a a a", "a a a a", "a a a a a", "c c", "c c c", "c c c c", "c c c c c"}


def test_products_beyond_64_bits(spark):
    big = 3 * 10**12
    table = lambda rows: spark.createDataFrame(rows, "lang string, phrase string, f long")
    got = phrases.scored([table([("en", None, 10**14), ("en", "a", big), ("en", "b", big + 1)]), table([("en", "a b", big - 7)])]).collect()
    assert [(r["score"], r["a"]) for r in got] == [(1000 * (big - 7) * 10**14 // (big * (big + 1)), big - 7)]


def test_nothing_frequent_and_nothing_at_all(spark):
    assert run(spark, [(1, "one two three", "en", None, None, None)]) == []
    assert phrases.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert run(spark, [(1, None, None, None, None, None)]) == []


def hashed(lang, *words):
    h = phrases._hashes(pa.array([lang]))
    for w in words:
        h = phrases._chain(h, phrases._hashes(pa.array([w])))
    return h


def test_sieve_passes_all_and_few_others(spark):
    pairs = [(f"w{i}", f"w{i * 7 % 4001}") for i in range(4000)]
    level = spark.createDataFrame([("en", " ".join(p), 1) for p in pairs] + [("en", None, 5)], "lang string, phrase string, f long")
    passes = phrases.sieve(level, 2)
    share = lambda lang, some: passes(np.concatenate([hashed(lang, *p) for p in some])).mean()
    assert share("en", pairs) == 1
    assert share("de", pairs) < 0.02 and share("en", [(b, a) for a, b in pairs[1:]]) < 0.02 and share("en", [(f"v{i}", "x") for i in range(4000)]) < 0.02


def test_a_full_sieve_still_counts_right(spark, monkeypatch):
    """A sieve too small for its phrases lets others through, which are counted and dropped."""
    monkeypatch.setattr(phrases, "SIEVE", 1 << 10)
    rows = prose(4)
    assert run(spark, rows, least=4, first=30) == sorted(expected(rows, least=4, first=30))


def test_phrases_need_frequent_ends():
    text, lang = pa.array(["a b c a b. b c"]), pa.array(["en"])

    def only(*held):
        known = np.concatenate([hashed("en", *p.split()) for p in held])
        return lambda h: np.isin(h, known)

    _, names, n = phrases.count_batch(text, lang, 2, [only("a", "b")])
    assert dict(zip(names.to_pylist(), n.tolist(), strict=True)) == {"a b": 2}
    _, names, n = phrases.count_batch(text, lang, 3, [only("a", "b", "c"), only("a b", "b c")])
    assert dict(zip(names.to_pylist(), n.tolist(), strict=True)) == {"a b c": 1}
