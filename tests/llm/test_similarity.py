"""Operators 2 and 7 against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rxflow.llm import graph, neighbours
from rxflow.llm import ngram_join as J

# ---- nearest neighbours ---------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("codes", F.lit("clash"))


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[200:500] = x[200]  # a very common vector
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = neighbours.search(vectors(spark, rows), F.col("vec_id") % 100 == 0, rerank=200).collect()
    x = x.astype(float)
    hit = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        assert all(math.isclose(r["score"], d[r["vec_id"]], rel_tol=1e-12, abs_tol=1e-12) for r in mine)
        hit += len({r["vec_id"] for r in mine} & set(want.tolist()))
        if q in (200, 300, 400):  # ties by the smaller id
            assert [r["vec_id"] for r in mine] == want.tolist()
    assert hit >= 0.9 * 150


def test_hot_group_is_searched_whole(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1000:] = x[1000] + 1e-4 * rng.normal(size=(3000, 16))  # far more near copies than are ranked at first
    x = x.astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = neighbours.search(vectors(spark, rows), F.col("vec_id") % 500 == 0).collect()
    x = x.astype(float)
    for q in range(0, 4000, 500):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in mine] == np.argsort(d, kind="stable")[:10].tolist()


def test_odd_vectors_take_no_part(spark):
    bad = [(100, None), (200, [0.0, 0.0]), (300, [1.0, float("nan")]), (400, [1.0, float("inf")]), (500, [1.0, None]), (600, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (7, [0.0, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 0.5])]
    got = neighbours.search(vectors(spark, bad + good), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 8), (0, 2, 7)] and got[0]["score"] == 0.5
    assert neighbours.search(vectors(spark, bad[:1]), F.col("vec_id") % 100 == 0).count() == 0
    assert neighbours.search(vectors(spark, good[1:]), F.col("vec_id") % 100 == 0).count() == 0


def test_quantiser_reconstructs():
    x = np.random.default_rng(1).normal(size=(800, 16)).astype(np.float32)
    few, many = (neighbours.fit(x, books=b, words=32) for b in (1, 6))
    errors = []
    for q in (few, many):
        codes, norms = q.encode(x)
        back = sum(book[codes[:, m]] for m, book in enumerate(q.books))
        errors.append(((x - back) ** 2).sum())
        assert np.allclose(norms, (back.astype(float) ** 2).sum(axis=1), rtol=1e-4)
    assert errors[1] < 0.5 * errors[0]


# ---- components -----------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]}


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- the join -------------------------------------------------------------------------


def brute(texts):
    sets = []
    for t in texts:
        words = [w for w in (t or "").translate(J._LOWER).replace("\n", " ").split(" ") if w]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(20, 120))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(copy) // 18)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    family = [word() for _ in range(150)]
    for _ in range(90):
        copy = list(family)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(150)] = word()
        out.append(" ".join(copy))
    out += [None, "", " \n", "one two", "One  TWO", "one two three four five", "É é é é é", "é é é é é", out[0].upper(), out[3] + "\n"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("tile", [16, 512])
def test_join_matches_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(J, "TILE", tile)
    texts = corpus(random.Random(tile))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.classes(docs).collect()}
    assert got == dict(enumerate(brute(texts)))
    left = sorted(r["doc_id"] for r in J.one_of_each(docs).collect())
    assert left == sorted({c for _, c in got.values()})


def test_threshold_is_exact(spark):
    base = [f"w{i}" for i in range(49)]  # 45 shingles
    exact = " ".join(base)
    near = " ".join(base[:44] + ["x"] + base[45:])  # shares 40, union 50: 0.8
    far = " ".join(base[:43] + ["y"] + base[44:48] + ["z"])  # under it
    docs = spark.createDataFrame([(5, exact), (3, near), (9, far)], "doc_id long, text string")
    want = brute([exact, near, far])
    got = {r["doc_id"]: r["component_id"] for r in J.classes(docs).collect()}
    assert got[5] == got[3] == 3 and (got[9] == 3) == (want[2][1] == want[0][1])


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "q"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in J.classes(docs).collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (2, 1), (4, 4)]
    assert sorted(r["doc_id"] or -1 for r in J.one_of_each(docs).collect()) == [-1, 1, 4]
    assert J.classes(docs.limit(0)).count() == 0


def test_tree_loses_no_partner():
    rng = np.random.default_rng(5)
    points = rng.poisson(3, size=(300, J.GROUPS)).astype(np.int32)
    points[1::2] = points[::2] + (rng.random((150, J.GROUPS)) < 0.03)
    sizes = points.sum(axis=1)
    tree = J.Tree(points, sizes)
    for i in range(0, 300, 7):
        bound = np.minimum(points, points[i]).sum(axis=1)
        want = {j for j in range(300) if 9 * bound[j] >= 4 * (sizes[i] + sizes[j]) and 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j])}
        assert want <= set(tree.near(points[i], int(sizes[i])).tolist())


def test_a_shingle_of_every_document_is_sent_once_a_batch(spark, monkeypatch):
    rng = random.Random(21)
    passage = "one passage that every single document here holds"
    texts = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(40)) for _ in range(rng.randrange(0, 30))) + " " + passage for _ in range(400)] + ["", None, "own words alone"]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id long, text string, hashes string").coalesce(1)
    sets = [set(J.shingles(x or "").tolist()) for x in texts]
    seen = {}
    for s in sets:
        for h in s:
            seen[h] = seen.get(h, 0) + 1
    want = {i: sum(seen[h] > 1 for h in s) for i, s in enumerate(sets)}
    got = {r["doc_id"]: (r["n"], r["shared"]) for r in J.sets_of(docs).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    entries = J._dealt(docs, 4).select(F.sum(F.octet_length("hashes") / 5)).first()[0]
    assert entries == len(seen) < sum(map(len, sets))


def test_components_stop_at_stars(spark, monkeypatch):
    edges = [(i, 0) for i in range(1, 50)] + [(100 + i, 99 + i) for i in range(1, 40)] + [(7, 7)]
    rows = spark.createDataFrame(edges, "u long, v long")
    want = {i: 0 for i in range(50)} | {100 + i: 100 for i in range(40)}
    assert {r["node"]: r["root"] for r in graph.components(rows).collect()} == want
    written = []
    monkeypatch.setattr(graph, "stored", lambda df: written.append(1) or df.sparkSession.createDataFrame(df.collect(), df.schema))
    assert graph.components(rows.where("v = 0")).count() == 50 and len(written) == 1
