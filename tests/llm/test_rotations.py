"""Operator 13 against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rxflow.llm import rotations as R


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").select("*", F.lit("clash").alias("node"), F.lit(1).alias("v"), F.lit(None).alias("h"))


def expected(rows):
    """n_links and component of each row, by position."""
    fine = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    sizes = [len(rows[k][1]) for k in fine]
    most = min(set(sizes), key=lambda d: (-sizes.count(d), d)) if sizes else 0
    fine = [k for k in fine if len(rows[k][1]) == most]
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    x = R.units(np.array([rows[k][1] for k in fine], float)) if fine else np.zeros((0, 1))
    for p, q in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)), strict=True):
        links[fine[p]] += 1
        links[fine[q]] += 1
        root[top(fine[p])] = top(fine[q])
    least = {}
    for k, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            least[top(k)] = min(least.get(top(k), vec_id), vec_id)
    return sorted(((v, links[k], least.get(top(k)), v == least.get(top(k))) for k, (v, _) in enumerate(rows)), key=str)


def got(spark, rows, kind="float", **options):
    return sorted(map(tuple, R.near_duplicates(frame(spark, rows, kind).repartition(3), **options).collect()), key=str)


def near(rng, x, cosine):
    z = rng.normal(size=len(x))
    x = x / np.linalg.norm(x)
    z -= (z @ x) * x
    return cosine * x + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def test_groups_copies_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "TILE", 32)  # so that groups are cut
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 32))
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(1000 + i, near(rng, base[7], 0.97)) for i in range(150)]  # a large group of near copies
    rows += [(2000 + i, base[9]) for i in range(120)]  # and one of copies
    at = base[20]
    for i in range(30):  # a chain
        at = near(rng, at, 0.92)
        rows.append((3000 + i, at))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 32), (5003, [None] + [1.0] * 31), (5004, [float("nan")] + [1.0] * 31), (5005, [float("inf")] + [1.0] * 31), (5006, [1.0, 2.0]), (5007, [2.0, 4.0])]
    rows += [(None, rows[3][1]), (None, [1.0] * 32), (5, rows[5][1]), (5, rows[6][1]), (-3, [2 * x for x in rows[8][1]])]
    assert got(spark, rows) == expected(rows)


@pytest.mark.parametrize("dims", [1, 3, 100])
def test_other_dimensions_and_doubles(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(i, rng.normal(size=dims).tolist()) for i in range(200)]
    rows += [(500 + i, near(rng, np.array(rows[i][1]), 0.95).tolist()) for i in range(60) if dims > 1]
    rows += [(900, [x * 1e200 for x in rows[0][1]]), (901, [x * 1e-200 for x in rows[0][1]])]
    assert got(spark, rows, "double", exact=True) == expected(rows)


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine is just above the threshold are the hardest; and many vectors that are near none."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(2500, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(5000 + i, near(rng, v, 0.9005).tolist()) for i, v in enumerate(base[:1000])]
    found = got(spark, rows, "double")
    true = expected(rows)
    assert sum(n for _, n, *_ in true) == 2000
    assert sum(n for _, n, *_ in found) >= 0.98 * 2000
    assert all(f[1] <= t[1] for f, t in zip(sorted(found), sorted(true), strict=True))


def test_none_one_and_two(spark):
    assert got(spark, []) == []
    assert got(spark, [(4, [1.0, 2.0])]) == [(4, 0, 4, True)]
    assert got(spark, [(4, None), (5, None)]) == [(4, 0, 4, True), (5, 0, 5, True)]
    assert got(spark, [(4, [1.0, 0.0]), (3, [2.0, 0.1])]) == [(3, 1, 3, True), (4, 1, 3, False)]
    assert got(spark, [(4, [1.0, 0.0]), (3, [0.0, 1.0]), (6, [1.0, 0.0])]) == [(3, 0, 3, True), (4, 1, 4, True), (6, 1, 4, False)]


def test_exact_budget_bounds_every_linked_pair():
    rng = np.random.default_rng(3)
    x = R.units(rng.normal(size=(2000, 24)) * np.linspace(0.2, 3, 24))
    coder = R.fit(x, 100_000, exact=True)
    y = R.units(np.stack([near(rng, v, 0.9) for v in x]))
    a, b = coder.turned(x), coder.turned(y)
    flipped = (a > 0) != (b > 0)
    assert (np.minimum(coder.energies(a, flipped), coder.energies(b, flipped)).min(axis=1) <= coder.limit).all()


def test_codes_are_balanced_and_rotated():
    rng = np.random.default_rng(4)
    x = R.units(rng.normal(size=(3000, 16)) + 0.5)
    coder = R.fit(x, 3000)
    share = (coder.turned(x) > 0).mean(axis=0)
    assert np.abs(share - 0.5).max() < 0.01
    turn = coder.rotation
    assert np.allclose(turn.T @ turn, np.eye(16), atol=1e-8)
