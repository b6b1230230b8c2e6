import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rxflow.operators import profile, quantiles


def frame(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


SAMPLES = {
    "odd": [5, 1, 3],
    "even": [4, 1, 3, 2],
    "ties": [7] * 50 + [1] * 49 + [9],
    "nulls": [None, 2, None, 1],
    "one": [-4],
    "far apart": [-(2**63), 2**63 - 1, 0, 65535, 65536, -65536, -1],
    "many": [random.Random(1).randrange(-(10**6), 10**12) for _ in range(3001)],
}


@pytest.mark.parametrize("name", SAMPLES)
def test_whole_numbers(spark, name):
    rows = frame(spark, SAMPLES[name], "long")
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    want = list(rows.agg(*(F.percentile("x", s) for s in shares)).first())
    assert quantiles.quantiles(rows, "x", shares) == pytest.approx(want)
    assert quantiles.median(rows, "x") == pytest.approx(rows.agg(F.median("x")).first()[0])


@pytest.mark.parametrize("values", [[0.5, -0.25, 1e300, -1e-300, 2.0], [float("inf"), float("-inf"), 0.0, -0.0], [1.5, None, 2.5, 2.5], [float("nan"), 1.0, 2.0]])
def test_doubles(spark, values):
    rows = frame(spark, values, "double")
    assert quantiles.median(rows, "x") == rows.agg(F.median("x")).first()[0]


def test_no_values(spark):
    assert quantiles.quantiles(frame(spark, [None, None], "int"), "x", [0.5, 1.0]) == [None, None]
    assert profile.length_stats(frame(spark, [], "int"), "x").first()["median"] is None
    with pytest.raises(TypeError):
        quantiles.median(frame(spark, ["a"], "string"), "x")
    with pytest.raises(ValueError):
        quantiles.quantiles(frame(spark, [1], "int"), "x", [1.5])


def test_four_passes_of_bounded_size(spark, monkeypatch):
    passes = []
    narrowed = quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda counts, ranks, shift: passes.append(shift) or narrowed(counts, ranks, shift))
    rows = spark.range(200_000).select((F.xxhash64("id")).alias("x"))
    want = rows.agg(F.median("x")).first()[0]
    assert math.isclose(quantiles.median(rows, "x"), want, rel_tol=1e-12)
    assert passes == [48, 32, 16, 0]
    plan = profile.cluster_stats(rows.withColumnRenamed("x", "size"))._jdf.queryExecution().optimizedPlan().toString()
    assert "median" not in plan.split("AS")[0] and "percentile" not in plan


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=2))
def test_keys_keep_the_order_of_doubles(values):
    import numpy as np

    x = np.array(values) + 0.0
    keys = quantiles._as_key(x.view(np.int64))
    ordered = keys[np.argsort(x, kind="stable")]
    assert (ordered[1:] >= ordered[:-1]).all()
    assert (quantiles._as_key(keys).view(np.float64) == x).all()
