"""Partitions of groups into train, valid and test, forced hold-outs, and checks for leaks."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxflow.schema import SPLITS, CheckFailed

FRACTIONS = (0.8, 0.1, 0.1)
#: Groups that ``exact`` mode collects to the driver, and rows that an exact permutation is drawn for there, at most.
EXACT_GROUPS = EXACT_ROWS = 1_000_000


def _check(fractions: Sequence[float]) -> None:
    if len(fractions) != 3 or abs(sum(fractions) - 1) > 1e-9:
        raise ValueError(f"fractions must be three and sum to 1: {tuple(fractions)}")


def shuffled_split(groups: Sequence[object], fractions: Sequence[float] = FRACTIONS, seed: int = 42) -> dict[object, str]:
    """A split for each distinct group, on the driver: sorted as text, shuffled by a seed, cut by counts of groups."""
    _check(fractions)
    ordered = sorted(set(groups), key=str)
    random.Random(seed).shuffle(ordered)
    first = int(len(ordered) * fractions[0])
    second = first + int(len(ordered) * fractions[1])
    return {g: SPLITS[(i >= first) + (i >= second)] for i, g in enumerate(ordered)}


def hashed_split(groups: DataFrame, column: str, fractions: Sequence[float] = FRACTIONS, seed: int = 42) -> DataFrame:
    """``column, split`` of distinct groups, cut by the order of a seeded hash; nothing is collected but counts."""
    from rxflow.operators.build import numbered

    _check(fractions)
    one = groups.select(column).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string"))))
    ranked = numbered(one, ["_h", column], "_r")
    n = F.lit(groups.select(column).distinct().count()).cast("double")
    first = F.floor(n * F.lit(float(fractions[0])))
    second = first + F.floor(n * F.lit(float(fractions[1])))
    return ranked.select(column, F.when(F.col("_r") < first, "train").when(F.col("_r") < second, "valid").otherwise("test").alias("split"))


def assign_splits(df: DataFrame, group: str, fractions: Sequence[float] = FRACTIONS, seed: int = 42, split_col: str = "split", mode: str = "hash") -> DataFrame:
    """``df`` with the split of each row's group. Modes: ``hash`` scales; ``exact`` repeats a seeded shuffle of the
    group list, of up to EXACT_GROUPS."""
    if mode == "exact":
        found = df.select(group).distinct().limit(EXACT_GROUPS + 1).collect()
        if len(found) > EXACT_GROUPS:
            raise ValueError(f"more than {EXACT_GROUPS} groups; use mode 'hash'")
        pairs = list(shuffled_split([r[0] for r in found], fractions, seed).items())
        kind = df.schema[group].dataType.simpleString()
        table = df.sparkSession.createDataFrame(pairs, f"`{group}` {kind}, `{split_col}` string")
    elif mode == "hash":
        table = hashed_split(df, group, fractions, seed).withColumnRenamed("split", split_col)
    else:
        raise ValueError(f"no mode {mode}")
    return df.drop(split_col).join(table, group)


def force_to_test(df: DataFrame, selected: Column, group: str, split_cols: Sequence[str] = ("split",)) -> DataFrame:
    """All rows of a group with a selected row go to test."""
    hit = df.where(selected).select(F.col(group).alias("_g")).distinct().withColumn("_hit", F.lit(True))
    rows = df.join(hit, F.col(group).eqNullSafe(F.col("_g")), "left")
    return rows.withColumns({c: F.when(F.col("_hit"), "test").otherwise(F.col(c)) for c in split_cols}).drop("_g", "_hit")


def split_counts(df: DataFrame, split_col: str = "split") -> DataFrame:
    """``split, n`` of all three splits, also empty ones."""
    names = df.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SPLITS)], "split string, at int")
    found = df.groupBy(F.col(split_col).alias("split")).agg(F.count("*").alias("n"))
    return names.join(found, "split", "left").select("split", F.coalesce("n", F.lit(0).cast("long")).alias("n")).orderBy("split")


def leaking_groups(df: DataFrame, group: str, split_col: str = "split") -> DataFrame:
    """``group, n_splits`` of groups in more than one split."""
    return df.groupBy(group).agg(F.countDistinct(split_col).alias("n_splits")).where("n_splits > 1")


def assert_no_leak(df: DataFrame, group: str, split_col: str = "split") -> None:
    if not (bad := leaking_groups(df, group, split_col)).isEmpty():
        raise CheckFailed(f"{bad.count()} groups of {group} lie in several values of {split_col}")


def assert_held_out(df: DataFrame, selected: Column, split_cols: Sequence[str]) -> None:
    """All selected rows are in test, in every split column."""
    good = df.where(selected).agg(*(F.coalesce(F.bool_and(F.col(c) == "test"), F.lit(True)).alias(c) for c in split_cols)).first()
    if bad := [c for c in split_cols if not good[c]]:
        raise CheckFailed(f"held-out rows outside of test in {', '.join(bad)}")


def pulled_along(before: DataFrame, after: DataFrame, selected: Column, key: str, split_col: str = "split") -> DataFrame:
    """One row, ``n``: rows that moved to test without being selected."""
    old = before.select(key, F.col(split_col).alias("_old"))
    return after.join(old, key).agg(F.count_if((F.col("_old") != "test") & (F.col(split_col) == "test") & ~F.coalesce(selected, F.lit(False))).alias("n"))


def overlap(df: DataFrame, key: str, split_col: str = "split") -> DataFrame:
    """One row, ``share``: test rows whose key is in train, too. Nulls match nulls; without test rows it is 0.

    One exchange, no self-join.
    """
    test = F.col(split_col) == "test"
    each = df.groupBy(key).agg(F.bool_or(F.col(split_col) == "train").alias("seen"), F.count_if(test).alias("n"))
    n = F.sum("n")
    hit = F.sum(F.when(F.col("seen"), F.col("n")).otherwise(0))
    return each.agg(F.coalesce(F.try_divide(hit.cast("double"), n.cast("double")), F.lit(0.0)).alias("share"))


def shuffled_pairs(df: DataFrame, order: Sequence[str], columns: Sequence[str], seed: int = 42, exact: bool = False) -> DataFrame:
    """A control: ``columns``, kept together, are permuted over the rows of ``df``; all else stays.

    ``exact`` repeats numpy's permutation of the row numbers, drawn on the driver, of up to EXACT_ROWS rows.
    """
    from rxflow.operators.build import numbered

    rows = numbered(df, list(order), "_at")
    if exact:
        import numpy as np

        n = df.count()
        if n > EXACT_ROWS:
            raise ValueError(f"{n} rows, more than {EXACT_ROWS}; use exact=False")
        places = np.random.default_rng(seed).permutation(n)
        table = df.sparkSession.createDataFrame([(i, int(p)) for i, p in enumerate(places)], "_to long, _at long")
        taken = rows.join(table, "_at").select("_to", *columns)
    else:
        hashed = rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("_at").cast("string"))))
        taken = numbered(hashed.select("_h", *columns), ["_h"], "_to").drop("_h")
    return rows.drop(*columns).join(taken, F.col("_at") == F.col("_to")).drop("_to", "_at").select(*df.columns)


