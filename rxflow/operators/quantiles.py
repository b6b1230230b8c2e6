"""Exact medians and quantiles without a buffer of all values: selection by histograms of narrowing ranges.

Values become whole numbers in the same order, and a number is found digit by digit: each pass counts the values of the ranges that still hold
a wanted rank in 65,536 parts. Four passes of 16 bits end at single values. No pass returns more than that many counts for a wanted rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxflow.sources.tables import durable

#: Bits that a pass settles.
DIGIT = 16
_SIGN = np.int64(2**63 - 1)


def _as_key(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles as whole numbers in the order of the doubles, and back: of negative ones all but the sign are turned."""
    return np.where(bits < 0, bits ^ _SIGN, bits)


def _keyed(values: DataFrame, column: str) -> tuple[DataFrame, bool]:
    """``key, n`` for each distinct value that is not null, and whether keys are those of doubles."""
    kind = values.schema[column].dataType
    whole = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    if not whole and not isinstance(kind, (T.DoubleType, T.FloatType)):
        raise TypeError(f"no median of {column}: {kind.simpleString()}")
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("long" if whole else "double").alias("value")).agg(F.count("*").alias("n"))
    if whole:
        return durable(counts.select(F.col("value").alias("key"), "n")), False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch["value"].to_numpy(zero_copy_only=False).view(np.int64)
            yield pa.record_batch([pa.array(_as_key(bits)), batch["n"]], ["key", "n"])

    return durable(counts.mapInArrow(run, "key long, n long")), True


def _narrowed(counts: DataFrame, ranks: dict[int, tuple[int, int]], shift: int) -> dict[int, tuple[int, int]]:
    """One pass: for each wanted rank the range (key >> shift) that holds it, and how many values stand before that range.

    ranks: the same of the pass before.
    """
    at = F.shiftright("key", shift)
    held = {top for top, _ in ranks.values()}
    some = counts if shift + DIGIT == 64 else counts.where(F.shiftright("key", shift + DIGIT).isin(*held))
    rows = some.groupBy(at.alias("at")).agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(rows["at"].to_numpy())
    at, n = rows["at"].to_numpy()[order], rows["n"].to_numpy()[order]
    out = {}
    for rank, (top, before) in ranks.items():
        mine = slice(None) if shift + DIGIT == 64 else (at >> DIGIT) == top
        ends = before + np.cumsum(n[mine])
        k = int(np.searchsorted(ends, rank, side="right"))
        out[rank] = (int(at[mine][k]), int(ends[k] - n[mine][k]))
    return out


def quantiles(values: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """The exact quantiles of a column of numbers, between two values as far as the share lies between them. Nulls don't count; NaN is the largest
    value; without values each is None."""
    if not all(0 <= s <= 1 for s in shares):
        raise ValueError("shares lie between 0 and 1")
    counts, doubles = _keyed(values, column)
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(shares)
    places = [s * (total - 1) for s in shares]
    found = {r: (0, 0) for p in places for r in (math.floor(p), math.ceil(p))}
    for shift in range(64 - DIGIT, -1, -DIGIT):
        found = _narrowed(counts, found, shift)
    keys = {rank: key for rank, (key, _) in found.items()}
    if doubles:
        keys = {rank: float(_as_key(np.array([key], np.int64)).view(np.float64)[0]) for rank, key in keys.items()}
    out = []
    for p in places:
        low, high = keys[math.floor(p)], keys[math.ceil(p)]
        out.append(float(low) if low == high or p == math.floor(p) else (math.ceil(p) - p) * low + (p - math.floor(p)) * high)
    return out


def median(values: DataFrame, column: str) -> float | None:
    return quantiles(values, column, [0.5])[0]
