"""Distinct counts that add up over builds: sketches stored beside each build, with the exact counts as an option.

A sketch is a row of some kilobytes. Counts of any set of builds come from the union of their sketches, without a look at their rows;
exact ones come from the distinct values that a build may store as well.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Logarithm of a sketch's size; its standard error is 1.04 / sqrt(2 ** LG).
LG = 14


def error(lg: int = LG) -> float:
    """Relative standard error of an estimate."""
    return 1.04 / math.sqrt(1 << lg)


def sketched(df: DataFrame, columns: Sequence[str], lg: int = LG) -> DataFrame:
    """``column, rows, sketch``, a row for each column, from one pass. Nulls don't count, empty strings do."""
    each = lambda c: F.hll_sketch_agg(F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(f"`{c}`")), lg)
    one = df.agg(F.count("*").alias("_rows"), *(each(c).alias(f"_{i}") for i, c in enumerate(columns)))
    rows = [F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"_{i}").alias("sketch")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def save(df: DataFrame, columns: Sequence[str], path: str, name: str, lg: int = LG, exact: bool = False) -> None:
    """Stores the sketches of a build under its name, in place of earlier ones; with ``exact`` its distinct values, too."""
    sketched(df, columns, lg).write.mode("overwrite").parquet(f"{path}/sketches/build={name}")
    if exact:
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns)))
        values = df.select(each.alias("v")).select("v.*").where("value IS NOT NULL").distinct()
        values.write.mode("overwrite").parquet(f"{path}/values/build={name}")


def _builds(df: DataFrame, names: Sequence[str] | None) -> DataFrame:
    return df if names is None else df.where(F.col("build").cast("string").isin(*names))


def estimates(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """``column, rows, n_distinct`` over the union of builds (all, or those named), estimated."""
    held = _builds(spark.read.parquet(f"{path}/sketches"), names)
    return held.groupBy("column").agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))


def exact(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """``column, n_distinct`` over the union of builds, exactly, from their stored values."""
    return _builds(spark.read.parquet(f"{path}/values"), names).groupBy("column").agg(F.countDistinct("value").alias("n_distinct"))
