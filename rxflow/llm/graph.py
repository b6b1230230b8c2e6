"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxflow.llm.common import stored


def _starred(pairs: DataFrame) -> DataFrame:
    """``u, v`` with ``m``, the smallest of u and its neighbours v.

    The minimum is summed up before the shuffle and joined back, so that a node with very
    many neighbours does not meet them in one task.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node u has a single v, and no v has an edge of its own. Further rounds would change nothing then."""
    one = edges.groupBy("u").agg(F.count("*").alias("n")).unionByName(edges.select(F.col("v").alias("u")).distinct().withColumn("n", F.lit(1).cast("long")))
    return one.groupBy("u").agg(F.sum("n").alias("n")).where("n > 1").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the edges ``u, v`` (long); root is the smallest node that it reaches.

    No edges give an empty table. Every half round is written to the shared folder.
    """
    now = stored(_clean(edges.select("u", "v")))
    for _ in range(rounds):
        if _settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _starred(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _starred(stored(_clean(large)))
        now = stored(_clean(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))))
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
