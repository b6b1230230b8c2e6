"""Batch embeddings through an injected encoder, cached by id and resumable."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxflow.functions import exprs as E
from rxflow.sources.tables import KeyValueCache

#: Residues of a sequence that are embedded.
MAX_RESIDUES = 1022


def truncated(sequences: DataFrame, most: int = MAX_RESIDUES) -> DataFrame:
    return sequences.withColumn("sequence", F.substring("sequence", 1, most))


def token_batches(rows: DataFrame, length: str, budget: int, id: str = "id") -> DataFrame:
    """Rows with ``batch`` and ``width``: batches of rows of like length whose rows times width (the length of the longest) stay within a budget.

    Rows are range-partitioned by length, longest first, so a batch's first row tells its width, and a task fills its batches one after the
    other. A row longer than the budget is a batch by itself; a null length counts as 0, and rows without tokens as one token each. Only the last batch of
    a task may be short. The order of the rows is that of their ids, which batches don't change.
    """
    if budget < 1:
        raise ValueError(f"the budget must be positive, not {budget}")
    tokens = F.coalesce(F.col(length), F.lit(0)).cast("long")
    order = ["_shorter", id]
    dealt = rows.withColumn("_shorter", -tokens).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, width, room = -1, 0, 0
        for held in batches:
            sizes = np.maximum(1, -held["_shorter"].to_numpy())
            numbers, widths, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
            while at < len(sizes):  # one step a batch
                if room < 1:
                    number, width = number + 1, int(sizes[at])
                    room = max(1, budget // width)
                n = min(room, len(sizes) - at)
                numbers[at : at + n], widths[at : at + n] = number, width
                room, at = room - n, at + n
            part = held["_part"].to_numpy().astype(np.int64) if len(sizes) else numbers
            out = held.drop_columns(["_shorter", "_part"])
            yield out.append_column("batch", pa.array((part << 33) + numbers)).append_column("width", pa.array(widths))

    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType()), T.StructField("width", T.LongType())])
    return dealt.mapInArrow(run, schema)


def padding(batched: DataFrame, length: str) -> DataFrame:
    """One row: batches, rows, and the share of the places that padding takes if each batch is as wide as its longest row."""
    tokens = F.greatest(F.lit(1), F.coalesce(F.col(length), F.lit(0)))
    return batched.agg(F.countDistinct("batch").alias("n_batches"), F.count("*").alias("n_rows"), (1 - F.sum(tokens) / F.sum("width")).alias("padding"))


def embed_by_tokens(sequences: DataFrame, encode: Callable[[list[str]], list[list[float]]], budget: int = 8192, most: int = MAX_RESIDUES) -> DataFrame:
    """``id, embedding`` like ``embed``, with batches by a budget of tokens instead of a number of rows."""
    rows = truncated(sequences.select("id", "sequence"), most).withColumn("_length", F.length("sequence"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if left is None else pd.concat([left, frame])
            whole = frame["batch"] != frame["batch"].iloc[-1]  # the last may go on in the next frame
            for _, part in frame[whole].groupby("batch", sort=False):
                yield pd.DataFrame({"id": part["id"], "embedding": encode(list(part["sequence"]))})
            left = frame[~whole]
        if left is not None and len(left):
            yield pd.DataFrame({"id": left["id"], "embedding": encode(list(left["sequence"]))})

    return token_batches(rows, "_length", budget).mapInPandas(run, "id string, embedding array<float>")


def embed(sequences: DataFrame, encode: Callable[[list[str]], list[list[float]]], batch_size: int = 8, most: int = MAX_RESIDUES) -> DataFrame:
    """``id, embedding``; sequences of like length share a batch, since partitions are sorted by length first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                yield pd.DataFrame({"id": part["id"], "embedding": encode(list(part["sequence"]))})

    rows = truncated(sequences.select("id", "sequence"), most).sortWithinPartitions(F.length("sequence"), "id")
    return rows.mapInPandas(run, "id string, embedding array<float>")


def needed(reactions: DataFrame, n: int | None = None) -> DataFrame:
    """``id, sequence`` of the enzymes of a table, or of its first n rows; of an id with several sequences the last row's."""
    rows = reactions if n is None else reactions.orderBy("reaction_id").limit(n)
    return rows.groupBy(F.col("uniprot_id").alias("id")).agg(F.max_by("sequence", "reaction_id").alias("sequence"))


def ensure_embeddings(spark: SparkSession, wanted: DataFrame, cache_path: str, encode: Callable[[list[str]], list[list[float]]], per_flush: int = 20_000, batch_size: int = 8) -> DataFrame:
    """``id, embedding`` of every wanted ``id, sequence``; what the cache lacks is computed and appended in flushes."""
    cache = KeyValueCache(spark, cache_path, ["id"], "embedding", "array<float>")
    todo = wanted.join(cache.missing(wanted), "id").persist()
    try:
        flushes = -(-todo.count() // per_flush)
        part = F.pmod(F.xxhash64("id"), F.lit(max(1, flushes)))
        stamp = int(time.time() * 1000)
        for k in range(flushes):
            cache.add(embed(todo.where(part == k), encode, batch_size), stamp + k)
    finally:
        todo.unpersist()
    return wanted.select("id").distinct().join(cache.rows(), "id")


def attach(rows: DataFrame, embeddings: DataFrame, on: str = "uniprot_id") -> DataFrame:
    """``rows`` with ``embedding``; raises KeyError if a row has none."""
    out = rows.join(embeddings.withColumnRenamed("id", on), on, "left")
    if not (lost := out.where("embedding IS NULL").select(on).limit(5)).isEmpty():
        raise KeyError(f"no embedding of {[r[0] for r in lost.collect()]}")
    return out


def mean_pooled(states: DataFrame) -> DataFrame:
    """``id, embedding`` of ``id, states (array of vectors), mask``."""
    return states.select("id", E.mean_pool(F.col("states"), F.col("mask")).alias("embedding"))


def predict(rows: DataFrame, predictor: Callable[[list[str], list[list[float]]], list[list[str]]], batch_size: int = 16) -> DataFrame:
    """``row_id, predictions``: ranked candidates for ``row_id, reactant_smiles, embedding``, without white space."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                got = predictor(list(part["text"]), [list(e) for e in part["embedding"]])
                yield pd.DataFrame({"row_id": part["row_id"], "predictions": [["".join(p.split()) for p in g] for g in got]})

    given = rows.select("row_id", E.model_input(F.col("reactant_smiles")).alias("text"), "embedding")
    return given.mapInPandas(run, "row_id long, predictions array<string>")


def batch_padded(batched: DataFrame, column: str, value: int = -100) -> DataFrame:
    """Arrays of token ids, each padded to the ``width`` of its batch."""
    return batched.withColumn(column, F.concat(column, F.array_repeat(F.lit(value), F.greatest(F.col("width").cast("int") - F.size(column), F.lit(0)))))


def labels_padded(rows: DataFrame, column: str, value: int = -100) -> DataFrame:
    """Arrays of token ids, padded to the longest of the table."""
    most = rows.agg(F.max(F.size(column)).alias("n")).first()["n"] or 0
    return rows.withColumn(column, E.padded(F.col(column), most, value))
