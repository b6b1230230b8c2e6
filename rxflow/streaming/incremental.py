"""Incremental builds: new raw rows arrive as a stream and are merged batch by batch.

This goes beyond the batch engine: the same functions run on each micro-batch. ``build_stream`` compares a batch with all that was written, and writes it under
its own number, so one that is replayed after a failure replaces itself. ``build_stream_by_state`` remembers the keys
that it has seen in a state store instead, so that a batch costs what it holds, however long the stream has run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from rxflow.functions.backends import Backend
from rxflow.operators import build
from rxflow.sources.tables import exists


def build_stream(raw: DataFrame, path: str, checkpoint: str, of: Backend | None = None, max_tokens: int = 300, once: bool = True) -> StreamingQuery:
    """Appends the reactions of each batch of a raw stream (with ``ord``) that earlier batches lack; see ``read_stream_table``."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _, rows = build.build_reactions(build.load_records(batch), ["ord"], max_tokens, "stream", extra_cols=["ec_num", "organism"], dedup_extra_cols=["ec_num"], of=of)
        new = rows.where("status = 'out'").select("reactant_smiles", "product_smiles", "ec_num", "organism", "ord")
        if exists(spark, path):
            old = spark.read.parquet(path).where(F.col("batch") < number)
            new = new.join(old.select("reactant_smiles", "product_smiles", "ec_num"), ["reactant_smiles", "product_smiles", "ec_num"], "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: The state store that keeps keys on disk.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstOfKey(StatefulProcessor):
    """Of each key the first row of the first batch that has it; a key is forgotten after ``ttl_ms`` (never, if None)."""

    def __init__(self, order: str, ttl_ms: int | None = None):
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = None
        for row in rows:  # one row is held, however many a key has
            at = row[self.order]
            if first is None or (at is not None and (first[self.order] is None or at < first[self.order])):
                first = row
        if first is not None and not self.seen.exists():
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def first_of_stream(rows: DataFrame, keys: Sequence[str], order: str, ttl_ms: int | None = None) -> DataFrame:
    """A stream's rows, each key once: the first by ``order`` of the batch in which it comes up. Nulls are a key, too."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return rows.groupBy(*keys).transformWithState(FirstOfKey(order, ttl_ms), rows.schema, "Append", "ProcessingTime" if ttl_ms else "None")


def build_stream_by_state(raw: DataFrame, path: str, checkpoint: str, max_tokens: int = 300, ttl_ms: int | None = None, once: bool = True) -> StreamingQuery:
    """Appends the reactions of a raw stream (with ``ord``) whose key has not come up before, exactly once, also after a restart.

    Sides are taken as they are (the native backend), since others need joins that a stream can't have. With a time to live a
    query always has another batch to run, as keys may expire, so it doesn't end by itself.
    """
    if ttl_ms and once:
        raise ValueError("a query whose keys expire does not end by itself; start it with once=False")
    rows = build.judged(build.load_records(raw), ["ord"], max_tokens).where("first_status = 'out'")
    rows = rows.select("reactant_smiles", "product_smiles", "ec_num", "organism", "ord")
    first = first_of_stream(rows, ["reactant_smiles", "product_smiles", "ec_num"], "ord", ttl_ms)
    writer = first.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_stream_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by window and type; rows that come later than ``late`` are left out of a stream."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
