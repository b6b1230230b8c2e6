import time

import pytest
from pyspark.sql import functions as F

from rxflow.operators import build
from rxflow.streaming import incremental

RAW = "unmapped string, rxn_idx long, ec_num string, organism string, source string, quality double, natural boolean, steps string, ord long"


def raw(spark, rows):
    """Raw rows of (reaction, class, ord)."""
    return spark.createDataFrame([(r, o, ec, "o", "d", 1.0, True, "single", o) for r, ec, o in rows], RAW)


@pytest.fixture()
def folders(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")


def feed(spark, rows, folder, name):
    raw(spark, rows).coalesce(1).write.parquet(f"{folder}/{name}")


def go(spark, folders, **options):
    source, out, checkpoint = folders
    stream = spark.readStream.schema(RAW).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(source)
    query = incremental.build_stream_by_state(stream, out, checkpoint, **options)
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(out).select("reactant_smiles", "product_smiles", "ec_num", "ord").collect())


def test_each_key_once_over_batches_and_restarts(spark, folders):
    feed(spark, [("A>>B", "1", 5), ("A>>B", "1", 2), ("A>>A", "1", 0), ("broken", "1", 1), ("C>>D", "1", 3)], folders[0], "a")
    assert go(spark, folders) == [("A", "B", "1", 2), ("C", "D", "1", 3)]
    feed(spark, [("A>>B", "1", 7), ("A>>B", "2", 8), ("A>>B", None, 9), ("A>>B", None, 10)], folders[0], "b")
    feed(spark, [("E>>F", "1", 11), ("C>>D", "1", 1)], folders[0], "c")
    want = [("A", "B", "1", 2), ("A", "B", "2", 8), ("A", "B", "nan", 9), ("C", "D", "1", 3), ("E", "F", "1", 11)]
    assert go(spark, folders) == want  # a restart: the state is that of the checkpoint
    assert go(spark, folders) == want


def test_one_batch_equals_the_batch_build(spark, folders):
    rows = [(f"A{i * 7 % 13}>>B{i % 5}", str(i % 3), i) for i in range(300)]
    feed(spark, rows, folders[0], "a")
    out, _ = build.build_reactions(build.load_records(raw(spark, rows)), ["ord"], extra_cols=["ec_num", "ord"], dedup_extra_cols=["ec_num"])
    assert go(spark, folders) == sorted(tuple(r) for r in out.select("reactant_smiles", "product_smiles", "ec_num", "ord").collect())


def test_batches_do_not_read_what_was_written(spark, folders):
    """The cost of a batch is that of its own rows: nothing in its plan reads the output."""
    feed(spark, [("A>>B", "1", 1)], folders[0], "a")
    go(spark, folders)
    feed(spark, [("A>>B", "1", 2)], folders[0], "b")
    stream = spark.readStream.schema(RAW).option("recursiveFileLookup", "true").parquet(folders[0])
    query = incremental.build_stream_by_state(stream, folders[1], folders[2])
    query.awaitTermination()
    last = query.lastProgress
    assert last["numInputRows"] == 1 and last["stateOperators"][0]["numRowsTotal"] >= 1
    assert "RocksDB" in str(last["stateOperators"][0]["customMetrics"]) or any("rocksdb" in k.lower() for k in last["stateOperators"][0]["customMetrics"])


def test_keys_are_forgotten_after_their_time(spark, folders):
    source, out, checkpoint = folders
    stream = lambda: spark.readStream.schema(RAW).option("recursiveFileLookup", "true").parquet(source)
    for n, name in enumerate("ab", 1):
        feed(spark, [("A>>B", "1", n)], source, name)
        query = incremental.build_stream_by_state(stream(), out, checkpoint, ttl_ms=1, once=False)
        until = time.monotonic() + 60
        while time.monotonic() < until and not any(p["numInputRows"] for p in query.recentProgress):
            time.sleep(0.2)
        query.stop()
        assert spark.read.parquet(out).count() == n
    with pytest.raises(ValueError):
        incremental.build_stream_by_state(stream(), out, checkpoint, ttl_ms=1)


def test_windows_leave_out_late_rows(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 05:00:00", "a", 2.0)], "t string, event_type string, value double").select(F.col("t").cast("timestamp").alias("ts"), "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    run = lambda: (
        incremental.windowed_counts(spark.readStream.schema(events.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")))
        .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    )
    run()
    late = events.select(F.to_timestamp(F.lit("2024-01-01 00:20:00")).alias("ts"), "event_type", "value").limit(1)
    late.coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    run()
    done = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(str(r["start"]), r["n"]) for r in done] == [("2024-01-01 00:00:00", 1)]  # the later row of that hour came too late
