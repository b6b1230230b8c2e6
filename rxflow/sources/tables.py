"""Files in and out: CSV, Parquet with splits, FASTA, TSV, JSON, key-value caches."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import tempfile
import uuid
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that a CSV reader of data frames takes as missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, encoding: str = "UTF-8", ordinal: str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV by a fixed schema. Quotes are doubled, not escaped by backslashes, which molecules contain.

    Fields named in the schema are found by the header in any order; those absent are null, others
    are not read. Missing-value texts become null. ``ordinal`` adds a column of row
    numbers in file order; use it for single files. Large files are split among tasks; only ``multi_line``, for fields that
    hold line feeds, reads each file in one task.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line, "encoding": encoding}
    head = spark.read.options(**options).csv(path).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in head])
    rows = spark.read.options(**options).schema(text).csv(path)
    if ordinal:
        rows = with_ordinal(rows, ordinal)

    def field(f: T.StructField) -> Column:
        if f.name not in head:
            return F.lit(None).cast(f.dataType).alias(f.name)
        raw = F.col(f"`{f.name}`")
        raw = F.when(~F.trim(raw).isin(*NA_TOKENS), raw)
        if isinstance(f.dataType, T.StringType):
            return raw.alias(f.name)
        if isinstance(f.dataType, (T.LongType, T.IntegerType)):
            return F.coalesce(raw.try_cast(f.dataType), raw.try_cast("double").try_cast(f.dataType)).alias(f.name)
        return raw.try_cast(f.dataType).alias(f.name)

    return rows.select(*map(field, schema.fields), *([ordinal] if ordinal else []))


def _shared_root(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Only a local master, whose tasks share the driver's disk, may do without one; it gets
    a temporary folder."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="rxflow-"))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the folder that the session names."""
    _shared_root(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A new folder there, removed when the session ends."""
    path = f"{_shared_root(spark).rstrip('/')}/rxflow-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The rows, as Parquet in such a folder: of narrow rows a fraction of what a checkpoint takes."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def with_ordinal(df: DataFrame, name: str) -> DataFrame:
    """Consecutive numbers from 0 in the order of partitions and of rows in them.

    The rows are checkpointed first: were they computed twice, ranges could be cut elsewhere the second
    time. Only one count for each partition reaches the driver.
    """
    spark = df.sparkSession
    tagged = durable(df.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    counts = {r["__part"]: r["n"] for r in tagged.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    starts = spark.createDataFrame(before, "__part int, __before long")
    at = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + at).drop("__part", "__row", "__before")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)


def read_reactions(spark: SparkSession, path: str, split: str | None = None, split_col: str = "split") -> DataFrame:
    """A processed table, or one of its splits; the filter reaches the Parquet scan."""
    df = spark.read.parquet(path)
    if split is None:
        return df
    if split_col not in df.columns:
        raise KeyError(f"no column {split_col}")
    return df.where(F.col(split_col) == split)


def read_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_reactions(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Overwrites; with a column, lays out a folder for each of its values, which later reads prune."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def fasta_records(text: Column) -> Column:
    """``array<struct<accession, sequence>>`` of a FASTA text, in its order; text before the first header is ignored."""
    entries = F.filter(F.transform(F.split(F.concat(F.lit("\n"), text), "\n>"), lambda e, i: F.when(i > 0, e)), lambda e: e.isNotNull())

    def record(entry: Column) -> Column:
        header = F.substring_index(entry, "\n", 1)
        pipes = F.split(header, r"\|")
        first = F.regexp_extract(header, r"^\s*(\S*)", 1)
        name = F.when(F.size(pipes) >= 2, F.get(pipes, F.lit(1))).otherwise(first)
        body = F.when(F.contains(entry, F.lit("\n")), F.regexp_replace(entry, r"^[^\n]*\n", "")).otherwise("")
        return F.struct(name.alias("accession"), F.regexp_replace(body, r"\s+", "").alias("sequence"))

    return F.transform(entries, record)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``accession, sequence`` of FASTA files, split at records; of an accession that repeats in a file the last counts."""
    chunks = spark.read.option("lineSep", "\n>").text(path).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    whole = F.when(F.col("value").startswith(">"), F.col("value")).otherwise(F.concat(F.lit(">"), F.col("value")))
    first = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) == 0
    rows = chunks.where((~first) | F.col("value").startswith(">")).select("file", "at", F.explode(fasta_records(whole)).alias("r"))
    return rows.groupBy("file", "r.accession").agg(F.max_by("r.sequence", "at").alias("sequence")).select("accession", "sequence")


def search_hits(tsv: Column) -> Column:
    """First fields of a one-column TSV answer, without its header and blank lines."""
    lines = F.filter(F.split(tsv, r"\r?\n"), lambda line: F.trim(line) != "")
    return F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda line: F.substring_index(line, "\t", 1))


def list_literal(cell: Column) -> Column:
    """``array<string>`` of a list written as text (``['A', 'B']``).

    Plain lists are read as JSON in the JVM; other literals (tuples, single values, trailing commas)
    by an Arrow function, which gets nulls in place of the other cells. What is no literal is an empty list.
    """
    from rxflow.functions.literals import parse_literal

    fast = F.from_json(F.when(F.startswith(F.ltrim(cell), F.lit("[")), cell), "array<string>", {"mode": "PERMISSIVE", "allowSingleQuotes": "true"})
    fast = F.when(~F.exists(fast, lambda x: x.isNull()) & ~F.regexp_like(cell, F.lit(r"\b(None|True|False)\b|\\|[0-9][eE.]")), fast)
    rest = F.when(fast.isNull() & cell.isNotNull(), cell)
    return F.coalesce(fast, F.when(rest.isNotNull(), parse_literal(rest)), F.array().cast("array<string>"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class KeyValueCache:
    """What was looked up, by key; a miss is kept with an empty value. Of a key that was added twice the later batch counts.

    The rows are dealt to buckets by their keys when they are added, one file a bucket and batch, with Bloom filters on the keys. So a look-up shuffles
    what it asks for and never what is cached. When a bucket has more than MOST_FILES files, its
    runs are merged into a new generation; that one counts once it is complete, and the one before it stays until the next. The cache may not exist yet.
    """

    BUCKETS, MOST_FILES = 16, 8

    def __init__(self, spark: SparkSession, path: str, keys: list[str], value: str, kind: str):
        self.spark, self.path, self.keys, self.value = spark, path.rstrip("/"), keys, value
        self.schema = ", ".join([*(f"`{k}` string" for k in keys), f"`{value}` {kind}", "batch long"])

    def _files(self, folder: str = "") -> list[Any]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}" if folder else self.path)
        store = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return list(store.listStatus(at)) if store.exists(at) else []

    def _generation(self) -> int:
        """The last complete one; 0 if there is none."""
        names = [f.getPath().getName() for f in self._files()]
        return max((int(n[6:]) for n in names if n.startswith("ready-")), default=0)

    def _ready(self, generation: int) -> None:
        save_json(self.spark, f"{self.path}/ready-{generation:06d}", {"generation": generation})

    def _table(self, generation: int) -> str:
        """The name of a generation's table in this session."""
        place = f"{self.path}/generation-{generation:06d}"
        name = f"rxflow_cache_{hashlib.md5(place.encode()).hexdigest()}"
        keys = ", ".join(f"`{k}`" for k in self.keys)
        options = ", ".join(f"'parquet.bloom.filter.enabled#{k}' 'true'" for k in self.keys)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({self.schema}) USING parquet OPTIONS ({options}) CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.BUCKETS} BUCKETS LOCATION '{place}'")
        self.spark.catalog.refreshTable(name)
        return name

    def _insert(self, rows: DataFrame, generation: int) -> None:
        columns = [f"`{c}`" for c in (*self.keys, self.value, "batch")]
        rows.select(*columns).repartition(self.BUCKETS, *(f"`{k}`" for k in self.keys)).write.insertInto(self._table(generation))

    def _latest(self, generation: int) -> DataFrame:
        last = F.max_by(F.struct("batch", F.col(f"`{self.value}`").alias("v")), "batch").alias("_last")
        return self.spark.table(self._table(generation)).groupBy(*(f"`{k}`" for k in self.keys)).agg(last).select(*(f"`{k}`" for k in self.keys), F.col("_last.v").alias(self.value), F.col("_last.batch").alias("batch"))

    def rows(self) -> DataFrame:
        if not (generation := self._generation()):
            return self.spark.createDataFrame([], self.schema).drop("batch")
        return self._latest(generation).drop("batch")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """Distinct wanted keys that were never looked up."""
        return wanted.select(*self.keys).distinct().join(self.rows(), self.keys, "left_anti")

    def add(self, found: DataFrame, batch: int) -> None:
        generation = self._generation() or 1
        self._insert(found.select(*self.keys, self.value).withColumn("batch", F.lit(batch).cast("long")), generation)
        if generation == 1:
            self._ready(1)
        if sum(f.getPath().getName().startswith("part-") for f in self._files(f"generation-{generation:06d}")) > self.MOST_FILES * self.BUCKETS:
            self.compact()

    def compact(self) -> None:
        """Merges the runs of the last generation into a new one, and removes those before it."""
        jvm, now = self.spark.sparkContext._jvm, self._generation()
        store = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        remove = lambda name: store.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
        remove(f"generation-{now + 1:06d}")  # of a merge that did not end
        self._insert(self._latest(now), now + 1)
        self._ready(now + 1)
        for f in self._files():
            name = f.getPath().getName()
            if int(name.rpartition("-")[2]) < now:
                remove(name)


def save_json(spark: SparkSession, path: str, value: Any) -> None:
    """The same as ``write_json``, to any store that Spark writes to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray((json.dumps(plain(value), indent=2, sort_keys=True) + "\n").encode()))
    finally:
        out.close()


def load_json(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


# ---- small files on the driver --------------------------------------------------------


def plain(value: Any) -> Any:
    """A value as dicts, lists and scalars that JSON can write: records by their fields, arrays by their items, paths as text."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {f.name: plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v) for v in value]
    if isinstance(value, (np.ndarray, np.generic)):
        return plain(value.tolist())
    return str(value) if isinstance(value, Path) else value


def write_json(path: str | Path, value: Any) -> Path:
    """Two blanks a level and sorted keys, so that equal values give equal files."""
    return write_text(path, json.dumps(plain(value), indent=2, sort_keys=True) + "\n")


def write_text(path: str | Path, text: str) -> Path:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)
    return target


def read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text())


def file_hash(path: str | Path) -> str:
    """SHA-256 of a file, read in pieces."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of files in any store; each is read by one task."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
