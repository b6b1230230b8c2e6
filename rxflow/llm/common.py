"""What the operators of this subpackage share: reading, shared storage, Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of an Arrow batch. Texts may be long, so batches are kept short: 256 texts of
#: 100 KB are 25 MB, which a Python worker holds easily.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20

#: Largest table, in rows, whose keys are broadcast; beyond it the same join shuffles.
BROADCAST_ROWS = 500_000


_in_use: list = []


def hold(owner: str, clear: Callable[[], object]) -> None:
    """Says that this Python process now works for ``owner``; what another one remembered is cleared.

    Workers are reused from stage to stage, and several operators' word tables would not fit together.
    """
    if not _in_use or _in_use[0] != owner:
        if _in_use:
            _in_use[1]()
            give_back()
        _in_use[:] = [owner, clear]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def give_back() -> None:
    """Memory that this process has freed goes back to the system, which the allocators else keep for later."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tune(spark: SparkSession) -> None:
    """Short Arrow batches, so that a batch of very long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder inside the one that driver and executors share.

    The folder is ``spark.checkpoint.dir``; only a local master, whose tasks share the driver's disk, may do without one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="rxflow-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/rxflow-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back.

    This cuts lineage: a lost executor costs the tasks that it ran, not the whole plan.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """About how many bytes the texts have: twice the files that ``df`` reads, or a count where it reads none."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    if paths:
        return 2 * sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def keep_keys(df: DataFrame, keys: DataFrame, on: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys`` (a stored table of distinct keys).

    The keys are broadcast only if they are counted to be ``most`` at most; more of
    them are joined by a shuffle.
    """
    keys = keys.select(on)
    side = F.broadcast(keys) if keys.count() <= most else keys.hint("merge")
    return df.join(side, on, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``df`` whose ``on`` is not in ``keys``, likewise; rows without a key stay."""
    keys = keys.select(on)
    side = F.broadcast(keys) if keys.count() <= most else keys.hint("merge")
    return df.join(side, on, "left_anti")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` of a function of one batch; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """The strings of a column; a null counts as an empty text."""
    return [x or "" for x in column.to_pylist()]
