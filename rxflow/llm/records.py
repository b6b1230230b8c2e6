"""Operator 5: token ids as length-delimited binary records, with an index of offsets.

A file is a run of records, each
    length of the payload (8 bytes), masked CRC of those 8 bytes (4),
    payload, masked CRC of the payload (4), a line feed (1);
all numbers are little-endian. A payload is doc_id (8), number of ids (8), bytes per
id (1, of which the highest bit marks a null doc_id), the ids. The index, a Parquet table beside the files, has a row
(file, doc_id, offset, length) for each record, so that shuffled readers can seek. Frames are written
by Spark's text writer, whose bytes are those given and whose line end is the last byte
of a record: thus files appear by Spark's commit protocol in whatever store Spark can
reach, and a lost executor leaves no half-written file.

Texts are encoded where they are read; only finished frames, a fraction of the texts, are put in order.

Defined cases: a null or empty text has only the end id, a very long one is a single record; doc_ids that repeat keep one
record each, in an order fixed by their frames, and may share several files; rows with a null doc_id come first;
other columns of the table are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxflow.llm import vocab
from rxflow.llm.common import input_bytes, map_arrow, shared_dir, table, texts, tune

_HEAD = struct.Struct("<QI")
_BODY = struct.Struct("<qQB")
_SUM = struct.Struct("<I")
END = b"\n"

#: In the byte that tells the width of an id: the record has no doc_id.
_NO_ID = 0x80

#: A file has records of about so many bytes of text; files are read whole.
FILE_BYTES = 16 << 20
#: Quantiles of doc_id that are asked for, at most.
QUANTILES = 10_000


def masked(data: bytes) -> int:
    """A CRC rotated by 15 bits plus a constant, so that sums of data that hold sums stay apart."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    """A record without its line feed."""
    body = _BODY.pack(doc_id or 0, len(ids), ids.dtype.itemsize | (_NO_ID if doc_id is None else 0)) + ids.tobytes()
    head = len(body).to_bytes(8, "little")
    return head + _SUM.pack(masked(head)) + body + _SUM.pack(masked(body))


def framed(ids: np.ndarray) -> int:
    """Bytes of the record of some ids."""
    return _HEAD.size + _BODY.size + ids.nbytes + 5


def unpack(data: bytes) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """Each record of a file: its offset, doc_id and ids. A broken one raises ValueError."""
    at = 0
    while at < len(data):
        if at + _HEAD.size > len(data):
            raise ValueError(f"cut record at {at}")
        size, check = _HEAD.unpack_from(data, at)
        if masked(data[at : at + 8]) != check:
            raise ValueError(f"wrong length at {at}")
        body = data[at + _HEAD.size : at + _HEAD.size + size]
        end = at + _HEAD.size + size
        if len(body) < size or data[end + 4 : end + 5] != END or _SUM.unpack_from(data, end)[0] != masked(body):
            raise ValueError(f"wrong payload at {at}")
        doc_id, n, width = _BODY.unpack_from(body)
        if width & _NO_ID:
            doc_id, width = None, width ^ _NO_ID
        ids = np.frombuffer(body, f"<u{width}", offset=_BODY.size)
        if len(ids) != n:
            raise ValueError(f"wrong number of ids at {at}")
        yield at, doc_id, ids
        at = end + 5


def bounds_of(docs: DataFrame, files: int) -> np.ndarray:
    """The doc_ids between files, by quantiles (QUANTILES at most, the rest between those) of doc_id alone, so that nothing else is read
    to find them. A doc_id that very many rows share is several bounds."""
    m = min(files, QUANTILES)
    cuts = [k / m for k in range(m + 1)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), cuts, 10 * m).alias("q")).first()["q"]
    if not found:
        return np.zeros(0, np.int64)
    if m == files:
        return np.array(found[1:-1], np.int64)
    return np.interp(np.arange(1, files) / files, cuts, np.array(found, np.float64)).astype(np.int64)


def file_of(doc_id: int | None, frame: bytes, bounds: np.ndarray) -> int:
    """The number of a record's file; of a doc_id that is several bounds, the records are dealt to all files between."""
    if doc_id is None:
        return 0
    first, last = np.searchsorted(bounds, doc_id, "left"), np.searchsorted(bounds, doc_id, "right")
    return int(first + zlib.crc32(frame) % (last - first + 1))


def write(docs: DataFrame, path: str, vocab_path: str, end_id: int = 0) -> DataFrame:
    """Write the ids of every text, in ascending doc_id order; read the files back and write the index; return it.

    The index also holds ``n_tokens``, ``ids_crc32`` and ``position`` of each record.
    """
    spark = docs.sparkSession
    tune(spark)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = vocab.words_of(vocab_path)
        end = np.array([end_id], cache.kind)
        ids = batch["doc_id"].to_pylist()
        frames = [pack(i, np.append(x, end)) for i, x in zip(ids, cache.encode_all(texts(batch["text"])))]
        places = [file_of(i, f, sent.value) for i, f in zip(ids, frames)]
        return pa.record_batch([pa.array(places, pa.int32()), batch["doc_id"], pa.array(frames, pa.binary())], ["file", "doc_id", "frame"])

    files = max(spark.sparkContext.defaultParallelism, -(-input_bytes(docs) // FILE_BYTES))
    sent = spark.sparkContext.broadcast(bounds_of(docs, files))
    framed = map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "file int, doc_id long, frame binary")
    framed = framed.repartitionById(files, F.col("file")).sortWithinPartitions("doc_id", F.crc32("frame"), "frame")
    framed.select(F.col("frame").cast("string")).write.text(f"{path}/data", lineSep=END.decode())
    index = read(spark, path)
    index.write.parquet(f"{path}/index")
    return spark.read.schema(index.schema).parquet(f"{path}/index")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the files: ``file, doc_id, offset, length, n_tokens, ids_crc32, position``.

    ``position`` is the number of ids before the record in its file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                seen, out = 0, []
                for at, doc_id, ids in unpack(data.as_py()):
                    out.append((name.as_py().rpartition("/")[2], doc_id, at, framed(ids), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), seen))
                    seen += len(ids)
                if out:
                    kinds = [pa.string()] + [pa.int64()] * 6
                    yield pa.record_batch(
                        [pa.array(x, k) for x, k in zip(zip(*out), kinds)],
                        ["file", "doc_id", "offset", "length", "n_tokens", "ids_crc32", "position"],
                    )

    tune(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data").select("path", "content")
    return files.mapInArrow(run, "file string, doc_id long, offset long, length long, n_tokens long, ids_crc32 long, position long")


def starts(records: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all records before; files are in order of the numbers in their names.

    Only one row for each file is summed in order.
    """
    number = F.regexp_extract("file", "part-([0-9]+)", 1).cast("long")
    files = records.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    before = files.select("file", (F.sum("in_file").over(Window.orderBy(number)) - F.col("in_file")).alias("before"))
    return records.join(before, "file").withColumn("start", F.col("before") + F.col("position"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write(table(spark, sf_dir, "documents"), shared_dir(spark), vocab.vocab_file("byte_bpe_50k.json"))
    return starts(index).select("doc_id", "start", "n_tokens", "ids_crc32")
