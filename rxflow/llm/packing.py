"""Operator 8: best-fit decreasing packing of documents into windows.

Overlong documents are first cut into full windows; what is left of each (1 to size - 1
ids) is placed by falling length into the open window with the smallest room that holds
it, found by a segment tree indexed by remaining capacity. The decisions depend on lengths
alone, so the driver plans over the histogram of lengths: ``count`` equal pieces and
windows of equal room are handled as one run, and neither the histogram nor the plan
grows with the corpus. Executors then look up where the k-th piece of a length goes.

Sequences of full windows have numbers above all others, which are not consecutive.

Defined cases: a null or empty text is one piece, the end id; a very long one is cut into as many windows as it needs;
copies are packed each; of pieces of equal length the one with the smaller doc_id and start comes first within a salted
part; an empty table gives an empty result; a document with a null doc_id keeps it; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxflow.llm import vocab
from rxflow.llm.common import map_arrow, stored, table, texts, tune

SIZE = 2048


class Rooms:
    """A segment tree over room sizes; it finds the smallest room in use of at least a size."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """Climb from the leaf to the first node on the right that is not empty, then descend."""
        i = least + self.size
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: Iterable[tuple[int, int]], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Where pieces go: rows (length, first rank, number, first window, offset).

    The pieces of ``length`` with the ranks first .. first + number - 1 go to as many
    windows in a row, each at ``offset``. counts: how many pieces have each length.
    """
    rooms = Rooms(size)
    runs: dict[int, list[tuple[int, int]]] = {}  # room: (first window, number)
    windows, out = 0, []

    def open_(room: int, first: int, n: int) -> None:
        if room:
            runs.setdefault(room, []).append((first, n))
            rooms.add(room, n)

    for length, count in sorted(counts, reverse=True):
        rank = 0
        while rank < count:
            room = rooms.tightest(length)
            if room is None:  # new windows, each filled with this length while it fits
                first, n, room = windows, None, size
            else:
                first, n = runs[room].pop()
                rooms.add(room, -n)
            # a piece makes its window the tightest, so that one is filled before the next is touched
            used = max(1, (count - rank) // (room // length))
            if n is None:
                windows += used
            else:
                used = min(n, used)
            out.append((length, rank, used, first, size - room))
            rank += used
            open_(room - length, first, used)
            if n is not None and used < n:
                open_(room, first + used, n - used)
    return out


def pieces(docs: DataFrame, vocab_path: str, size: int = SIZE, end_id: int = 1) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of the pieces of every document."""
    tune(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = vocab.words_of(vocab_path)
        end = np.array([end_id], cache.kind)
        out = []
        for doc_id, ids in zip(batch["doc_id"].to_pylist(), cache.encode_all(texts(batch["text"]))):
            ids = np.append(ids, end).astype("<u4")
            for at in range(0, len(ids), size):
                part = ids[at : at + size]
                out.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
        return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def ranked(rows: DataFrame, salts: int) -> DataFrame:
    """Adds ``rank``, from 0, among the pieces of equal length.

    A length may hold a third of all pieces, so ranks are counted within salted parts of
    a length, and each part starts where the parts before it end.
    """
    part = ["length", "part"]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    sums = rows.groupBy(*part).agg(F.count("*").alias("n"))
    before = sums.select(*part, (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    order = Window.partitionBy(*part).orderBy("doc_id", "start", "ids_crc32")
    return rows.withColumn("k", F.row_number().over(order) - 1).join(before, part).withColumn("rank", F.col("before") + F.col("k")).drop("k", "part", "before")


def pack(docs: DataFrame, vocab_path: str, size: int = SIZE, end_id: int = 1) -> DataFrame:
    """The pieces with ``sequence_id``, ``offset`` and ``padded_length`` of their sequence.

    Sequences are padded to ``size``, but those that hold a power of two stay as they are.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, vocab_path, size, end_id))
    counts = [tuple(r) for r in cut.where(F.col("length") < size).groupBy("length").agg(F.count("*")).collect()]  # size rows at most
    moves = plan(counts, size)
    steps = np.array(moves or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    keys = (steps[:, 0] << 44) + steps[:, 1]
    filled = fill_of(steps)
    sent = spark.sparkContext.broadcast((steps, keys, filled))
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        steps, keys, (edges, fills) = sent.value
        length, rank = (np.asarray(batch[x]) for x in ("length", "rank"))
        at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
        sequence = steps[at, 3] + rank - steps[at, 1]
        held = fills[np.searchsorted(edges, sequence, "right") - 1]
        padded = np.where(held & (held - 1) == 0, held, size)
        new = [pa.array(x, pa.int64()) for x in (sequence, steps[at, 4], padded)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        return pa.record_batch([*(batch[x] for x in names), *new], [*names, "sequence_id", "offset", "padded_length"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"
    rest = map_arrow(ranked(cut.where(F.col("length") < size), salts), run, schema)
    # a full window is a sequence by itself; the rows of a stored table keep their places, so their numbers do, too
    number = F.lit(int((steps[:, 3] + steps[:, 2]).max(initial=0))) + F.monotonically_increasing_id()
    full = cut.where(F.col("length") >= size).select("*", number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(size).cast("long").alias("padded_length"))
    return full.unionByName(rest)


def fill_of(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First windows of runs that are filled alike, and how far."""
    edges = np.unique(np.concatenate([steps[:, 3], steps[:, 3] + steps[:, 2]])) if len(steps) else np.zeros(1, np.int64)
    change = np.zeros(len(edges) + 1, np.int64)
    np.add.at(change, np.searchsorted(edges, steps[:, 3]), steps[:, 0])
    np.add.at(change, np.searchsorted(edges, steps[:, 3] + steps[:, 2]), -steps[:, 0])
    return edges, np.cumsum(change)[:-1]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocab.vocab_file("byte_bpe_50k.json")).drop("padded_length")
