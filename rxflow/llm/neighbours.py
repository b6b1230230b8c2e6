"""Operator 2: approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one of each codebook. Codebooks are
fitted on residuals, each to what the ones before it leave, over a bounded sample; every row is
then encoded by beam search and stored as one byte a codebook with the squared norm of its sum and
its distance from that sum. A query needs one table of its products with all codewords; the
distance to a row's sum is looked up from that table, the codes and the stored norm.

By the triangle inequality a row is no nearer than the distance to its sum less its own distance
from it. A row is left out only if that exceeds the k-th distance found so far; all others
are ranked by exact distances of the original vectors, in double precision. So the nearest rows are
found whatever the sample, the number of rows or their groups; a poor fit only costs time.

Queries are taken in blocks of a bounded number, each against all rows.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part;
nor do those of another length than the most frequent one; a vec_id that occurs more than once
counts once, by its nearest copy (as a query: by its smallest vector); fewer candidates than
``k`` are all returned; of equally near rows the smaller vec_id comes first; other columns are read only by the condition that
picks the queries; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxflow.llm.common import map_arrow, stored, table, tune

#: Codebooks, codewords of each, paths that the encoder follows, rows that fit them (by hash of vec_id).
BOOKS, WORDS, BEAM, SAMPLE = 16, 256, 4, 8192
#: Rows that a task ranks exactly at first, to have a k-th distance; what follows is bounded by error alone.
K, RERANK = 10, 500
#: Queries of a block: its tables take BOOKS * WORDS * 4 bytes each.
BLOCK = 1024
#: Rows that are encoded or scored at once; always as many, so that equal vectors meet equal sums.
ROWS = 1024
#: Pairs whose exact distances are taken at once.
PAIRS = 1 << 15


@dataclass
class Quantiser:
    books: np.ndarray  # (books, words, dimensions), float32

    def sums(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, m]].astype(np.float64) for m, book in enumerate(self.books))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared norms of the sums they stand for."""
        parts = [self._encode(np.vstack([p, np.zeros((ROWS - len(p), x.shape[1]), np.float32)])) for p in (x[i : i + ROWS] for i in range(0, len(x), ROWS))]
        if not parts:
            return np.zeros((0, len(self.books)), np.uint8), np.zeros(0, np.float32)
        codes = np.concatenate([p for p in parts])[: len(x)]
        return codes, (self.sums(codes) ** 2).sum(axis=1).astype(np.float32)

    def _encode(self, x: np.ndarray) -> np.ndarray:
        n, dims = x.shape
        left = x[:, None, :]  # what the codewords of each path leave
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            width = left.shape[1]
            loss = (book**2).sum(axis=1) - 2 * (left.reshape(-1, dims) @ book.T).reshape(n, width, -1)
            loss = (loss + (left**2).sum(axis=2)[:, :, None]).reshape(n, -1)
            keep = min(BEAM, loss.shape[1])
            best = np.argpartition(loss, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(loss, best, 1), axis=1, kind="stable"), 1)
            path, word = best // len(book), best % len(book)
            left = np.take_along_axis(left, path[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, path[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
        return codes[:, 0]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, books, words): -2 times the products with all codewords."""
        return -2 * np.einsum("qd,mwd->qmw", queries, self.books).astype(np.float32)


def _means(x: np.ndarray, words: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm; a codeword without rows moves to a random row."""
    centres = x[rng.permutation(len(x))[:words]]
    if len(centres) < words:
        centres = np.vstack([centres, np.zeros((words - len(centres), x.shape[1]), x.dtype)])
    for _ in range(rounds):
        near = ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        counts = np.bincount(near, minlength=words)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        empty = counts == 0
        sums[empty] = x[rng.integers(0, len(x), int(empty.sum()))]
        centres = sums / np.maximum(counts, 1)[:, None]
    return centres.astype(np.float32)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 6, seed: int = 7) -> Quantiser:
    rng, left, out = np.random.default_rng(seed), x.astype(np.float32), []
    for _ in range(books):
        book = _means(left, words, rounds, rng)
        left = left - book[((book**2).sum(axis=1) - 2 * left @ book.T).argmin(axis=1)]
        out.append(book)
    return Quantiser(np.stack(out))


def usable(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, v`` (doubles) of the rows that take part."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    first = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (first.d if first else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def encode(rows: DataFrame, quantiser: Quantiser) -> DataFrame:
    """``vec_id, v, codes, norm, error`` of every row of ``usable``; error is the distance of v from its sum."""
    sent = rows.sparkSession.sparkContext.broadcast(quantiser)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch["v"])
        codes, norms = sent.value.encode(x.astype(np.float32))
        error = np.sqrt(((x - sent.value.sums(codes)) ** 2).sum(axis=1))
        cols = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms, pa.float32()), pa.array(error, pa.float64())]
        return pa.record_batch([batch["vec_id"], batch["v"], *cols], ["vec_id", "v", "codes", "norm", "error"])

    return map_arrow(rows, run, "vec_id long, v array<double>, codes binary, norm float, error double")


class Best:
    """For each query the ``n`` distinct rows of the smallest score, of equal ones those of the smallest id."""

    def __init__(self, queries: int, n: int):
        self.n = n
        self.scores = [np.zeros(0)] * queries
        self.ids = [np.zeros(0, np.int64)] * queries
        self.limit = np.full(queries, np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of pairs, which come by ascending query."""
        near = scores <= self.limit[query]
        query, ids, scores = query[near], ids[near], scores[near]
        for part in np.split(np.arange(len(query)), np.flatnonzero(np.diff(query)) + 1):
            if not len(part):
                continue
            q = query[part[0]]
            s, i = np.concatenate([self.scores[q], scores[part]]), np.concatenate([self.ids[q], ids[part]])
            order = np.lexsort((i, s))
            s, i = s[order], i[order]
            first = np.sort(np.unique(i, return_index=True)[1])[: self.n]  # of a row's copies the nearest
            self.scores[q], self.ids[q] = s[first], i[first]
            if len(first) == self.n:
                self.limit[q] = s[first[-1]]


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of pairs, summed from the first component to the last."""
    return np.sqrt(np.cumsum((a - b) ** 2, axis=1)[:, -1])


def _scan(coded: DataFrame, ids: np.ndarray, vectors: np.ndarray, quantiser: Quantiser, k: int, rerank: int) -> DataFrame:
    """``query_id, vec_id, score``: of each partition, the nearest rows of each query of a block."""
    sizes = (vectors**2).sum(axis=1)
    longest = float(np.sqrt((quantiser.books.astype(np.float64) ** 2).sum(axis=2)).max(axis=1).sum())
    rounding = 2.4e-7 * (vectors.shape[1] + 64)  # of sums in single precision, as a part of what is summed
    sent = coded.sparkSession.sparkContext.broadcast((ids, vectors, sizes, quantiser.tables(vectors), longest, rounding))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, sizes, tables, longest, rounding = sent.value
        best = Best(len(ids), k)
        slack = rounding * (np.sqrt(sizes) + longest) ** 2

        def rank(chosen: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
            query, row = np.nonzero(chosen)
            for at in range(0, len(query), PAIRS):
                q, r = query[at : at + PAIRS], row[at : at + PAIRS]
                best.add(q, rows[r], _exact(vectors[q], x[r]))

        def look(held: list[pa.RecordBatch], first: bool) -> None:
            part = pa.Table.from_batches(held).combine_chunks()
            rows, x, error = part["vec_id"].to_numpy(), _matrix(part["v"]), part["error"].to_numpy()
            codes = np.frombuffer(b"".join(part["codes"].to_pylist()), np.uint8).reshape(len(rows), -1)
            near = np.repeat(part["norm"].to_numpy()[None, :], len(ids), 0)
            for m in range(codes.shape[1]):
                near += tables[:, m, codes[:, m]]
            left = ids[:, None] != rows[None, :]
            if first:
                few = np.zeros_like(left)
                np.put_along_axis(few, np.argpartition(near, min(rerank, len(rows)) - 1, axis=1)[:, :rerank], True, 1)
                rank(few & left, rows, x)
                left &= ~few
            least = near + (sizes - slack)[:, None]  # squared distance to the sums, at least
            rank(left & ~(least > (best.limit[:, None] + error[None, :]) ** 2 * (1 + 1e-9)), rows, x)

        held: list[pa.RecordBatch] = []
        first, n = True, 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= ROWS:
                look(held, first)
                held, n, first = [], 0, False
        if n:
            look(held, first)
        for q, (i, s) in enumerate(zip(best.ids, best.scores)):
            if len(i):
                yield pa.record_batch([pa.array([int(ids[q])] * len(i), pa.int64()), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])

    return coded.select("vec_id", "v", "codes", "norm", "error").mapInArrow(run, "query_id long, vec_id long, score double")


def search(rows: DataFrame, queries: Column, k: int = K, rerank: int = RERANK, sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows of every row that ``queries`` picks."""
    spark = rows.sparkSession
    tune(spark)
    every = usable(rows)
    some = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()  # a bounded sample
    schema = "query_id long, rank int, vec_id long, score double"
    if not some.num_rows:
        return spark.createDataFrame([], schema)
    coded = stored(encode(every, quantiser := fit(_matrix(some["v"]))))
    asked = stored(coded.where(queries).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id"))
    last, out = None, None
    while True:  # each block is a bounded number of queries
        block = (asked if last is None else asked.where(F.col("vec_id") > last)).orderBy("vec_id").limit(BLOCK).toArrow()
        if not block.num_rows:
            break
        ids = block["vec_id"].to_numpy()
        last = int(ids[-1])
        found = _scan(coded, ids, _matrix(block["v"]), quantiser, k, rerank).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        best = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], schema) if out is None else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: All distances of every query, in the arithmetic of ``_exact``.
SQL = """
WITH e AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
fit AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
most AS (SELECT len(v) AS d FROM fit GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1),
u AS (SELECT fit.* FROM fit, most WHERE len(v) = d),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)) AS score FROM u q JOIN u c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10
"""
