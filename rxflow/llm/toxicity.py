"""Operator 3: toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models over the letters of words, one of toxic and one of
ordinary texts, share the continuation counts of their lower orders, so that what neither
class has seen in full is judged alike by both and only what a class has seen sets them
apart. A word's evidence is the difference of the two log-likelihoods. A text's features
are that difference over all its letters, the evidence of its strongest words, how many
words are strong and how much they have together, which also tells texts of many words that are each a
little toxic, and the number of words. A logistic curve, fitted on labelled texts which
the models have not seen, turns them into a score from 0 to 1.

The models count all labelled rows outside the held-out fold and the curve's; words and
grams are counted distributed, and the driver only holds the finished levels. The curve is fitted on a bounded sample: of each
class, the first ``sample`` by a hash of doc_id of a quarter of the rows. Every text is scored whole.

Defined cases: a null or empty text has no evidence and gets the score of that; a null
label is no label; a doc_id labelled twice counts by its larger label, and of texts that share a doc_id the smallest is learned
from; without labels of both classes every score is 0; repeated rows are scored each, very long texts whole; other columns
are kept as they are, but for those that the scores are named as; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from rxflow.llm.common import BROADCAST_ROWS, hold, map_arrow, stored, table, texts, tune

#: Labelled texts of each class that the curve is fitted on, at most.
SAMPLE = 3_000
#: Words whose grams are taken at once.
WORDS = 50_000
#: Words whose evidence a process remembers at most.
KNOWN_WORDS = 500_000
ORDER, SHARED = 6, 3
DISCOUNT = 0.75
THRESHOLD = 0.7
#: Evidence of a word, in nats, above which it counts as strong (three degrees), and how much of it counts at most.
STRONG, MOST = (2.0, 3.0, 4.0), 30.0
#: Ridge of the curve, by cross-validation over the curve's own labelled texts.
RIDGE = 0.3

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray, order: int) -> np.ndarray:
    x = x + np.uint64(order)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words as one array of letters, each after ORDER - 1 marks and before one; the
    places that a model predicts, and the word of each place."""
    pad = "\x02" * (ORDER - 1)
    flat = np.frombuffer("".join([pad + w + "\x03" for w in words]).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(word)) + (word + 1) * (ORDER - 1)
    return flat, at, word


def _grams(flat: np.ndarray, at: np.ndarray, most: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1 the hashes of the letters up to each place, and of its context."""
    total, context, power = np.zeros(len(flat), np.uint64), np.zeros(len(at), np.uint64), 1
    for n in range(most):
        total[n:] += (flat[: len(flat) - n] + np.uint64(1)) * np.uint64(power)
        power = power * _BASE % 2**64
        mixed = _mix(total, n + 1)
        yield mixed[at], context
        context = mixed[at - 1]


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


@dataclass
class Level:
    """One order of a model: by hash, the discounted share of a gram and the weight that its context leaves."""

    grams: np.ndarray
    shares: np.ndarray
    contexts: np.ndarray
    left: np.ndarray

    def up(self, gram: np.ndarray, context: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities of this order from those of the order below."""
        return _find(self.grams, self.shares, gram, 0.0) + _find(self.contexts, self.left, context, 1.0) * p

    @staticmethod
    def of(gram: np.ndarray, context: np.ndarray, count: np.ndarray) -> Level:
        """From distinct grams with their contexts and counts."""
        keys, of = np.unique(context, return_inverse=True)
        totals = np.bincount(of, count, len(keys))
        types = np.bincount(of, minlength=len(keys))
        order = np.argsort(gram)
        return Level(gram[order], ((count - DISCOUNT) / totals[of])[order], keys, DISCOUNT * types / totals)


def _counted(gram: np.ndarray, context: np.ndarray, weight: np.ndarray | None = None) -> Level:
    """The level of grams that stand in some places, each of a weight."""
    keys, first, of = np.unique(gram, return_index=True, return_inverse=True)
    return Level.of(keys, context[first], np.bincount(of, weight, len(keys)))


def _continued(grams: Iterator[tuple[np.ndarray, np.ndarray]], orders: range, top: np.ndarray | None = None) -> list[Level]:
    """Levels by continuation counts: in how many distinct longer grams a gram ends. top: the weights of the last one's places."""
    out: list[Level] = []
    last = None
    for n, (gram, context) in enumerate(grams, 1):
        if last is not None and n - 1 in orders:
            first = np.unique(gram, return_index=True)[1]
            out.append(_counted(last[0][first], last[1][first]))
        last = gram, context
    if top is not None:
        out.append(_counted(*last, top))
    return out


class Model:
    """The two models; ``shared`` holds the orders up to SHARED, ``own[c]`` those above of class c."""

    def __init__(self, counts: list[dict[str, int]]):
        every = sorted({*counts[0], *counts[1]})
        flat, at, _ = _letters(every)
        self.shared = _continued(_grams(flat, at, SHARED + 1), range(1, SHARED + 1))
        self.own = []
        for c in (0, 1):
            flat, at, word = _letters(list(counts[c]))
            times = np.fromiter(counts[c].values(), np.float64, len(counts[c]))[word]
            self.own.append(_continued(_grams(flat, at), range(SHARED + 1, ORDER), times))
        self._end()

    def _end(self) -> None:
        self.bottom = 1.0 / max(2, len(self.shared[0].grams) + 1)

    @classmethod
    def of(cls, shared: list[Level], own: list[list[Level]]) -> Model:
        model = cls.__new__(cls)
        model.shared, model.own = shared, own
        model._end()
        return model

    def evidence(self, words: list[str]) -> np.ndarray:
        """For each word, the toxic less the ordinary log-likelihood."""
        flat, at, word = _letters(words)
        p = np.full(len(at), self.bottom)
        both = [p, p]
        for n, (gram, context) in enumerate(_grams(flat, at), 1):
            if n <= SHARED:
                p = self.shared[n - 1].up(gram, context, p)
                both = [p, p]
            else:
                both = [self.own[c][n - SHARED - 1].up(gram, context, both[c]) for c in (0, 1)]
        return np.bincount(word, np.log(both[1] / both[0]), len(words))


class Scorer:
    """A model and its curve; it remembers the evidence of words."""

    def __init__(self, model: Model, weights: np.ndarray | None = None):
        self.model, self.weights = model, weights
        self.known: dict[str, float] = {}

    def features(self, batch: list[str]) -> np.ndarray:
        found = [_WORD.findall(t.lower()) for t in batch]
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        new = list({w for ws in found for w in ws if w not in known})
        for part in range(0, len(new), 20_000):
            known.update(zip(new[part : part + 20_000], self.model.evidence(new[part : part + 20_000]).tolist()))
        out = np.zeros((len(batch), 9))
        for row, ws in zip(out, found):
            if not ws:
                continue
            e = np.sort(np.fromiter((known[w] for w in ws), np.float64, len(ws)))
            letters = sum(map(len, ws)) + len(ws)
            top = np.minimum(e[:-11:-1], MOST) / 10
            strong = len(e) - np.searchsorted(e, STRONG, "right")
            more = np.maximum(e[len(e) - strong[0] :] - STRONG[0], 0.0).sum()
            row[:] = e.sum() / letters, top[0], top[:3].mean(), top.mean(), *np.log1p(strong), np.log1p(more), np.log1p(len(ws))
        return out

    def score(self, batch: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(batch))
        return sigmoid(self.features(batch) @ self.weights[:-1] + self.weights[-1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _places(c: int, words: list[str], n: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct grams of some words of a class: class (-1: shared), order, the longer gram that counts once, gram, context, weight."""
    flat, at, word = _letters(words)
    last = None
    for k, (gram, context) in enumerate(_grams(flat, at), 1):
        keys, first, of = np.unique(gram, return_index=True, return_inverse=True)
        if k > 1:  # the order below, by continuations
            yield (-1 if k - 1 <= SHARED else c), k - 1, keys, last[0][first], last[1][first], np.ones(len(keys))
        if k == ORDER:
            yield c, k, np.zeros(len(keys), np.uint64), keys, context[first], np.bincount(of, n[word], len(keys))
        last = gram, context


def _model(words: DataFrame) -> Model | None:
    """The models of ``toxic, word, n``, as ``Model`` makes them, with all counts distributed."""
    if words.select("toxic").distinct().count() < 2:
        return None
    schema = "c int, k int, longer long, gram long, context long, n double"
    names = ["c", "k", "longer", "gram", "context", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            toxic, n, every = t["toxic"].to_numpy(), t["n"].to_numpy().astype(float), t["word"].to_pylist()
            for c in (0, 1):
                at = np.flatnonzero(toxic == c)
                if len(at):
                    for kind, k, *cols, weight in _places(c, [every[i] for i in at], n[at]):
                        size = len(weight)
                        yield pa.record_batch([pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, k, np.int32)), *(pa.array(x.view(np.int64)) for x in cols), pa.array(weight)], names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= WORDS:
                yield from out()
                held = []
        if held:
            yield from out()

    places = words.mapInArrow(run, schema)
    each = places.groupBy("c", "k", "longer", "gram", "context").agg(F.when(F.first("k") == ORDER, F.sum("n")).otherwise(1.0).alias("n"))
    levels = stored(each.groupBy("c", "k", "gram", "context").agg(F.sum("n").alias("n")))

    def level(c: int, k: int) -> Level:
        t = levels.where((F.col("c") == c) & (F.col("k") == k)).select("gram", "context", "n").toArrow()
        gram, context = (np.ascontiguousarray(t[x].to_numpy()).view(np.uint64) for x in ("gram", "context"))
        return Level.of(gram, context, t["n"].to_numpy())

    shared = [level(-1, k) for k in range(1, SHARED + 1)]
    return Model.of(shared, [[level(c, k) for k in range(SHARED + 1, ORDER + 1)] for c in (0, 1)])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Learn from the labelled texts outside the held-out fold.

    Of each class, at most ``sample`` rows of a quarter make the curve and all others the models.
    """
    spark = docs.sparkSession
    tune(spark)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("h", F.xxhash64("doc_id"))
    quarter = known.where(F.pmod("h", F.lit(4)) == 0)
    parts = [quarter.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(sample) for c in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]).select("doc_id", F.lit(True).alias("curve")))  # 2 * sample rows at most
    known = known.join(chosen, "doc_id", "left").select("doc_id", "toxic", F.coalesce("curve", F.lit(False)).alias("curve"))
    often = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.count("*") > 1).alias("often"))
    known = stored(known.join(often, "doc_id"))
    side = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(side, "doc_id")
    again = rows.where("often").groupBy("doc_id", "toxic", "curve", "often").agg(F.min("text").alias("text"))  # no shuffle of texts but those
    rows = rows.where("not often").unionByName(again.select(rows.columns))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[tuple[int, str], int] = {}
        for t, c in zip(texts(batch["text"]), batch["toxic"].to_pylist()):
            for w in _WORD.findall(t.lower()):
                seen[c, w] = seen.get((c, w), 0) + 1
        cols = [[k[0] for k in seen], [k[1] for k in seen], list(seen.values())]
        return pa.record_batch([pa.array(x, k) for x, k in zip(cols, (pa.int32(), pa.string(), pa.int64()))], ["toxic", "word", "n"])

    words = map_arrow(rows.where(~F.col("curve")).select("text", "toxic"), count, "toxic int, word string, n long")
    model = _model(stored(words.groupBy("toxic", "word").agg(F.sum("n").alias("n"))))
    if model is None:
        return Scorer(None)
    held = rows.where("curve")
    sent = _sent(spark, model, None)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = scorer_of(sent).features(texts(batch["text"]))
        return pa.record_batch([pa.array(x.tolist(), pa.list_(pa.float64())), batch["toxic"]], ["x", "toxic"])

    got = map_arrow(held.select("text", "toxic"), measure, "x array<double>, toxic int").collect()
    if len({r.toxic for r in got}) < 2:
        return Scorer(None)
    x, y = np.array([r.x for r in got]), np.array([r.toxic for r in got], float)
    order = np.lexsort((*x.T, y))  # a fixed order of sums
    return Scorer(model, fit_curve(x[order], y[order]))


_scorers: dict[str, Scorer] = {}


def _sent(spark: SparkSession, model: Model | None, weights: np.ndarray | None):
    """A broadcast of a scorer, with a name of its own: values of other broadcasts may take its address later."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, model, weights))


def scorer_of(sent) -> Scorer:
    """The scorer of this process for a broadcast."""
    hold("toxicity", _scorers.clear)
    name, model, weights = sent.value
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(model, weights)
    return _scorers[name]


def score(docs: DataFrame, scorer: Scorer, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with its scores and verdicts; columns of these ``names`` are replaced."""
    tune(docs.sparkSession)
    docs = docs.drop(*names)
    sent = _sent(docs.sparkSession, scorer.model, scorer.weights)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = scorer_of(sent).score(texts(batch["text"]))
        return pa.record_batch(
            [*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())],
            [*batch.schema.names, *names],
        )

    fields = [*docs.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())]
    return map_arrow(docs, run, StructType(fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scorer = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, scorer).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
