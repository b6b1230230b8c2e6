"""Operator 13: near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation of the leading principal components is learned over a bounded sample so that the signs of the rotated
coordinates lose as little as possible; cut at their medians, they give each vector a balanced binary code. The code is cut into
words, each the key of a table. A vector stands in each table under its own word, and knocks at those words
that differ in bits whose coordinates lie near the cut: the squared coordinates of the flipped bits must sum to the
``budget`` at most. For vectors of the wanted cosine that budget is what links all but one in 1,000 sample pairs of just that cosine, made
from sample vectors (nearer pairs are found more surely still); with ``exact`` it is the bound that no linked pair can exceed.

First only codes are dealt to tables: a vector is alive in a word if another vector there has a whole code within ``radius`` bits, with
one of the two at home. Then original vectors of the living are dealt to the same words and compared in double precision. A pair that meets under several words
counts under the first one. Words of many vectors are cut into tiles, and every two tiles are a group of their own, so no group exceeds twice TILE.
Groups return sums of links and a spanning forest, never pairs. Equal vectors are one vector with a number of copies.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing, nor do those of another length than the
most frequent one (the shortest of equal ones); each row is a vector of its own, also where rows share a vec_id; a null vec_id counts as the largest and a component of such
rows alone has a null id; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxflow.llm.common import map_arrow, stored, table, tune
from rxflow.llm.graph import components

COSINE = 0.9
#: Vectors that fit the rotation, and numbers that they have at most (32 MB).
SAMPLE, NUMBERS = 16384, 1 << 22
#: Bits of a code, rounds of the fit, pairs that set budget and radius, and the share of them that must be found.
BITS, ROUNDS, PAIRS, FOUND = 64, 40, 4096, 0.999
#: Vectors that share a word on average, and the shortest and longest words.
SHARE, SHORT, LONG = 256, 6, 14
#: Vectors of a word that are compared with each other in one group, with its equals.
TILE = 1024
#: Cosines this near the threshold are summed up again without rounding errors.
EDGE = 1e-9


@dataclass
class Coder:
    mean: np.ndarray
    rotation: np.ndarray  # dimensions x bits
    cut: np.ndarray  # medians
    width: int  # bits of a word
    budget: float = 0.0
    radius: int = BITS

    @property
    def tables(self) -> int:
        return max(1, len(self.cut) // self.width)

    def turned(self, units: np.ndarray) -> np.ndarray:
        """Rotated coordinates less their cuts, as they are kept."""
        return ((units - self.mean) @ self.rotation - self.cut).astype(np.float32)

    def words(self, z: np.ndarray) -> np.ndarray:
        """The word of each table; vectors x tables."""
        bits = (z[:, : self.tables * self.width] > 0).reshape(len(z), self.tables, self.width)
        return (bits << np.arange(self.width)).sum(axis=2)

    def energies(self, z: np.ndarray, flipped: np.ndarray) -> np.ndarray:
        """What the flipped bits of each table cost a vector; vectors x tables. Sums of whole numbers, so that every task gets the same."""
        cost = np.where(flipped, _cost(z), 0)[:, : self.tables * self.width]
        return cost.reshape(len(z), self.tables, self.width).sum(axis=2)

    @property
    def limit(self) -> int:
        return int(round(self.budget * _UNIT))


#: Costs are counted in units of 2^-40.
_UNIT = float(1 << 40)


def _cost(z: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(z.astype(np.float64) ** 2 * _UNIT), 1 << 50).astype(np.int64)


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever the size of their numbers."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(x: np.ndarray, rows: int, cosine: float = COSINE, exact: bool = False, seed: int = 5) -> Coder:
    """A coder for about ``rows`` vectors, learned from the unit vectors ``x``."""
    rng = np.random.default_rng(seed)
    dims = x.shape[1]
    bits = min(dims, BITS)
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    low = (x - mean) @ axes[:, ::-1][:, :bits]
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS):  # the nearest corners of the cube, then the rotation that brings the vectors nearest to them
        left, _, right = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
        turn = right.T @ left.T
    cut = np.median(low @ turn, axis=0)
    width = min(bits, LONG, max(SHORT, math.ceil(math.log2(max(rows, 1) / SHARE + 1))))
    coder = Coder(mean, axes[:, ::-1][:, :bits] @ turn, cut, width)
    if exact:  # squared distance of unit vectors; one side pays half of it at most, in one of the tables its part at most
        coder.budget = (2 - 2 * cosine) / 2 / coder.tables + 1e-6
        return coder
    a = x[rng.integers(0, len(x), PAIRS)]
    b = x[rng.integers(0, len(x), PAIRS)]  # partners lie towards other sample vectors
    side = b - (a * b).sum(axis=1, keepdims=True) * a
    size = np.sqrt((side**2).sum(axis=1, keepdims=True))
    good = size[:, 0] > 1e-6
    if not good.any():
        return coder
    a, side = a[good], side[good] / size[good]
    za, zb = coder.turned(a), coder.turned(cosine * a + math.sqrt(1 - cosine**2) * side)
    flipped = (za > 0) != (zb > 0)
    least = np.minimum(coder.energies(za, flipped), coder.energies(zb, flipped)).min(axis=1)
    coder.budget = float(np.quantile(least, FOUND, method="higher")) / _UNIT
    coder.radius = int(np.quantile(flipped.sum(axis=1), FOUND, method="higher"))
    return coder


def knocks(coder: Coder, z: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each table the vectors and the words that they stand or knock at, their own among them."""
    words, cost = coder.words(z), _cost(z)
    flips = (np.arange(1 << coder.width)[:, None] >> np.arange(coder.width)) & 1
    for t in range(coder.tables):
        each = cost[:, t * coder.width : (t + 1) * coder.width].astype(np.float64) @ flips.T  # whole numbers below 2^53
        who, mask = np.nonzero(each <= coder.limit)
        yield t, who, words[who, t] ^ mask


def _blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their ``tile`` and the pair of tiles ``i <= j`` that they meet in; words of one vector go."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("home").alias("some")).where("n > 1 AND some")
    rows = rows.join(F.broadcast(sizes.select(*by, F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))), by)  # 2^LONG words of a table at most
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return rows.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).drop("tiles", "other")


def _sides(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of the two tiles; the same for a tile with itself."""
    tile = block["tile"].to_numpy()
    return np.flatnonzero(tile == block["i"][0].as_py()), np.flatnonzero(tile == block["j"][0].as_py())


def _alive(block: pa.Table, radius: int) -> pa.Table:
    a, b = _sides(block)
    code, home, node = block["code"].to_numpy().view(np.uint64), np.asarray(block["home"]), block["node"].to_numpy()
    near = np.bitwise_count(code[a][:, None] ^ code[b][None, :]) <= radius
    near &= (home[a][:, None] | home[b][None, :]) & (node[a][:, None] != node[b][None, :])
    some = np.zeros(len(node), bool)
    some[a] |= near.any(axis=1)
    some[b] |= near.any(axis=0)
    return block.select(["t", "word", "node", "home"]).filter(pa.array(some))


def _cosines(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    out = x @ y.T
    for p, q in zip(*np.nonzero(np.abs(out - cosine) < EDGE), strict=True):
        out[p, q] = math.fsum(x[p] * y[q])
    return out


def _linked(block: pa.Table, coder: Coder, cosine: float) -> pa.Table:
    """``node, links, low``: copies of other vectors that a vector is linked with under this word first, and the smallest node of its part here."""
    a, b = _sides(block)
    node, home, copies = block["node"].to_numpy(), np.asarray(block["home"]), block["copies"].to_numpy()
    t, word = block["t"][0].as_py(), block["word"][0].as_py()
    x = units(np.stack([np.asarray(v, np.float64) for v in block["v"].to_numpy(zero_copy_only=False)]))
    z = np.frombuffer(b"".join(block["z"].to_pylist()), np.float32).reshape(len(node), -1)
    words = coder.words(z)[:, t]
    near = (_cosines(x[a], x[b], cosine) >= cosine) & (home[a][:, None] | home[b][None, :]) & (node[a][:, None] != node[b][None, :])
    if block["i"][0].as_py() == block["j"][0].as_py():
        near &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    p, q = (s[k] for s, k in zip((a, b), np.nonzero(near), strict=True))
    links, low = np.zeros(len(node), np.int64), np.arange(len(node))
    kept = np.zeros(len(p), bool)
    for s in range(0, len(p), 1 << 15):
        u, v = p[s : s + (1 << 15)], q[s : s + (1 << 15)]
        flipped = (z[u] > 0) != (z[v] > 0)
        eu, ev = coder.energies(z[u], flipped) <= coder.limit, coder.energies(z[v], flipped) <= coder.limit
        first = (eu | ev).argmax(axis=1) == t
        twice = eu[:, t] & ev[:, t]
        here = np.where(twice, np.minimum(words[u], words[v]) == word, True)
        kept[s : s + (1 << 15)] = first & here & (flipped.sum(axis=1) <= coder.radius)
    p, q = p[kept], q[kept]
    np.add.at(links, p, copies[q])
    np.add.at(links, q, copies[p])
    rank = np.argsort(np.argsort(node, kind="stable"), kind="stable")
    low = rank.copy()
    while len(p):
        was = low.copy()
        np.minimum.at(low, p, was[q])
        np.minimum.at(low, q, was[p])
        at = np.argsort(rank)  # node of each rank
        low = low[at[low]]
        if (low == was).all():
            break
    some = links > 0
    return pa.table({"node": pa.array(node[some]), "links": pa.array(links[some]), "low": pa.array(np.sort(node)[low][some])})


def vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, v`` of all rows, v null where a vector takes no part."""
    kind = dict(rows.dtypes)["embedding"]
    v = F.col("embedding").cast("array<float>" if kind == "array<float>" else "array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, v).alias("v")))
    most = rows.where("v IS NOT NULL").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.withColumn("v", F.when(F.size("v") == (most.d if most else 0), F.col("v")))


def near_duplicates(rows: DataFrame, cosine: float = COSINE, exact: bool = False) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding``.

    With ``exact`` no link is missed, at the cost of many more words to knock at; without, see above.
    """
    spark = rows.sparkSession
    tune(spark)
    rows = vectors(rows)
    same = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    order = [F.col("first").asc_nulls_last(), F.xxhash64("v")]
    different = stored(same.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()))
    n = different.count()
    if n > 1:
        dims = F.size("v")
        least = different.select(dims.alias("d")).first()["d"]
        some = different.orderBy(F.xxhash64("node")).limit(max(2, min(SAMPLE, NUMBERS // least))).select("v").toArrow()
        links, roots = _links(different, fit(units(np.array(some["v"].to_pylist(), np.float64)), n, cosine, exact), cosine)
    else:
        links = spark.createDataFrame([], "node long, links long")
        roots = spark.createDataFrame([], "node long, root long")
    found = different.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = found.join(different.select(F.col("node").alias("root"), F.col("first").alias("component_id")), "root")
    found = found.select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id").withColumn("h", F.xxhash64("v"))
    out = rows.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).join(found, ["h", "v"], "left")
    alone = F.col("v").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(different: DataFrame, coder: Coder, cosine: float) -> tuple[DataFrame, DataFrame]:
    """``node, links`` and ``node, root`` of the vectors that are linked."""
    sent = different.sparkSession.sparkContext.broadcast(coder)

    def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = units(np.asarray(batch["v"].flatten(), np.float64).reshape(batch.num_rows, -1))
        z = sent.value.turned(x)
        return pa.RecordBatch.from_arrays([batch["node"], batch["copies"], batch["v"], pa.array([r.tobytes() for r in z], pa.binary())], ["node", "copies", "v", "z"])

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = sent.value
        z = np.frombuffer(b"".join(batch["z"].to_pylist()), np.float32).reshape(batch.num_rows, -1)
        node, own = batch["node"].to_numpy(), coder.words(z)
        code = ((z > 0).astype(np.uint64) << np.arange(z.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
        parts = [(np.full(len(who), t), word, node[who], code[who], word == own[who, t]) for t, who, word in knocks(coder, z)]
        t, word, who, codes, home = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(word, pa.int32()), pa.array(who), pa.array(codes), pa.array(home)], ["t", "word", "node", "code", "home"])

    kind = dict(different.dtypes)["v"]
    turned = stored(map_arrow(different.select("node", "copies", "v"), turn, f"node long, copies long, v {kind}, z binary"))
    dealt = stored(map_arrow(turned.select("node", "z"), deal, "t int, word int, node long, code long, home boolean"))
    by = ["t", "word"]
    radius = coder.radius
    living = stored(_blocks(dealt, by).groupBy(*by, "i", "j").applyInArrow(lambda block: _alive(block, radius), "t int, word int, node long, home boolean").distinct())
    blocks = _blocks(living, by).join(turned, "node").groupBy(*by, "i", "j")
    linked = stored(blocks.applyInArrow(lambda block: _linked(block, sent.value, cosine), "node long, links long, low long"))
    roots = components(linked.where("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")))
    return linked.groupBy("node").agg(F.sum("links").alias("links")), roots


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS i, CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
fine AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
most AS (SELECT len(v) AS d FROM fine GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1),
u AS (SELECT i, vec_id, v FROM fine, most WHERE len(v) = d),
links AS (SELECT a.i AS i, b.i AS j, b.vec_id AS other FROM u a JOIN u b ON a.i <> b.i WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT i, j FROM links UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i),
least AS (SELECT r.i, min(e.vec_id) AS low FROM reach r JOIN e ON e.i = r.j GROUP BY r.i),
n AS (SELECT i, count(*) AS n_links FROM links GROUP BY i)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(least(vec_id, low), vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(least(vec_id, low), vec_id) AS kept
FROM e LEFT JOIN n USING (i) LEFT JOIN least USING (i)"""
