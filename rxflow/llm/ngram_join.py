"""Operator 7: joins documents whose sets of word shingles have a Jaccard similarity of at least 0.8.

1. Every text becomes its set of 64-bit shingle hashes. Equal sets are one class.
2. A set can only have a partner if 80 % of its shingles occur in another set, too. To
   count that, packed hashes are dealt by value (5 bytes each); only sets that pass go on.
3. Of those, two partners share a shingle among the rarest of each (the prefix filter).
   Sets tied by such shingles form families, found as connected components.
4. Within a family a count-vector R-tree finds the partners: shingles are hashed into
   groups, a set is the point of its group counts, and a box is skipped if the sum of the
   smaller coordinates can't reach the overlap that is needed. What survives is verified on
   the hashes. Pairs that are known to be tied already need no comparison.
5. A large family is cut into tiles of documents; each tile is joined with itself and the first
   tile. What this leaves outside of the family's main component is joined with all tiles.

No pairs of a group are listed: the result is a class and a component for each document,
and a link is an edge of a spanning forest. No stage limits the partners of a document.

Defined cases: a text without words has an empty set and stands alone, also a null one;
repeated rows get a row each; rows that share a doc_id share its component; very long texts are read whole; of equal sets
the smallest doc_id names the class; other columns are not read by ``classes`` and kept by ``one_of_each``; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxflow.llm.common import drop_keys, give_back, hold, input_bytes, keep_keys, map_arrow, stored, table, texts, tune
from rxflow.llm.graph import components

WORDS = 5
GROUPS = 64
#: Documents of a tile, and bytes of packed hashes of a part, about.
TILE, PART_BYTES = 512, 6 << 20
#: Shingles that a task deals to the parts at once; the more, the fewer rows there are for each part.
DEALT = 1 << 20

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Hashes of words; of more than a bounded number it starts anew."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return value


_hashes = _Hashes()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text."""
    hold("shingles", _hashes.clear)
    found = _WORD.findall(text.translate(_LOWER))
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    size = min(words, len(found))
    out = np.full(len(each) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out + each[k : len(each) - size + 1 + k]) * np.uint64(_ODD[k % 5])
    return np.unique(mix(out))


def signature(hashes: np.ndarray) -> tuple[int, int]:
    """Two sums that tell sets apart, as signed longs."""
    one = mix(hashes + np.uint64(_ODD[0])).sum(dtype=np.uint64)
    two = mix(hashes ^ np.uint64(_ODD[1])).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


#: Stands for the documents of a hash that several of a batch have.
_SEVERAL = np.uint32(2**32 - 1)


def _dealt(docs: DataFrame, parts: int) -> DataFrame:
    """For each batch of documents (of about DEALT shingles) and part of the hash values that it has: packed hashes with the document of each.

    A hash that several documents of a batch have is settled there, so each batch sends a hash once, however many documents have it; of one
    that is settled no document is named. Only parts with hashes have rows, so their number is bounded by the shingles. One row of each batch
    also tells the documents themselves, and how many of their hashes are settled.
    """

    def deal(ids: list, sets: list[np.ndarray], batch: int) -> Iterator[pa.RecordBatch]:
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        signs = np.array([signature(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        sets.clear()  # what is not needed any more goes at once: a batch has some 80 MB of arrays else
        order = np.argsort(every, kind="stable")  # parts are ranges of hashes
        every, doc = every[order], np.repeat(np.arange(len(sizes), dtype="<u4"), sizes)[order]
        first = np.flatnonzero(np.diff(every, prepend=~every[:1]))
        often = np.diff(first, append=len(every)) > 1
        here = np.bincount(doc[np.repeat(often, np.diff(first, append=len(every)))], minlength=len(sizes))
        every, doc = every[first], np.where(often, _SEVERAL, doc[first]).astype("<u4")
        del order, first, often
        part = ((every >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        packed = np.ascontiguousarray(every).view(np.uint8).reshape(-1, 8)[:, :5]
        starts = np.flatnonzero(np.diff(part, prepend=np.uint64(2**63)))
        cuts = list(zip(starts, [*starts[1:], len(part)])) or [(0, 0)]
        about = pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(signs[:, 0]), pa.array(signs[:, 1]), pa.array(here)], ["doc_id", "n", "a", "b", "here"])
        with pa.ipc.new_stream(sink := pa.BufferOutputStream(), about.schema) as w:
            w.write_batch(about)
        rows = {
            "part": pa.array(part[starts] if len(part) else [0], pa.int32()),
            "batch": pa.array([batch] * len(cuts), pa.int64()),
            "docs": pa.array([doc[x:y].tobytes() for x, y in cuts], pa.binary()),
            "hashes": pa.array([packed[x:y].tobytes() for x, y in cuts], pa.binary()),
            "about": pa.array([sink.getvalue().to_pybytes()] + [None] * (len(cuts) - 1), pa.binary()),
        }
        del every, doc, part, packed
        yield from pa.table(rows).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, ids, sets, n = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), texts(b["text"])):
                ids.append(doc_id)
                sets.append(shingles(text))
                n += len(sets[-1])
                if n >= DEALT:
                    yield from deal(ids, sets, batch)
                    give_back()
                    batch, ids, sets, n = batch + 1, [], [], 0
        if ids:
            yield from deal(ids, sets, batch)

    return docs.select("doc_id", "text").mapInArrow(run, "part int, batch long, docs binary, hashes binary, about binary")


def _shared(rows: pa.Table) -> pa.Table:
    """Of one part: for each batch, which documents have hashes that other documents have, too (one entry for each)."""
    hold("shingles", _hashes.clear)
    blobs = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, 5) for x in rows["hashes"]]
    ends = np.cumsum([0, *map(len, blobs)])
    wide = np.zeros((ends[-1], 8), np.uint8)
    for at, b in zip(ends, blobs):
        wide[at : at + len(b), :5] = b
    values = wide.view(np.uint64).ravel()
    order = np.argsort(values)
    ordered = values[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(values), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    named = [np.frombuffer(d.as_py(), "<u4") for d in rows["docs"]]
    out = [d[twice[x:y] & (d != _SEVERAL)].tobytes() for d, x, y in zip(named, ends[:-1], ends[1:])]
    found = pa.table({"batch": rows["batch"], "shared": pa.array(out, pa.binary()), "about": rows["about"]})
    return found.filter(pa.array([bool(o) or a is not None for o, a in zip(out, rows["about"].to_pylist())], pa.bool_()))


def _summed(rows: pa.Table) -> pa.Table:
    """Of one batch: each document with the number of its shared hashes, of all parts."""
    about = next(x for x in rows["about"].to_pylist() if x is not None)
    with pa.ipc.open_stream(about) as r:
        docs = r.read_all()
    hits = np.frombuffer(b"".join(rows["shared"].to_pylist()), "<u4").astype(np.int64)
    found = docs["here"].to_numpy() + np.bincount(hits, minlength=len(docs))
    return docs.drop_columns("here").append_column("shared", pa.array(found, pa.int64()))


def sets_of(docs: DataFrame) -> DataFrame:
    """``doc_id, n, a, b, shared``: size and signature of every set, and how many of its shingles occur
    in another document (never too few)."""
    tune(docs.sparkSession)
    parts = max(4, -(-input_bytes(docs) * 3 // 4 // PART_BYTES))
    rows = _dealt(docs, parts).groupBy("part").applyInArrow(_shared, "batch long, shared binary, about binary")
    return rows.groupBy("batch").applyInArrow(_summed, "doc_id long, n long, a long, b long, shared long")


def hashed(docs: DataFrame) -> DataFrame:
    """``doc_id, a, n, hashes`` of every text; hashes are sorted as unsigned numbers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in texts(batch["text"])]
        cols = [batch["doc_id"].cast(pa.int64()), pa.array([signature(s)[0] for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
        return pa.record_batch([*cols, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "a", "n", "hashes"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, a long, n long, hashes array<long>")


def prefixes(sets: DataFrame) -> DataFrame:
    """``doc_id, h``: the shingles by which a set can be tied to a partner.

    With n shingles, of which a partner has at least ceil(0.8 n), the n - ceil(0.8 n) + 1
    rarest hold a shared one. Those of a single document tie nothing.
    """
    each = sets.select("doc_id", "a", "n", F.explode("hashes").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    held = each.join(often, "h").groupBy("doc_id", "a", "n").agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("held"))
    short = F.expr("greatest(0L, n - (4 * n + 4) div 5 + 1 - (n - size(held)))").cast("int")
    return held.select("doc_id", F.explode(F.slice("held", F.lit(1), short)["h"]).alias("h"))


def families(sets: DataFrame) -> DataFrame:
    """``node, root``: documents that shingles of their prefixes tie together."""
    rows = stored(prefixes(sets))
    least = rows.groupBy("h").agg(F.min("doc_id").alias("v"), F.max("doc_id").alias("w")).where("v <> w")
    return components(rows.join(least.select("h", "v"), "h").select(F.col("doc_id").alias("u"), "v").distinct())


class Tree:
    """An R-tree over group counts. Boxes hold FANOUT points or boxes in a row, and know the largest count of each
    group and the range of sizes inside."""

    FANOUT = 12

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        slab = max(self.FANOUT, int(np.ceil(np.sqrt(len(order)))) * 4)
        wide = int(points.var(axis=0).argmax()) if len(points) else 0
        parts = [o[np.argsort(points[o, wide], kind="stable")] for o in (order[i : i + slab] for i in range(0, len(order), slab))]
        self.order = np.concatenate(parts) if parts else order
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > self.FANOUT:
            most, low, high = self.levels[-1]
            at = np.arange(0, len(most), self.FANOUT)
            self.levels.append((np.maximum.reduceat(most, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Points whose overlap with a point may suffice, the most promising first."""
        least = -(-4 * size // 5)
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            most, low, high = (x[at] for x in self.levels[depth])
            bound = np.minimum(most, point).sum(axis=1)
            small = np.maximum(low, least)
            fits = (9 * bound >= 4 * (size + small)) & (bound >= least) & (high >= least) & (4 * low <= 5 * size)
            at, bound = at[fits], bound[fits]
            if depth:
                below = len(self.levels[depth - 1][0])
                at = (at[:, None] * self.FANOUT + np.arange(self.FANOUT)).ravel()
                at = at[at < below]
        return self.order[at[np.argsort(-bound, kind="stable")]]


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= 80 * (len(x) + len(y) - both)


def tile_links(ids: list[int], sets: list[np.ndarray], tied: np.ndarray, asks: np.ndarray) -> list[tuple[int, int]]:
    """Links that tie the documents of a tile; ``asks`` marks those to be joined with all.

    tied: a number for each document, equal if they are known to be tied.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    group = [(s >> np.uint64(58)).astype(np.int64) for s in sets]
    points = np.stack([np.bincount(g, minlength=GROUPS) for g in group]).astype(np.int32)
    tree, tied, out = Tree(points, sizes), tied.copy(), []
    for i in np.flatnonzero(asks):
        found = tree.near(points[i], int(sizes[i]))
        found = found[tied[found] != tied[i]]
        while len(found):
            j, found = found[0], found[1:]
            if linked(sets[i], sets[j]):
                out.append((ids[i], ids[j]))
                tied[tied == tied[j]] = tied[i]
                found = found[tied[found] != tied[i]]
    return out


def _join(rows: pa.Table) -> pa.Table:
    ids = rows["doc_id"].to_pylist()
    sets = [np.asarray(x.values).view(np.uint64) for x in rows["hashes"]]
    tied = np.unique(rows["tied"].to_numpy(), return_inverse=True)[1]
    links = tile_links(ids, sets, tied, rows["asks"].to_numpy()) if len(ids) > 1 else []
    return pa.table({"u": pa.array([x[0] for x in links], pa.int64()), "v": pa.array([x[1] for x in links], pa.int64())})


def _tiles(n: str) -> str:
    return f"cast(ceil({n} / {TILE}) as int)"


def links(sets: DataFrame) -> DataFrame:
    """``u, v``: links that tie all documents which links of at least 0.8 tie. Stored."""
    family = families(sets)
    sizes = family.groupBy("root").agg(F.count("*").alias("m")).selectExpr("root", f"{_tiles('m')} as k")
    held = stored(family.join(sizes, "root").selectExpr("node as doc_id", "root", "k", "cast(pmod(xxhash64(node), k) as int) as tile"))
    first = held.selectExpr("doc_id", "root", "explode(if(tile = 0, sequence(0, k - 1), array(tile))) as i", "doc_id as tied", "true as asks")

    def joined(rows: DataFrame, key: list[str]) -> DataFrame:
        return stored(rows.join(sets.select("doc_id", "hashes"), "doc_id").groupBy(*key).applyInArrow(_join, "u long, v long"))

    found = joined(first, ["root", "i"])
    large = held.where("k > 1")
    if large.isEmpty():
        return found
    now = components(found)
    cur = stored(large.join(now.select(F.col("node").alias("doc_id"), F.col("root").alias("r")), "doc_id", "left").selectExpr("doc_id", "root", "k", "tile", "coalesce(r, doc_id) as tied"))
    main = cur.groupBy("root", "tied").count().groupBy("root").agg(F.max_by("tied", F.struct("count", F.col("tied"))).alias("main"))
    rest = cur.join(main, "root").where("tied <> main")
    parts = rest.groupBy("root").agg(F.count("*").alias("m")).selectExpr("root", f"{_tiles('m')} as kr")
    asks = rest.join(parts, "root").selectExpr("doc_id", "root", "cast(pmod(xxhash64(doc_id, 1), kr) as int) as r", "explode(sequence(0, k - 1)) as j", "tied", "true as asks")
    every = cur.join(parts, "root").selectExpr("doc_id", "root", "explode(sequence(0, kr - 1)) as r", "tile as j", "tied", "false as asks")
    return found.unionByName(joined(asks.unionByName(every), ["root", "r", "j"]))


def classes(docs: DataFrame) -> DataFrame:
    """Every row's ``doc_id``, ``n_shingles``, ``class_id`` (smallest doc_id with the same set), ``component_id`` and
    ``n_links``, the links of its class in the spanning forest."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = stored(sets_of(docs))
    same = stored(every.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("class_id"), F.max("shared").alias("shared")))
    able = stored(same.where("5 * shared >= 4 * n").select(F.col("class_id").alias("doc_id"), "a").distinct())
    texts_ = keep_keys(docs, stored(able.select("doc_id").distinct()), "doc_id")
    sets = stored(hashed(texts_).join(able, ["doc_id", "a"], "left_semi"))
    found = links(sets)
    tied = components(found)
    ends = found.select("u").unionByName(found.select(F.col("v").alias("u"))).groupBy("u").agg(F.count("*").alias("n_links"))
    tied = tied.join(ends, tied.node == ends.u, "left").select(F.col("node").alias("class_id"), F.col("root").alias("component_id"), "n_links")
    named = same.select("n", "a", "b", "class_id").join(tied, "class_id", "left")
    out = every.join(named, ["n", "a", "b"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "class_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which each stands for its component: that of the smallest doc_id.

    Of rows that share a doc_id the smallest stays; rows without doc_id stay.
    """
    named = stored(classes(docs).select("doc_id", "component_id"))
    gone = stored(named.where("doc_id <> component_id").select("doc_id").distinct())
    twice = stored(named.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    left = drop_keys(docs, gone, "doc_id")
    if twice.isEmpty():
        return left
    least = keep_keys(left, twice, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return drop_keys(left, twice, "doc_id").unionByName(least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: All pairs that share a shingle, and the closure of their links.
SQL = """
WITH RECURSIVE w AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) AS sh FROM w WHERE len(words) > 0),
z AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS k FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN z u ON u.doc_id = a JOIN z v ON v.doc_id = b WHERE 100 * k >= 80 * (u.n + v.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id
FROM w LEFT JOIN z ON z.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = w.doc_id
"""
