"""Operator 12: a Merkle manifest of a table of documents, with proofs by the preimages of parents.

Each row is a leaf, the leaves of a language form a tree in the order of doc_id, and the roots of the languages
form the tree above. A parent is kept as its *preimage*, the hashes of its children one after the other, so one string
serves both directions: a child cuts its own 64 characters out and has its siblings, or puts
another hash there and has what its parent would become.

Preimages are stored by blocks: the six levels above 64 neighbours are one row of arrays, and the tops of
the blocks are the nodes of the next tier. So a tree of n leaves takes log64(n) rounds, no group has more than
64 members however large a language is, and no step needs a Python worker.

Defined cases: a null in any column is hashed as ``-``, an empty text as ``0:``; a null language is a language of its own that stands first, a null
doc_id stands before all others and is never tampered with; rows with the same doc_id stand in the order of their hashes (equal rows are leaves each);
a table of one row is its own root, with the hash of nothing as its proof; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxflow.llm.common import BROADCAST_ROWS, stored, table
from rxflow.operators.build import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a tier, and so the binary logarithm of how many neighbours are one block.
LEVELS = 6
#: Characters of a hash.
WIDTH = 64
#: One row in so many is tampered with by ``altered``.
EVERY = 7


def leaf(**instead: Column) -> Column:
    """The hash of a row's fields, each as its UTF-8 length, a colon and its value; ``instead`` replaces some."""

    def field(name: str) -> Column:
        value = instead.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def altered() -> Column:
    """The hash of a row after ``n_chars`` has grown by 1, for those that are tampered with; else null."""
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % EVERY == 0) & F.col("n_chars").isNotNull()
    return F.when(hit, leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + F.lit(1)))


def _depth(n: Column) -> Column:
    """Levels above n nodes of which each two have a parent: the logarithm, rounded up."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def placed(rows: DataFrame) -> DataFrame:
    """``tree, depth, pos`` for rows of ``lang, doc_id, hash, other``: each language a tree, numbered from 0 by doc_id.

    Rows are sorted by ranges, and the runs of a language in each range are counted; ``tree`` is the place of its first row,
    so trees have the order of languages. Nothing but the counts of runs is ever grouped by language.
    """
    by = ("lang", "doc_id", "hash")
    rows = stored(stored(rows).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    rows = rows.withColumn("part", F.shiftright("at", 33))
    each = stored(rows.groupBy("lang", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    whole = Window.partitionBy("lang")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = each.select(F.col("lang").alias("_lang"), F.col("part").alias("_part"), "first", F.coalesce(before, F.lit(0)).alias("before"), F.min("first").over(whole).alias("tree"), _depth(F.sum("n").over(whole)).alias("depth"))
    side = F.broadcast(runs) if each.count() <= BROADCAST_ROWS else runs.hint("merge")
    found = rows.join(side, rows["lang"].eqNullSafe(F.col("_lang")) & (F.col("part") == F.col("_part")))
    return found.select("tree", "depth", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "hash", "doc_id", "other")


def _pairs(hashes: Column) -> Column:
    """Each two hashes in one string; an odd last one alone."""
    starts = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / 2).cast("int"))
    return F.transform(starts, lambda i: F.concat(F.get(hashes, 2 * i), F.coalesce(F.get(hashes, 2 * i + 1), F.lit(""))))


def _blocks(nodes: DataFrame, tier: int) -> DataFrame:
    """One row for each 2^LEVELS neighbours: ``held`` (the nodes), ``p1``... (preimages of each level above them) and ``top``."""
    held = F.sort_array(F.collect_list(F.struct("pos", *(c for c in nodes.columns if c not in ("tree", "depth", "pos")))))
    out = nodes.groupBy("tree", "depth", F.shiftright("pos", LEVELS).alias("block")).agg(held.alias("held")).withColumn("h0", F.col("held.hash"))
    for j in range(1, LEVELS + 1):
        below = F.col(f"h{j - 1}")
        there = F.col("depth") >= tier * LEVELS + j
        out = out.withColumn(f"p{j}", F.when(there, _pairs(below)))
        out = out.withColumn(f"h{j}", F.when(there, F.transform(f"p{j}", lambda p: F.sha2(p, 256))).otherwise(below))
    return out.select("tree", "depth", "block", "held", *(f"p{j}" for j in range(1, LEVELS + 1)), F.get(f"h{LEVELS}", F.lit(0)).alias("top"))


def grow(nodes: DataFrame) -> list[DataFrame]:
    """The stored tiers of the trees of ``tree, depth, pos, hash, ...``, lowest first."""
    tiers: list[DataFrame] = []
    deepest = None
    while deepest is None or len(tiers) * LEVELS < deepest:
        tiers.append(stored(_blocks(nodes, len(tiers))))
        if deepest is None:
            deepest = tiers[0].agg(F.max("depth")).first()[0] or 0
        nodes = tiers[-1].where(F.col("depth") > len(tiers) * LEVELS).select("tree", "depth", F.col("block").alias("pos"), F.col("top").alias("hash"))
    return tiers


def _ends(tiers: list[DataFrame]) -> list[DataFrame]:
    """Of each tier the blocks that are a whole tree's top."""
    return [t.where(F.col("depth") <= (k + 1) * LEVELS) for k, t in enumerate(tiers)]


def _steps(blocks: DataFrame) -> DataFrame:
    """``pos`` and ``path`` of each node: the preimages of its ancestors with its place in each, lowest first, then ``above``."""
    out = blocks.select("tree", "above", "subroot", *(f"p{j}" for j in range(1, LEVELS + 1)), F.posexplode("held").alias("i", "node"))

    def step(j: int) -> Column:
        place = F.shiftright("i", j - 1).bitwiseAND(1)
        return F.when(F.col(f"p{j}").isNotNull(), F.struct(F.get(f"p{j}", F.shiftright("i", j)).alias("preimage"), (place * WIDTH + 1).alias("at")))

    path = F.concat(F.filter(F.array(*(step(j) for j in range(1, LEVELS + 1))), lambda s: s.isNotNull()), "above")
    return out.select("tree", "subroot", "node", path.alias("path"))


def _descend(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``tree, subroot, node, path`` of every node of the lowest tier; tops: ``tree, subroot, above`` of each tree."""
    below = None
    for k in range(len(tiers) - 1, -1, -1):
        ends = _ends(tiers)[k].select("tree", "block").join(tops, "tree")
        if below is not None:
            ends = ends.unionByName(below.select("tree", F.col("node.pos").alias("block"), "subroot", F.col("path").alias("above")))
        below = _steps(tiers[k].join(ends, ["tree", "block"]))
    return below


def _excised(step: Column) -> Column:
    return F.overlay(step["preimage"], F.lit(""), step["at"], F.lit(WIDTH))


def _spliced(own: Column, step: Column) -> Column:
    return F.sha2(F.overlay(step["preimage"], own, step["at"], F.lit(WIDTH)), 256)


class Manifest:
    """The trees of a table of documents, as stored tables of preimages."""

    def __init__(self, docs: DataFrame, other: Column | None = None):
        """``other`` is a hash to fold in place of a row's own; null where there is none."""
        hashed = docs.select("lang", "doc_id", leaf().alias("hash"), (F.lit(None).cast("string") if other is None else other).alias("other"))
        self.tiers = grow(placed(hashed))
        ends = reduce(DataFrame.unionByName, [e.select("tree", F.col("top").alias("hash")) for e in _ends(self.tiers)])
        tops = stored(numbered(ends, ["tree"], "pos"))
        depth = _depth(F.lit(tops.count()))
        self.above = grow(tops.select(F.lit(0).cast("long").alias("tree"), depth.alias("depth"), "pos", "hash", F.col("tree").alias("of")))
        last = self.above[-1].select("top").first()
        #: The hash of the whole table; none of an empty one.
        self.root = last[0] if last else None

    def preimages(self) -> DataFrame:
        """``tree, level, index, preimage`` of every parent; tree is null above the languages."""
        out = [
            tier.where(f"p{j} IS NOT NULL").select(
                (F.col("tree") if kind == 0 else F.lit(None).cast("long")).alias("tree"),
                F.lit(k * LEVELS + j).alias("level"),
                F.posexplode(f"p{j}").alias("i", "preimage"),
                (F.col("block") * (1 << (LEVELS - j))).alias("start"),
            )
            for kind, tiers in enumerate((self.tiers, self.above))
            for k, tier in enumerate(tiers)
            for j in range(1, LEVELS + 1)
        ]
        return reduce(DataFrame.unionByName, out).select("tree", "level", (F.col("start") + F.col("i")).alias("index"), "preimage")

    def paths(self) -> DataFrame:
        """``doc_id, leaf, other, subroot, path`` of every row."""
        top = self.above[-1].limit(0).select(F.lit(0).cast("long").alias("tree"), F.lit("").alias("subroot"), F.array(F.struct(F.lit("").alias("preimage"), F.lit(0).alias("at"))).alias("above"))
        spark = top.sparkSession
        one = spark.createDataFrame([(0, "", [])], top.schema)
        languages = _descend(self.above, one).select(F.col("node.of").alias("tree"), F.col("node.hash").alias("subroot"), F.col("path").alias("above"))
        found = _descend(self.tiers, stored(languages))
        return found.select("node.doc_id", F.col("node.hash").alias("leaf"), "node.other", "subroot", "path")

    def proofs(self) -> DataFrame:
        """``doc_id, leaf, subroot, root, siblings, folded_root`` of every row; siblings is all that a verifier needs beside the
        leaf, and folded_root what the table's hash becomes with ``other`` in place of the leaf."""
        folded = F.aggregate("path", F.coalesce("other", "leaf"), _spliced)
        siblings = F.array_join(F.transform("path", _excised), "")
        return self.paths().select("doc_id", "leaf", "subroot", F.lit(self.root).cast("string").alias("root"), siblings.alias("siblings"), folded.alias("folded_root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = Manifest(table(spark, sf_dir, "documents"), altered()).proofs()
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _crc32_sql(value: str) -> str:
    """Unsigned CRC-32 of a text of ASCII characters, bit by bit."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    bits = "b"
    for _ in range(8):
        bits = f"list_transform([{bits}], lambda c: {step})[1]"
    fold = bits.replace("[b]", "[xor(acc, x)]", 1)
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({value}, ''), lambda ch: ascii(ch)::BIGINT)), lambda acc, x: {fold}), 4294967295::BIGINT)"


def _sql() -> str:
    def hashed(n_chars: str) -> str:
        fields = [f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR) END" for v in ("doc_id", "source", "lang", n_chars, "text")]
        return f"sha256({' || '.join(fields)})"

    return f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, {hashed("n_chars")} AS leaf,
         CASE WHEN n_chars IS NOT NULL AND {_crc32_sql("CAST(doc_id AS VARCHAR)")} % {EVERY} = 0 THEN {hashed("(n_chars + 1)")} ELSE {hashed("n_chars")} END AS other
  FROM documents),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) AS tree FROM (SELECT DISTINCT lang FROM documents)),
leaves AS (
  SELECT row_number() OVER () AS id, tree, doc_id, leaf, other, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM rows JOIN langs ON rows.lang IS NOT DISTINCT FROM langs.lang),
tree AS (
  SELECT tree, 0 AS level, pos, leaf AS hash, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (max(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY tree, level, pos // 2),
subroots AS (SELECT tree, hash AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM tree WHERE n = 1),
upper AS (
  SELECT 0 AS level, pos, subroot AS hash, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (max(n) + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, pos // 2),
climb AS (
  SELECT id, l.tree, l.pos, 0 AS level, false AS above, other AS folded, '' AS siblings, n FROM leaves l JOIN tree t ON l.tree = t.tree AND t.level = 0 AND t.pos = l.pos
  UNION ALL
  SELECT c.id, c.tree, CASE WHEN c.above OR c.n > 1 THEN c.pos // 2 ELSE s.pos END,
         CASE WHEN c.above OR c.n > 1 THEN c.level + 1 ELSE 0 END, c.above OR c.n = 1,
         CASE WHEN NOT c.above AND c.n = 1 THEN c.folded WHEN c.pos % 2 = 0 THEN sha256(c.folded || coalesce(o.hash, p.hash, '')) ELSE sha256(coalesce(o.hash, p.hash) || c.folded) END,
         CASE WHEN NOT c.above AND c.n = 1 THEN c.siblings ELSE c.siblings || coalesce(o.hash, p.hash, '') END,
         CASE WHEN NOT c.above AND c.n = 1 THEN (SELECT max(n) FROM upper WHERE level = 0) ELSE (c.n + 1) // 2 END
  FROM climb c JOIN subroots s ON c.tree = s.tree
  LEFT JOIN tree o ON NOT c.above AND c.n > 1 AND o.tree = c.tree AND o.level = c.level AND o.pos = xor(c.pos, 1)
  LEFT JOIN upper p ON c.above AND p.level = c.level AND p.pos = xor(c.pos, 1)
  WHERE NOT (c.above AND c.n = 1))
SELECT l.doc_id, l.leaf, s.subroot, r.hash AS root, sha256(c.siblings) AS proof_sha256, c.folded AS folded_root, c.folded = r.hash AS verified
FROM climb c JOIN leaves l USING (id) JOIN subroots s ON s.tree = l.tree CROSS JOIN (SELECT hash FROM upper WHERE n = 1) r
WHERE c.above AND c.n = 1"""


SQL = _sql()
