"""The queries over the driver's tables, each with SQL that gives the same rows.

Driver tables stand in for reaction data: an order is a record whose left side holds the part
types of its odd lines and whose right side those of the even ones; its priority is the class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxflow.functions import exprs as E
from rxflow.operators import build, cluster, embed, metrics, profile, quantiles, sketches, split, tokens
from rxflow.plans import builds, runner
from rxflow.sources import lookups, tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(made: Query) -> Query:
        _QUERIES[made.__name__] = made
        if sql:
            _SQL[made.__name__] = sql
        return made

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# ---- tokens and scalars ---------------------------------------------------------------



def _tok(text: str) -> str:
    return f"regexp_extract_all({text}, '{E.TOKEN_PATTERN}', 1)"



@query(f"SELECT doc_id, CAST(len({_tok('text')}) AS BIGINT) AS n_tokens, array_to_string({_tok('text')}, '') = text AS lossless FROM documents")
def atom_token_counts(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", "text", E.atom_tokens(F.col("text")).alias("tokens"))  # matched once
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), (F.array_join("tokens", "") == F.col("text")).alias("lossless"))


#: Parts as molecules with tokens of several letters: brackets by brand, ring numbers by size, Br and Cl by type.
_PARTS = "(SELECT CASE WHEN p_type LIKE 'S%' THEN 'Br' ELSE 'Cl' END || 'C%' || CAST(10 + p_size AS VARCHAR) || '[' || replace(p_brand, 'Brand#', 'Fe+') || ']c1ccccc1' AS smiles FROM part)"


@query(f"SELECT DISTINCT token FROM (SELECT unnest({_tok('smiles')}) AS token FROM {_PARTS}) WHERE length(token) > 1")
def atom_vocabulary(spark, sf):
    ends = F.when(F.col("p_type").startswith("S"), "Br").otherwise("Cl")
    smiles = F.concat(ends, F.lit("C%"), (10 + F.col("p_size")).cast("string"), F.lit("["), F.replace("p_brand", F.lit("Brand#"), F.lit("Fe+")), F.lit("]c1ccccc1"))
    return tokens.atom_vocabulary(t(spark, sf, "part").select(smiles.alias("smiles")), "smiles")


@query(f"SELECT token, COUNT(*) AS n, length(token) > 1 AS multichar FROM (SELECT unnest({_tok('text')}) AS token FROM documents) GROUP BY token")
def token_vocabulary(spark, sf):
    each = t(spark, sf, "documents").select(F.explode(E.atom_tokens(F.col("text"))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n")).withColumn("multichar", F.length("token") > 1)


@query(f"SELECT p_partkey, array_to_string({_tok('p_name')}, ' ') AS tokens, regexp_replace(array_to_string({_tok('p_name')}, ' '), '\\s+', '', 'g') AS back FROM part")
def token_roundtrip(spark, sf):
    spaced = E.tokens_to_text(F.col("p_name"))
    return t(spark, sf, "part").select("p_partkey", spaced.alias("tokens"), E.text_to_smiles(spaced).alias("back"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_returnflag LIKE '%R%' THEN 'reversed' ELSE 'forward' END AS direction, l_discount >= 0.05 AND l_linestatus = 'F' AS good FROM lineitem")
def direction_and_quality(spark, sf):
    source = F.when(F.col("l_returnflag") == "R", "table-reversed").otherwise("table")
    steps = F.when(F.col("l_linestatus") == "F", "single").otherwise("multi")
    return t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", E.direction(source).alias("direction"), E.good_quality(F.col("l_discount"), steps, 0.05).alias("good"))


@query("SELECT p_partkey, CASE WHEN p_size % 9 BETWEEN 1 AND 7 THEN CAST(p_size % 9 AS VARCHAR) ELSE 'other' END AS ec_class FROM part")
def class_family(spark, sf):
    ec = F.concat((F.col("p_size") % 9).cast("string"), F.lit(".1.1."), F.col("p_partkey").cast("string"))
    return t(spark, sf, "part").select("p_partkey", E.ec_class(ec).alias("ec_class"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment LIKE 'A%' THEN '' ELSE trim(c_mktsegment) END AS cleaned, CASE WHEN c_nationkey = 5 THEN 'human' WHEN c_nationkey % 3 = 0 THEN 'plant' WHEN c_nationkey % 3 = 1 THEN 'animal' ELSE '' END AS organism_class FROM customer")
def clean_and_entity_class(spark, sf):
    seg = F.when(F.col("c_mktsegment").startswith("A"), " / ").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))
    tax = F.when(F.col("c_nationkey") == 5, 9606.0)
    coarse = F.get(F.array(F.lit("Plant"), F.lit(" animal "), F.lit("fungus")), F.col("c_nationkey") % 3)
    return t(spark, sf, "customer").select("c_custkey", E.clean(seg).alias("cleaned"), E.organism_class(tax, F.lit("x"), coarse).alias("organism_class"))


@query("SELECT event_id, user_id, unnest(['P' || user_id, 'Q' || CAST(event_id % 7 AS VARCHAR)]) AS uniprot_id FROM events WHERE event_id % 5 <> 0")
def refs_explode(spark, sf):
    refs = F.when(F.col("event_id") % 5 == 0, "[]").otherwise(F.concat(F.lit("['P"), F.col("user_id").cast("string"), F.lit("', 'Q"), (F.col("event_id") % 7).cast("string"), F.lit("']")))
    return t(spark, sf, "events").select("event_id", "user_id", F.explode(tables.list_literal(refs)).alias("uniprot_id"))


@query("SELECT doc_id, CASE WHEN length(source) > 4 THEN substr(source, 1, 1) || '…' ELSE source END AS label, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM documents WHERE contains(lower(lang || ' ' || source), 'src1')")
def substring_browse(spark, sf):
    rows = t(spark, sf, "documents").where(E.matches("SRC1", F.col("lang"), F.col("source")))
    return rows.select("doc_id", E.shortened(F.col("source"), 4).alias("label"), E.escape_xml(F.col("text")).alias("safe"))


# ---- reactions ------------------------------------------------------------------------

_RX = """rx AS (
  SELECT l_orderkey AS ord, any_value(o_orderpriority) AS ec_num,
    coalesce(array_to_string(list_sort(list(p_type) FILTER (WHERE l_linenumber % 2 = 1)), '.'), '') || '>>' ||
    coalesce(array_to_string(list_sort(list(p_type) FILTER (WHERE l_linenumber % 2 = 0)), '.'), '') AS reaction
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey),
sides AS (
  SELECT ord, ec_num, reaction,
    list_filter(string_split(string_split(reaction, '>>')[1], '.'), lambda x: x <> '') AS lefts,
    list_filter(string_split(string_split(reaction, '>>')[2], '.'), lambda x: x <> '') AS rights FROM rx),
"""
_CAP = 60
_BUILT = (
    "WITH "
    + _RX
    + f"""keyed AS (
  SELECT *, array_to_string(list_sort(lefts), '.') AS r, array_to_string(list_sort(rights), '.') AS p FROM sides),
counted AS (
  SELECT *, len({_tok("r")}) AS nr, len({_tok("p")}) AS np FROM keyed),
first AS (
  SELECT *, CASE WHEN len(lefts) = 0 OR len(rights) = 0 THEN 'invalid' WHEN r = p THEN 'identity'
    WHEN nr > {_CAP} OR np > {_CAP} THEN 'too_long' ELSE 'out' END AS s FROM counted),
judged AS (
  SELECT *, CASE WHEN s = 'out' AND row_number() OVER (PARTITION BY s, r, p, ec_num ORDER BY ord) > 1 THEN 'duplicate' ELSE s END AS status FROM first)
"""
)


def synthetic_records(spark: SparkSession, sf: str) -> DataFrame:
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = t(spark, sf, "part").select("p_partkey", "p_type")
    orders = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    side = lambda odd: F.array_join(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") % 2 == odd, F.col("p_type")))), ".")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("l_orderkey").agg(F.concat(side(1), F.lit(">>"), side(0)).alias("reaction"))
    return rows.join(orders, rows.l_orderkey == orders.o_orderkey).select(F.col("l_orderkey").alias("ord"), F.col("o_orderpriority").alias("ec_num"), "reaction")


@query("WITH " + _RX + "x AS (SELECT 1) SELECT ord, CASE WHEN len(lefts) > 0 AND len(rights) > 0 THEN len(lefts) END AS n_left, CASE WHEN len(lefts) > 0 AND len(rights) > 0 THEN len(rights) END AS n_right FROM sides")
def reaction_sides(spark, sf):
    s = E.split_reaction(F.col("reaction"))
    return synthetic_records(spark, sf).select("ord", F.size(s["reactants"]).cast("long").alias("n_left"), F.size(s["products"]).cast("long").alias("n_right"))


@query(
    "WITH " + _RX + "k AS (SELECT ord, array_to_string(list_sort(lefts), '.') AS a, array_to_string(list_sort(rights), '.') AS b FROM sides WHERE len(lefts) > 0 AND len(rights) > 0) "
    "SELECT ord, a || '>>' || b AS directed, least(a, b) || '|' || greatest(a, b) AS undirected FROM k"
)
def reaction_keys(spark, sf):
    s = E.split_reaction(F.col("reaction"))
    rows = synthetic_records(spark, sf).where(s.isNotNull()).select("ord", E.join_molecules(s["reactants"]).alias("a"), E.join_molecules(s["products"]).alias("b"))
    return rows.select("ord", E.reaction_key(F.col("a"), F.col("b")).alias("directed"), E.undirected_key(F.col("a"), F.col("b")).alias("undirected"))


def _built(spark, sf):
    return build.build_reactions(synthetic_records(spark, sf), ["ord"], _CAP, "orders", extra_cols=["ec_num"], dedup_extra_cols=["ec_num"])


@query(
    _BUILT + "SELECT row_number() OVER (ORDER BY r, p, ec_num) - 1 AS reaction_id, r AS reactant_smiles, p AS product_smiles, 'orders' AS source, "
    "CAST(len(lefts) AS INT) AS n_reactants, CAST(len(rights) AS INT) AS n_products, CAST(nr AS INT) AS src_n_tokens, CAST(np AS INT) AS tgt_n_tokens, ec_num FROM judged WHERE status = 'out'"
)
def build_reactions(spark, sf):
    return _built(spark, sf)[0]


@query(
    _BUILT + "SELECT COUNT(*) AS n_in, COUNT(*) FILTER (WHERE status = 'invalid') AS n_invalid, COUNT(*) FILTER (WHERE status = 'identity') AS n_identity, "
    "COUNT(*) FILTER (WHERE status = 'too_long') AS n_too_long, COUNT(*) FILTER (WHERE status = 'duplicate') AS n_duplicate, COUNT(*) FILTER (WHERE status = 'out') AS n_out FROM judged"
)
def build_stats(spark, sf):
    return build.build_stats(_built(spark, sf)[1])


@query("SELECT text_key, doc_id, source FROM (SELECT md5(text) AS text_key, doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY CASE lang WHEN 'en' THEN 0 ELSE 1 END, doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_priority(spark, sf):
    docs = t(spark, sf, "documents").select(F.md5("text").alias("text_key"), "doc_id", "source", "lang")
    rows = build.in_order(docs.where("lang = 'en'"), docs.where("lang <> 'en'"))
    return build.first_of(rows, "text_key", ["source_rank", "doc_id"]).select("text_key", "doc_id", "source")


_LISTS = """lists AS (SELECT s_nationkey AS nation, list_sort(list(s_suppkey)) AS accs FROM supplier GROUP BY s_nationkey)"""


def _resolution(spark, sf, every: bool) -> DataFrame:
    """Orders without accession (their priority has none), resolved by class and nation."""
    orders, customer = t(spark, sf, "orders"), t(spark, sf, "customer")
    raw = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.concat(F.lit("A>>"), F.col("o_orderkey").cast("string")).alias("unmapped"),
        F.col("o_orderkey").alias("rxn_idx"),
        F.lit("1.1").alias("ec_num"),
        F.col("c_nationkey").cast("string").alias("organism"),
        F.lit("db").alias("source"),
        F.lit(1.0).alias("quality"),
        F.lit(True).alias("natural"),
        F.lit("single").alias("steps"),
        F.when(F.col("o_orderpriority").startswith("1"), "uniprot").otherwise("genbank").alias("protein_db"),
        F.lit("['X']").alias("protein_refs"),
        F.col("o_orderkey").alias("ord"),
    )
    found = t(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("organism")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: x.cast("string")), ";").alias("accessions"))
    found = found.select(F.lit("1.1").alias("ec_num"), "organism", "accessions", F.lit(0).alias("ord"))
    return build.load_resolved(raw, found, every).select(F.col("rxn_idx").alias("o_orderkey"), "uniprot_id")


@query("WITH " + _LISTS + " SELECT o_orderkey, CAST(accs[1] AS VARCHAR) AS uniprot_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN lists ON nation = c_nationkey WHERE o_orderpriority NOT LIKE '1%'")
def resolve_pick_one(spark, sf):
    return _resolution(spark, sf, False)


@query("WITH " + _LISTS + " SELECT o_orderkey, CAST(unnest(accs) AS VARCHAR) AS uniprot_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN lists ON nation = c_nationkey WHERE o_orderpriority NOT LIKE '1%'")
def resolve_explode_all(spark, sf):
    return _resolution(spark, sf, True)


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def complement_rows(spark, sf):
    return build.lacking(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels"), "doc_id")


@query("SELECT d.doc_id, CAST(coalesce(l.quality, 9) AS INT) AS quality, CASE WHEN l.quality IS NULL THEN 'fallback' ELSE 'primary' END AS origin FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def fallback_attach(spark, sf):
    found = t(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    first = lambda wanted: wanted.join(found, "doc_id")
    second = lambda rest: rest.select("doc_id", F.lit(9).alias("quality"))
    return lookups.with_fallback(spark, t(spark, sf, "documents").select("doc_id"), first, second, "doc_id", "origin", ("primary", "fallback"))


# ---- splits ---------------------------------------------------------------------------

_HASHED = """g AS (SELECT o_custkey AS k, row_number() OVER (ORDER BY md5('42:' || CAST(o_custkey AS VARCHAR)), o_custkey) - 1 AS r FROM (SELECT DISTINCT o_custkey FROM orders)),
n AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM g),
s AS (SELECT k, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train' WHEN r < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM g, n),
o AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, split FROM orders JOIN s ON o_custkey = k)"""


def _orders_split(spark, sf) -> DataFrame:
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    return split.assign_splits(orders, "o_custkey")


@query("WITH " + _HASHED + " SELECT o_orderkey, o_custkey, split FROM o")
def grouped_split(spark, sf):
    return _orders_split(spark, sf).select("o_orderkey", "o_custkey", "split")


@query("WITH " + _HASHED + ", c AS (SELECT split, COUNT(*) AS n FROM o GROUP BY split) SELECT x.split, coalesce(n, 0) AS n FROM (VALUES ('train'), ('valid'), ('test')) x(split) LEFT JOIN c ON c.split = x.split")
def split_counts(spark, sf):
    return split.split_counts(_orders_split(spark, sf))


@query("WITH " + _HASHED + " SELECT o_orderpriority, COUNT(DISTINCT split) AS n_splits FROM o GROUP BY o_orderpriority HAVING COUNT(DISTINCT split) > 1")
def leak_check(spark, sf):
    return split.leaking_groups(_orders_split(spark, sf), "o_orderpriority")


_FORCED = ", h AS (SELECT DISTINCT o_custkey FROM o WHERE o_totalprice > 400000), f AS (SELECT o.*, CASE WHEN o_custkey IN (SELECT o_custkey FROM h) THEN 'test' ELSE split END AS after FROM o)"


@query("WITH " + _HASHED + _FORCED + " SELECT o_orderkey, after AS split FROM f")
def force_to_test(spark, sf):
    return split.force_to_test(_orders_split(spark, sf), F.col("o_totalprice") > 400000, "o_custkey").select("o_orderkey", "split")


@query("WITH " + _HASHED + _FORCED + " SELECT COUNT(*) FILTER (WHERE split <> 'test' AND after = 'test' AND NOT o_totalprice > 400000) AS n FROM f")
def pulled_along(spark, sf):
    before, big = _orders_split(spark, sf), F.col("o_totalprice") > 400000
    return split.pulled_along(before, split.force_to_test(before, big, "o_custkey"), big, "o_orderkey")


_EVENTS = "e AS (SELECT *, CASE WHEN event_id % 10 < 8 THEN 'train' WHEN event_id % 10 = 8 THEN 'valid' ELSE 'test' END AS split FROM events)"
_SHARE = "(SELECT coalesce(avg(CASE WHEN {0} IN (SELECT {0} FROM e WHERE split = 'train') THEN 1.0::DOUBLE ELSE 0 END), 0) FROM e WHERE split = 'test')"


def _events_split(spark, sf) -> DataFrame:
    at = F.col("event_id") % 10
    return t(spark, sf, "events").withColumn("split", F.when(at < 8, "train").when(at == 8, "valid").otherwise("test"))


@query("WITH " + _EVENTS + " SELECT round(" + _SHARE.format("user_id") + ", 6) AS share")
def overlap_leakage(spark, sf):
    return split.overlap(_events_split(spark, sf), "user_id").select(r6(F.col("share")).alias("share"))


@query(
    "WITH " + _EVENTS + " SELECT 'split' AS split_col, COUNT(*) FILTER (WHERE split = 'train') AS train, COUNT(*) FILTER (WHERE split = 'valid') AS valid, COUNT(*) FILTER (WHERE split = 'test') AS test, "
    "round(" + _SHARE.format("user_id") + ", 6) AS entity_overlap, round(" + _SHARE.format("event_type") + ", 6) AS reaction_overlap FROM e"
)
def split_summary(spark, sf):
    out = profile.split_summary(_events_split(spark, sf), ["split"], "user_id", F.col("event_type"))
    return out.withColumns({c: r6(F.col(c)) for c in ("entity_overlap", "reaction_overlap")})


@query(
    "WITH a AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), b AS (SELECT i, source, row_number() OVER (ORDER BY md5('42:' || CAST(i AS VARCHAR))) - 1 AS j FROM a) "
    "SELECT a.doc_id, b.source FROM a JOIN b ON a.i = b.j"
)
def shuffle_control(spark, sf):
    return split.shuffled_pairs(t(spark, sf, "documents").select("doc_id", "source"), ["doc_id"], ["source"])


# ---- similarity and clusters ----------------------------------------------------------


@query("SELECT CAST(doc_id AS VARCHAR) AS id, dense_rank() OVER (ORDER BY f) - 1 AS cluster FROM (SELECT doc_id, min(CAST(doc_id AS VARCHAR)) OVER (PARTITION BY text) AS f FROM documents)")
def exact_clusters(spark, sf):
    return cluster.cluster_sequences(t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("sequence")), "exact")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, row_number() OVER (ORDER BY CAST(s_suppkey AS VARCHAR)) - 1 AS cluster FROM supplier")
def identity_clusters(spark, sf):
    return cluster.cluster_sequences(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("sequence")), "uniprot")




@query(
    "WITH s AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS item FROM lineitem), z AS (SELECT id, COUNT(*) AS n FROM s GROUP BY id), "
    "p AS (SELECT x.id AS a, y.id AS b, COUNT(*) AS k FROM s x JOIN s y ON x.item = y.item AND x.id < y.id GROUP BY 1, 2) "
    "SELECT a, b, round(k / (u.n + v.n - k)::DOUBLE, 6) AS similarity FROM p JOIN z u ON u.id = a JOIN z v ON v.id = b WHERE k / (u.n + v.n - k)::DOUBLE >= 0.5 - 1e-12"
)
def jaccard_pairs(spark, sf):
    sets = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_partkey").alias("items"))
    return cluster.similar_pairs(sets, 0.5).withColumn("similarity", r6(F.col("similarity")))


def _greedy_sql(items: str, threshold: float) -> str:
    """The greedy rule one row after the other, over a CTE ``s`` of ``id, length, items``."""
    return f"""WITH RECURSIVE s AS ({items}), o AS (SELECT *, row_number() OVER (ORDER BY length DESC, id) AS i FROM s),
x AS (SELECT DISTINCT i, unnest(items) AS item FROM o), z AS (SELECT i, count(*) AS n FROM x GROUP BY i),
k AS (SELECT a.i AS i, b.i AS j, count(*) AS shared FROM x a JOIN x b ON a.item = b.item AND b.i < a.i GROUP BY 1, 2),
p AS (SELECT k.i, k.j, shared / (u.n + v.n - shared)::DOUBLE AS sim FROM k JOIN z u ON u.i = k.i JOIN z v ON v.i = k.j WHERE shared / (u.n + v.n - shared)::DOUBLE >= {threshold}::DOUBLE),
e AS (SELECT o.i, coalesce(list(p.j) FILTER (WHERE p.j IS NOT NULL), []) AS earlier FROM o LEFT JOIN p ON p.i = o.i GROUP BY o.i),
r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS reps UNION ALL SELECT e.i, CASE WHEN list_has_any(reps, earlier) THEN reps ELSE list_append(reps, e.i) END FROM r JOIN e ON e.i = r.i + 1),
c AS (SELECT unnest(reps) AS rep FROM r WHERE i = (SELECT max(i) FROM r)),
n AS (SELECT rep, row_number() OVER (ORDER BY rep) - 1 AS cluster FROM c),
m AS (SELECT p.i, arg_min(rep, (-sim, rep)) AS rep FROM p JOIN c ON c.rep = p.j WHERE p.i NOT IN (SELECT rep FROM c) GROUP BY p.i UNION ALL SELECT rep, rep FROM c)
SELECT o.id, n.cluster FROM m JOIN o USING (i) JOIN n USING (rep)"""


_WORDS = r"list_filter(string_split_regex(text, '[ \t-\r]+'), lambda w: w <> '')"
_SHINGLED = f"(SELECT doc_id, {_WORDS} AS w FROM documents)"
_SHINGLES = "list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))"


def shingled(spark, sf) -> DataFrame:
    """``id, length, items``: whole documents with words as sets of runs of five words."""
    docs = t(spark, sf, "documents").where(F.col("text").rlike(r"[^ \t-\r]"))
    return docs.select(F.col("doc_id").alias("id"), F.length("text").alias("length"), E.shingles(F.col("text")).alias("items"))


@query(_greedy_sql("SELECT CAST(p_partkey AS VARCHAR) AS id, length(p_name) AS length, list_distinct(list_transform(range(1, greatest(length(p_name) - 3, 1) + 1), lambda i: substr(p_name, i, 4))) AS items FROM part", 0.6))
def greedy_clusters(spark, sf):
    names = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("sequence"))
    return cluster.cluster_sequences(names, "kmer", 4, 0.6)


@query(_greedy_sql(f"SELECT doc_id AS id, length(text) AS length, {_SHINGLES} AS items FROM {_SHINGLED} JOIN documents USING (doc_id) WHERE len(w) > 0", 0.4))
def document_clusters(spark, sf):
    return cluster.cluster_rows(shingled(spark, sf), 0.4)


_CLASSES = (
    f"s AS (SELECT doc_id, list_sort({_SHINGLES}) AS items FROM {_SHINGLED} WHERE len(w) > 0), c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY items) AS class, items FROM s), "
    "x AS (SELECT class, unnest(items) AS item FROM c WHERE doc_id = class), z AS (SELECT class, len(items) AS n FROM c WHERE doc_id = class), "
    "k AS (SELECT a.class AS a, b.class AS b, count(*) AS shared FROM x a JOIN x b ON a.item = b.item AND a.class < b.class GROUP BY 1, 2), "
    "p AS (SELECT a, b, shared / (u.n + v.n - shared)::DOUBLE AS similarity FROM k JOIN z u ON u.class = a JOIN z v ON v.class = b WHERE shared / (u.n + v.n - shared)::DOUBLE >= 0.5)"
)


@query("WITH " + _CLASSES + " SELECT a, b, round(similarity, 6) AS similarity FROM p")
def shingle_jaccard_pairs(spark, sf):
    return cluster.class_pairs(shingled(spark, sf), 0.5)[1].withColumn("similarity", r6(F.col("similarity")))


@query(
    "WITH " + _CLASSES + ", g AS (SELECT class, count(*) AS copies FROM c GROUP BY class), l AS (SELECT a AS class, sum(copies) AS n FROM (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) q JOIN g ON g.class = q.b GROUP BY a) "
    "SELECT doc_id, class, copies, CAST(copies - 1 + coalesce(n, 0) AS BIGINT) AS n_links FROM c JOIN g USING (class) LEFT JOIN l USING (class)"
)
def shingle_classes(spark, sf):
    """Each document with words: its class of equal sets, how many are in it, and how many other documents are at least half alike."""
    members, pairs = cluster.class_pairs(shingled(spark, sf), 0.5)
    members = members.select(F.col("id").alias("doc_id"), "class")
    copies = members.groupBy("class").agg(F.count("*").alias("copies"))
    both = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class"), F.col("a").alias("other")))
    links = both.join(copies.withColumnRenamed("class", "other"), "other").groupBy("class").agg(F.sum("copies").alias("n"))
    return members.join(copies, "class").join(links, "class", "left").select("doc_id", "class", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))


@query("SELECT p_partkey, CAST(len(list_distinct(list_transform(range(1, greatest(length(p_name) - 3, 1) + 1), lambda i: substr(p_name, i, 4)))) AS INT) AS n_kmers FROM part")
def kmer_sets(spark, sf):
    return t(spark, sf, "part").select("p_partkey", F.size(E.kmers(F.col("p_name"), 4)).alias("n_kmers"))


# ---- retrieval metrics ----------------------------------------------------------------

_FRAME = """side AS (
  SELECT o_orderkey, o_custkey, coalesce(array_to_string(list_sort(list_distinct(list(p_type) FILTER (WHERE p_type IS NOT NULL))), '.'), '') AS side,
    coalesce(list_sort(list_distinct(list(p_type) FILTER (WHERE p_type IS NOT NULL))), []) AS refs
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey, o_custkey),
cust AS (SELECT o_custkey, list({'k': o_orderkey, 's': side} ORDER BY o_orderkey) AS every FROM side GROUP BY o_custkey),
frame AS (SELECT o_orderkey AS row_id, refs, list_transform(list_filter(every, lambda x: x.k <> o_orderkey), lambda x: x.s) AS preds FROM side JOIN cust USING (o_custkey)),
f AS (SELECT row_id, list_distinct(refs) AS ref_set, refs, preds,
  list_transform(preds, lambda p: list_distinct(list_filter(string_split(p, '.'), lambda m: trim(m) <> ''))) AS sets FROM frame)
"""


def ranked_frame(spark: SparkSession, sf: str) -> DataFrame:
    """References: part types of an order's lines. Predictions: those of the customer's other orders."""
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    parts = t(spark, sf, "part").select("p_partkey", "p_type")
    types = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_type")).alias("refs"))
    sides = orders.join(types, orders.o_orderkey == types.l_orderkey, "left").select("o_orderkey", "o_custkey", F.coalesce("refs", F.array().cast("array<string>")).alias("references"))
    sides = sides.withColumn("side", F.array_join("references", "."))
    every = sides.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "side"))).alias("every"))
    others = F.filter("every", lambda x: x["o_orderkey"] != F.col("o_orderkey"))
    return sides.join(every, "o_custkey").select(F.col("o_orderkey").alias("row_id"), "references", F.transform(others, lambda x: x["side"]).alias("predictions"))


def _sql_metric(name: str, k: int) -> str:
    top = f"list_distinct(flatten(sets[1:{k}]))"
    hit = f"len(list_intersect(ref_set, {top}))"
    return {
        "accuracy": f"avg(CASE WHEN {hit} > 0 THEN 1.0::DOUBLE ELSE 0 END)",
        "exact_match": f"avg(CASE WHEN len(list_filter(sets[1:{k}], lambda s: len(s) > 0 AND list_sort(s) = list_sort(ref_set))) > 0 THEN 1.0::DOUBLE ELSE 0 END)",
        "precision": f"coalesce(avg(CASE WHEN len({top}) > 0 THEN {hit} / len({top})::DOUBLE END), 0)",
        "recall": f"coalesce(avg(CASE WHEN len(ref_set) > 0 THEN {hit} / len(ref_set)::DOUBLE END), 0)",
        "f1": f"coalesce(avg(CASE WHEN len(ref_set) > 0 AND len({top}) > 0 THEN 2.0::DOUBLE * {hit} / (len(ref_set) + len({top})) END), 0)",
    }[name]


def _metric_query(name: str) -> None:
    sql = "WITH " + _FRAME + "SELECT " + ", ".join(f"round({_sql_metric(name, k)}, 6) AS top_{k}" for k in metrics.KS) + " FROM f"

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = metrics.prepared(ranked_frame(spark, sf))
        return rows.agg(*(r6(metrics.PER_K[name](k)).alias(f"top_{k}") for k in metrics.KS))

    run.__name__ = f"metric_{name}"
    query(sql)(run)


for _name in metrics.PER_K:
    _metric_query(_name)


@query(
    "WITH " + _FRAME + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, " + ", ".join(f"round({_sql_metric(m, k)}, 6) AS top_{k}" for k in metrics.KS) + " FROM f" for m in metrics.PER_K)
)
def metrics_matrix(spark, sf):
    out = metrics.matrix(ranked_frame(spark, sf))
    return out.select("metric", *(r6(F.col(f"top_{k}")).alias(f"top_{k}") for k in metrics.KS))


@query(
    "WITH " + _FRAME + ", v AS (SELECT list_filter(preds, lambda p: trim(p) <> '') AS valid, preds, flatten(list_transform(preds, lambda p: list_filter(string_split(p, '.'), lambda m: m <> ''))) AS mols FROM f) "
    "SELECT round(sum(len(valid)) / sum(len(preds))::DOUBLE, 6) AS validity, round(sum(len(list_filter(mols, lambda m: trim(m) <> ''))) / sum(len(mols))::DOUBLE, 6) AS per_molecule_validity, "
    "round(coalesce(avg(CASE WHEN len(valid) > 0 THEN len(list_distinct(valid)) / len(valid)::DOUBLE END), 0), 6) AS uniqueness FROM v"
)
def metric_validity(spark, sf):
    rows = metrics.prepared(ranked_frame(spark, sf))
    return rows.agg(*(r6(make()).alias(name) for name, make in metrics.SCALARS.items()))


@query("WITH " + _FRAME + ", u AS (SELECT unnest(list_filter(preds, lambda p: trim(p) <> '')) AS p FROM f) SELECT round(avg(CASE WHEN p IN (SELECT DISTINCT p_type FROM part WHERE p_size < 25) THEN 0.0::DOUBLE ELSE 1 END), 6) AS novelty FROM u")
def metric_novelty(spark, sf):
    train = t(spark, sf, "part").where("p_size < 25").select(F.col("p_type").alias("smiles"))
    return metrics.novelty(ranked_frame(spark, sf), train).select(r6(F.col("novelty")).alias("novelty"))


_BITS = "list_distinct(list_transform(range(1, greatest(length({0}), 2)), lambda i: substr({0}, i, 2)))"


def _sql_tanimoto(x: str, y: str) -> str:
    return f"len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))::DOUBLE"


@query(
    "WITH " + _FRAME + ", m AS (SELECT row_id, refs, ref_set, unnest(preds) AS prediction, unnest(sets) AS s, unnest(range(1, len(preds) + 1)) AS rank FROM f), "
    "z AS (SELECT row_id, rank, round(max(" + _sql_tanimoto("x", "y") + "), 6) AS best_tanimoto FROM (SELECT row_id, rank, " + _BITS.format("prediction") + " AS x, " + _BITS.format("ref") + " AS y FROM (SELECT row_id, rank, prediction, unnest(refs) AS ref FROM m WHERE trim(prediction) <> '') WHERE trim(ref) <> '') GROUP BY 1, 2) "
    "SELECT m.row_id, CAST(m.rank AS INT) AS rank, prediction, len(s) > 0 AND list_sort(s) = list_sort(ref_set) AS exact, best_tanimoto FROM m LEFT JOIN z ON z.row_id = m.row_id AND z.rank = m.rank"
)
def match_flags(spark, sf):
    return metrics.matches(ranked_frame(spark, sf)).withColumn("best_tanimoto", r6(F.col("best_tanimoto")))


@query(
    "WITH " + _FRAME + ", m AS (SELECT row_id, unnest(refs) AS ref, list_filter(preds, lambda p: trim(p) <> '')[1] AS first FROM f WHERE len(refs) > 0) "
    "SELECT row_id, round(max(" + _sql_tanimoto(_BITS.format("first"), _BITS.format("ref")) + "), 6) AS similarity FROM m WHERE first IS NOT NULL GROUP BY row_id"
)
def nearest_reference(spark, sf):
    return metrics.nearest_reference(ranked_frame(spark, sf)).withColumn("similarity", r6(F.col("similarity")))


@query("WITH " + _FRAME + " SELECT row_id, array_to_string(list_sort(list_intersect(ref_set, list_distinct(flatten(sets)))), '.') AS found, array_to_string(list_sort(ref_set), '.') AS expected FROM f")
def recovered_items(spark, sf):
    return metrics.recovered(ranked_frame(spark, sf)).select("row_id", F.array_join("found", ".").alias("found"), F.array_join("expected", ".").alias("expected"))


@query(
    "WITH s AS (SELECT DISTINCT l_orderkey AS o, l_linenumber % 2 AS side, l_partkey % 50 AS bit FROM lineitem), a AS (SELECT o, list(bit) AS x FROM s WHERE side = 1 GROUP BY o), b AS (SELECT o, list(bit) AS y FROM s WHERE side = 0 GROUP BY o) "
    "SELECT o AS l_orderkey, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE, 6) AS similarity FROM a JOIN b USING (o)"
)
def tanimoto_sides(spark, sf):
    bits = lambda odd: F.collect_set(F.when(F.col("l_linenumber") % 2 == odd, F.col("l_partkey") % 50))
    rows = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(bits(1).alias("x"), bits(0).alias("y")).where((F.size("x") > 0) & (F.size("y") > 0))
    return rows.select("l_orderkey", r6(E.tanimoto(F.col("x"), F.col("y"))).alias("similarity"))


# ---- profiles -------------------------------------------------------------------------

_CL = "c AS (SELECT source, doc_id, n_chars, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS kind FROM documents), z AS (SELECT source, COUNT(DISTINCT doc_id) AS size FROM c GROUP BY source)"


@query(
    "WITH " + _CL + " SELECT COUNT(*) AS n_clusters, COUNT(*) FILTER (WHERE size = 1) AS n_singletons, round(COUNT(*) FILTER (WHERE size = 1) / COUNT(*)::DOUBLE, 6) AS singleton_share, "
    "max(size) AS largest, round(avg(size), 6) AS mean_size, round(median(size)::DOUBLE, 6) AS median_size FROM z"
)
def cluster_stats(spark, sf):
    out = profile.cluster_stats(profile.cluster_sizes(t(spark, sf, "documents"), "source", "doc_id"))
    return out.withColumns({c: r6(F.col(c)) for c in ("singleton_share", "mean_size", "median_size")})


@query(
    "WITH " + _CL + ", k AS (SELECT source, kind, COUNT(*) AS n, min(doc_id) AS low FROM c GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, low) AS r, sum(n) OVER (PARTITION BY source) AS size FROM k) "
    "SELECT source AS cluster, CAST(size AS BIGINT) AS size, kind AS label, round(n / size::DOUBLE, 6) AS label_share FROM b WHERE r = 1 ORDER BY size DESC, source LIMIT 12"
)
def largest_clusters(spark, sf):
    kind = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    out = profile.largest_clusters(t(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", kind, "doc_id")
    return out.withColumn("label_share", r6(F.col("label_share")))


@query("SELECT min(n_chars) AS min, CAST(floor(median(n_chars)) AS BIGINT) AS median, max(n_chars) AS max, round(avg(n_chars), 6) AS mean FROM documents")
def length_stats(spark, sf):
    return profile.length_stats(t(spark, sf, "documents"), "n_chars").withColumn("mean", r6(F.col("mean")))


_SHARES = "[0.01, 0.25, 0.5, 0.75, 0.99]"


@query(
    f"SELECT measure, unnest({_SHARES}::DOUBLE[]) AS share, round(unnest(v)::DOUBLE, 6) AS value FROM ("
    f"SELECT 'chars' AS measure, quantile_cont(n_chars, {_SHARES}) AS v FROM documents UNION ALL SELECT 'price', quantile_cont(o_totalprice, {_SHARES}) FROM orders)"
)
def exact_quantiles(spark, sf):
    shares = [0.01, 0.25, 0.5, 0.75, 0.99]
    measured = {"chars": ("documents", "n_chars"), "price": ("orders", "o_totalprice")}
    rows = [(name, s, v) for name, (table, column) in measured.items() for s, v in zip(shares, quantiles.quantiles(t(spark, sf, table), column, shares))]
    return spark.createDataFrame(rows, "measure string, share double, value double").withColumn("value", r6(F.col("value")))


@query(
    _BUILT + "SELECT round(avg(len(lefts)), 6) AS mean_n_reactants, round(avg(len(rights)), 6) AS mean_n_products, round(median(nr)::DOUBLE, 6) AS median_src_n_tokens, round(median(np)::DOUBLE, 6) AS median_tgt_n_tokens FROM judged WHERE status = 'out'"
)
def side_stats(spark, sf):
    out = profile.side_stats(tables.durable(_built(spark, sf)[0]))
    return out.select(*(r6(F.col(c)).alias(c) for c in out.columns))


@query("SELECT CAST(least(floor(least(n_chars, 5000.0::DOUBLE) / 100.0::DOUBLE), 49) AS INT) AS bin, CAST(least(floor(least(n_chars, 5000.0::DOUBLE) / 100.0::DOUBLE), 49) AS INT) * 100.0::DOUBLE AS bin_start, COUNT(*) AS n FROM documents GROUP BY 1, 2")
def length_histogram(spark, sf):
    return profile.histogram(t(spark, sf, "documents"), "n_chars", 50, clip=5000, low=0.0, high=5000.0)


@query("SELECT event_type AS value, COUNT(*) AS n FROM events GROUP BY event_type")
def count_distribution(spark, sf):
    return profile.value_counts(t(spark, sf, "events"), "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1")
def first_per_key(spark, sf):
    return profile.first_per_key(t(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT uniprot_id, label FROM (SELECT p_brand AS uniprot_id, p_partkey, p_brand || ' · EC 1.1 · ' || substr(p_type, 1, 30) || ' (' || length(p_name) || ' aa)' AS label, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) WHERE k = 1 ORDER BY p_partkey LIMIT 20")
def entity_options(spark, sf):
    rows = t(spark, sf, "part").select(F.col("p_partkey").alias("reaction_id"), F.col("p_brand").alias("uniprot_id"), F.lit("1.1").alias("ec_num"), F.col("p_type").alias("organism"), F.col("p_name").alias("sequence"))
    return profile.entity_options(rows, 20).select("uniprot_id", "label")


@query("SELECT o_orderpriority, n, rank() OVER (ORDER BY n DESC) AS place FROM (SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1)")
def ranked_values(spark, sf):
    counts = profile.value_counts(t(spark, sf, "orders"), "o_orderpriority", "o_orderpriority")
    return counts.withColumn("place", F.rank().over(Window.orderBy(F.desc("n"))).cast("long"))  # a few groups


# ---- vectors, hashes, formats ---------------------------------------------------------


@query("SELECT label, CAST(i AS INT) AS component, round(avg(x::DOUBLE), 5) AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) - 1 AS i FROM embeddings) GROUP BY label, i")
def mean_pool_by_label(spark, sf):
    each = t(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("component", "x"))
    return each.groupBy("label", "component").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


@query(
    "WITH m AS (SELECT l_orderkey AS id, l_linenumber % 2 AS m, unnest([l_quantity::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE]) AS x, unnest([0, 1, 2]) AS component FROM lineitem) "
    "SELECT id, CAST(component AS INT) AS component, round(sum(x * m) / greatest(sum(m), 1)::DOUBLE, 5) AS mean FROM m GROUP BY id, component"
)
def mean_pooled_lines(spark, sf):
    at = F.col("l_linenumber")
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), at, F.array(*(F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax"))).alias("v"))
    held = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(at, "v"))).alias("h"))
    pooled = embed.mean_pooled(held.select("id", F.col("h.v").alias("states"), F.transform("h.l_linenumber", lambda n: n % 2).alias("mask")))
    return pooled.select("id", F.posexplode("embedding").alias("component", "mean")).withColumn("mean", F.round("mean", 5))


@query("SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL")
def embedding_missing(spark, sf):
    return build.lacking(t(spark, sf, "documents").select("doc_id"), t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("SELECT n_nationkey, sha256(length(n_name) || ':' || n_name || length(CAST(n_nationkey AS VARCHAR)) || ':' || n_nationkey || length(CAST(n_regionkey AS VARCHAR)) || ':' || n_regionkey) AS h FROM nation")
def row_hashes(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", runner.row_hash(["n_name", "n_nationkey", "n_regionkey"]).alias("h"))


@query(
    "WITH h AS (SELECT sha256(length(CAST(event_id AS VARCHAR)) || ':' || event_id || length(event_type) || ':' || event_type || length(CAST(user_id AS VARCHAR)) || ':' || user_id) AS h FROM events), "
    "w AS (SELECT COUNT(*) AS n, " + ", ".join(f"sum(CAST('0x' || substr(h, {1 + 12 * i}, 12) AS BIGINT)::HUGEINT) AS w{i}" for i in range(5)) + " FROM h) "
    "SELECT sha256('event_id,event_type,user_id|' || n" + "".join(f" || '|' || w{i}" for i in range(5)) + ") AS content_hash FROM w"
)
def content_hash(spark, sf):
    return runner.content_hash(t(spark, sf, "events").select("user_id", "event_type", "event_id"))


@query("SELECT 'D' || doc_id AS accession, replace(replace(lang || source, ' ', ''), chr(10), '') AS sequence FROM documents")
def fasta_records(spark, sf):
    entry = F.concat(F.lit("junk\n>tr|D"), F.col("doc_id").cast("string"), F.lit("|name of it\n"), F.col("lang"), F.lit("\n"), F.col("source"), F.lit("\n"))
    return t(spark, sf, "documents").select(F.inline(tables.fasta_records(entry)))


@query("SELECT date_trunc('hour', ts) AS start, event_type, COUNT(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, sf):
    from rxflow.streaming.incremental import windowed_counts

    return windowed_counts(t(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query(
    _BUILT + ", g AS (SELECT least(r, p) || '|' || greatest(r, p) AS k, status FROM judged) SELECT COUNT(*) AS n_in, COUNT(*) FILTER (WHERE status = 'invalid') AS n_invalid, COUNT(*) FILTER (WHERE status = 'identity') AS n_identity, "
    "COUNT(*) FILTER (WHERE status = 'too_long') AS n_too_long, COUNT(*) FILTER (WHERE status = 'duplicate') AS n_duplicate, COUNT(*) FILTER (WHERE status = 'out') AS n_out FROM g"
)
def written_counts(spark, sf):
    """Statuses of the judged records, counted by the job that writes them."""
    rows = build.told(synthetic_records(spark, sf), ["ord"], _CAP, extra_cols=["ec_num"], dedup_extra_cols=["ec_num"])
    found = builds.written(rows.select("reactant_smiles", "product_smiles", "ec_num", "status"), tables.scratch(spark), {f"n_{s}": F.count_if(F.col("status") == s) for s in build.STATUSES})
    found = {"n_in": found.pop("rows")} | found
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


@query("SELECT doc_id, greatest(1, n_chars) AS tokens, true AS fits, true AS wide_enough FROM documents")
def token_batches(spark, sf):
    """Whether each document's batch keeps to its budget, and is as wide as its longest document."""
    rows = embed.token_batches(t(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 20_000, "doc_id")
    each = rows.groupBy("batch", "width").agg(F.count("*").alias("n"), F.max(F.greatest(F.lit(1), "n_chars")).alias("longest"))
    sizes = each.select("batch", ((F.col("n") * F.col("width") <= 20_000) | (F.col("n") == 1)).alias("fits"), (F.col("width") == F.col("longest")).alias("wide_enough"))
    return rows.join(sizes, "batch").select("doc_id", F.greatest(F.lit(1), "n_chars").cast("long").alias("tokens"), "fits", "wide_enough")


@query("SELECT unnest(['doc_id', 'source', 'text']) AS measure, unnest([COUNT(DISTINCT doc_id), COUNT(DISTINCT source), COUNT(DISTINCT text)]) AS n_distinct, true AS near FROM documents")
def distinct_over_builds(spark, sf):
    """Exact distinct counts over builds (one for each language), and whether those of the united sketches are near."""
    path, docs = tables.scratch(spark), t(spark, sf, "documents").select("doc_id", "source", "text", "lang")
    for k in range(3):  # every language is in one of them
        part = docs.where(F.pmod(F.xxhash64("lang"), F.lit(3)) == k)
        sketches.save(part, ["doc_id", "source", "text"], path, f"part{k}", exact=True)
    both = sketches.exact(spark, path).join(sketches.estimates(spark, path).select("column", F.col("n_distinct").alias("guess")), "column")
    return both.select(F.col("column").alias("measure"), "n_distinct", (F.abs(F.col("guess") - F.col("n_distinct")) <= 5 * sketches.error() * F.col("n_distinct")).alias("near"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k = 1")
def streamed_first_events(spark, sf):
    """The first event of each user, found by a stream with keyed state."""
    from rxflow.streaming.incremental import first_of_stream

    source, path = f"{sf}/events.parque[t]", tables.scratch(spark)  # a pattern, which may be a single file
    events = spark.readStream.schema(t(spark, sf, "events").schema).parquet(source).select("user_id", "event_id", "event_type")
    first = first_of_stream(events, ["user_id"], "event_id")
    writer = first.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(first.schema).parquet(f"{path}/out")


# ---- the flagship ---------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct documents, split by clusters of equal texts, with what leaks between the splits."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "text", "source")
    one = profile.first_per_key(docs, "text", "doc_id")
    found = cluster.cluster_sequences(one.select(F.col("doc_id").alias("id"), F.col("text").alias("sequence")), "exact")
    rows = split.assign_splits(one.join(found.withColumn("doc_id", F.col("id").cast("long")), "doc_id"), "cluster")
    split.assert_no_leak(rows, "cluster")
    return profile.split_summary(rows, ["split"], "cluster", F.col("source"))
