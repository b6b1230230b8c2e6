"""From raw records to a processed reaction table: explode, canonicalise, reject, dedupe, number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxflow.functions import exprs as E
from rxflow.functions.backends import Backend, Identity, dimension
from rxflow.schema import REACTION_COLUMNS
from rxflow.sources.tables import list_literal, stored

STATUSES = ("invalid", "identity", "too_long", "duplicate", "out")
#: First row number of CYP records, which share the column of raw row numbers.
CYP_OFFSET = 100_000_000

# Human isoforms and their reviewed accessions.
CYP_TO_ACCESSION = {
    "CYP1A2": "P05177",
    "CYP2A6": "P11509",
    "CYP2B6": "P20813",
    "CYP2C8": "P10632",
    "CYP2C9": "P11712",
    "CYP2C19": "P33261",
    "CYP2D6": "P10635",
    "CYP2E1": "P05181",
    "CYP3A4": "P08684",
}

#: If rows get all accessions of their lists: pairs of a task, and rows and accessions of a tile of them. A piece of a list's rows is cut into tiles.
PART_PAIRS = 100_000_000
PIECE_ROWS, TILE_ROWS, TILE_ACCESSIONS = 1024, 256, 256
#: Lists of at most so many accessions in all are broadcast.
BROADCAST_ACCESSIONS = 2_000_000

_RECORD = ("reaction", "rxn_idx", "ec_num", "organism", "direction", "quality", "natural", "steps")


# ---- loaders --------------------------------------------------------------------------


def _records(raw: DataFrame, *more: Column) -> DataFrame:
    """Records of raw rows that pass the quality rule. ``ord`` orders them."""
    good = raw.where(E.good_quality(F.col("quality"), F.col("steps")))
    return good.select(
        F.col("unmapped").alias("reaction"),
        F.col("rxn_idx").cast("long").alias("rxn_idx"),
        F.coalesce(F.col("ec_num").cast("string"), F.lit("nan")).alias("ec_num"),
        F.coalesce("organism", F.lit("")).alias("organism"),
        E.direction(F.col("source")).alias("direction"),
        "quality",
        F.coalesce("natural", F.lit(True)).alias("natural"),
        "steps",
        "ord",
        *more,
    )


def load_records(raw: DataFrame) -> DataFrame:
    """All raw reactions of quality; raw needs ``ord``, its row number."""
    return _records(raw)


def has_accession(db: Column, refs: Column, listed: bool = False) -> Column:
    """Whether a row names an accession: a known database and at least one reference.

    A single reference that is no list counts when datasets are built; ``listed`` leaves it out, as the search for
    missing accessions does. (A tuple has two items or a comma at its end.)
    """
    items = list_literal(refs)
    found = F.size(items) > 0
    if listed:
        plain = F.trim(refs)
        found &= F.startswith(plain, F.lit("[")) | (F.startswith(plain, F.lit("(")) & ((F.size(items) > 1) | F.regexp_like(plain, F.lit(r",\s*\)$"))))
    return F.coalesce(db.isin(*E.ACCESSION_DBS), F.lit(False)) & F.coalesce(found, F.lit(False))


def load_with_accessions(raw: DataFrame) -> DataFrame:
    """One record for each accession of a row; rows of other databases or without references have none."""
    refs = F.when(F.coalesce(F.col("protein_db").isin(*E.ACCESSION_DBS), F.lit(False)), list_literal(F.col("protein_refs")))
    rows = _records(raw, refs.alias("refs"))
    return rows.select(*_RECORD, "ord", F.posexplode("refs").alias("pos", "uniprot_id")).withColumn("accession_source", F.lit("curated"))


def load_resolved(raw: DataFrame, resolved: DataFrame, explode_all: bool = False) -> DataFrame:
    """Records of the rows *without* accession, by what a search found for their class and organism.

    Rows without an organism are left out. Of a pair that was resolved twice the later row counts
    (``ord`` of resolved). The lookup is joined as Spark finds best: it is broadcast if it is small. If all accessions are
    exploded, there are as many rows as pairs of a row and an accession; see ``_all_pairs``.
    """
    lookup = (
        resolved.withColumn("accessions", F.filter(F.split(F.coalesce("accessions", F.lit("")), ";"), lambda a: a != ""))
        .where(F.coalesce("organism", F.lit("")) != "")
        .groupBy("ec_num", "organism")
        .agg(F.max_by("accessions", "ord").alias("accessions"))
        .where(F.size("accessions") > 0)
    )
    lacking = raw.where(~has_accession(F.col("protein_db"), F.col("protein_refs")))
    rows = _records(lacking).where("organism <> ''")
    if explode_all:
        pairs = _all_pairs(rows, lookup)
    else:
        pairs = rows.join(lookup, ["ec_num", "organism"]).select(*_RECORD, "ord", F.posexplode(F.slice("accessions", 1, 1)).alias("pos", "uniprot_id"))
    return pairs.withColumn("accession_source", F.lit("resolved"))


def _all_pairs(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Each row with each accession of its list: as many as ``PART_PAIRS`` to a task on average, in tiles of some rows and accessions.

    A tile repeats a short run of accessions, so that columnar files, whose pages have few rows, hold it in little space however long
    the list is. Rows of one list follow each other. Only rows without their accessions are moved, and two counts reach the driver. If there are too
    many accessions to broadcast, the rows of a list are dealt into shares of about ``PART_PAIRS``, and each share is joined with its own copy of the list.
    """
    keys, spark = ["ec_num", "organism"], rows.sparkSession
    piece = F.floor(F.monotonically_increasing_id() / PIECE_ROWS)
    rows = stored(rows.sortWithinPartitions(*keys).withColumn("_piece", piece))
    sizes = lookup.select(*keys, F.size("accessions").cast("long").alias("_size"))
    counts = sizes.join(rows.groupBy(*keys).agg(F.count("*").alias("_rows")), keys, "left")
    total = counts.agg(F.sum(F.col("_size") * F.col("_rows")).alias("pairs"), F.sum("_size").alias("accessions")).first()
    pairs, accessions = total["pairs"] or 0, total["accessions"] or 0
    least = min(spark.sparkContext.defaultParallelism, -(-pairs // 1_000_000))
    parts = max(1, least, -(-pairs // PART_PAIRS))

    others = [c for c in rows.columns if c not in (*keys, "_piece")]
    runs = lookup.select(*keys, F.posexplode(_cut("accessions", TILE_ACCESSIONS)).alias("_run", "_accessions"))
    if accessions <= BROADCAST_ACCESSIONS:
        on, runs, dealt = keys, F.broadcast(runs), rows.repartitionByRange(parts, *keys, "_piece")
    else:
        shares = F.least(F.ceil(F.col("_size") * F.col("_rows") / PART_PAIRS), F.ceil(F.col("_rows") / PIECE_ROWS)).cast("int")
        shares = counts.where("_rows > 0").select(*keys, shares.alias("_shares"))
        dealt = rows.join(shares, keys).withColumn("_share", F.pmod(F.hash("_piece"), "_shares"))
        runs = runs.join(shares, keys).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
        unit, on = F.struct(*keys, "_share").alias("_unit"), ["_unit"]  # one key: were a part of it constant, the join would drop that and deal anew
        dealt = dealt.select(unit, *keys, *others, "_piece").repartition(parts, *on)
        runs = runs.select(unit, "_run", "_accessions").repartition(parts, *on)
    groups = list(dict.fromkeys([*on, *keys]))
    pieces = dealt.groupBy(*groups, "_piece").agg(F.collect_list(F.struct(*others)).alias("_rows")).sortWithinPartitions(*groups, "_piece")
    tiles = pieces.select(*groups, F.explode(_cut("_rows", TILE_ROWS)).alias("_tile"))  # a join would drop a sort right below it
    each = tiles.join(runs, on).select(*keys, "_run", "_accessions", F.explode("_tile").alias("_row"))
    each = each.select(*keys, "_run", "_row", F.posexplode("_accessions").alias("_at", "uniprot_id"))
    found = {c: F.col(c) if c in keys else F.col("_row")[c] for c in (*_RECORD, "ord")}
    return each.select(*(v.alias(c) for c, v in found.items()), (F.col("_run") * TILE_ACCESSIONS + F.col("_at")).alias("pos"), "uniprot_id")


def _cut(items: str, most: int) -> Column:
    """Pieces of an array that isn't empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / most).cast("int")), lambda i: F.slice(items, i * most + 1, F.lit(most)))


def accession_less_pairs(raw: DataFrame) -> DataFrame:
    """Distinct ``ec_num, organism`` to search for, in order."""
    rows = _records(raw.where(~has_accession(F.col("protein_db"), F.col("protein_refs"), listed=True)))
    return rows.where("organism <> ''").select("ec_num", "organism").distinct().orderBy("ec_num", "organism")


def load_cyp(raw: DataFrame) -> DataFrame:
    """Records of a cytochrome table with inline sequences; ``ord`` is its row number, and skipped rows keep theirs."""
    c = {name: E.clean(F.col(f"`{name}`")) for name in ("sub_Smiles1", "pro_Smiles1", "blast", "Symbol", "Uniprot", "EC number", "Species1")}
    accession = F.coalesce(F.nullif(c["Uniprot"], F.lit("")), F.nullif(c["Symbol"], F.lit("")))
    rows = raw.where((c["sub_Smiles1"] != "") & (c["pro_Smiles1"] != "") & (c["blast"] != "") & accession.isNotNull())
    return rows.select(
        F.concat(c["sub_Smiles1"], F.lit(">>"), c["pro_Smiles1"]).alias("reaction"),
        (F.lit(CYP_OFFSET) + F.col("ord")).cast("long").alias("rxn_idx"),
        c["EC number"].alias("ec_num"),
        c["Species1"].alias("organism"),
        E.organism_class(F.col("Txid"), F.col("Species1"), F.col("Species")).alias("organism_class"),
        F.lit("forward").alias("direction"),
        F.lit(1.0).alias("quality"),
        F.lit(True).alias("natural"),
        F.lit("single").alias("steps"),
        "ord",
        F.lit(0).alias("pos"),
        accession.alias("uniprot_id"),
        F.lit("cyp").alias("accession_source"),
        c["blast"].alias("sequence"),
    )


def load_drug_pairs(pairs: DataFrame) -> DataFrame:
    """Records of parent and metabolite for the isoforms that have an accession."""
    known = F.create_map(*[F.lit(x) for kv in CYP_TO_ACCESSION.items() for x in kv])
    rows = pairs.withColumn("uniprot_id", F.try_element_at(known, F.col("cyp"))).where("uniprot_id IS NOT NULL")
    return rows.select(
        F.concat("parent_smiles", F.lit(">>"), "metabolite_smiles").alias("reaction"),
        "uniprot_id",
        "cyp",
        F.lit("").alias("ec_num"),
        F.lit("Homo sapiens").alias("organism"),
        F.coalesce("origin", F.lit("")).alias("origin"),
        F.col("pair_id").cast("long").alias("source_pair_id"),
        "ord",
    )


def in_order(*sources: DataFrame) -> DataFrame:
    """The union of sources; earlier ones win when records are equal. Columns that a source lacks are empty strings
    where others have strings, else null."""
    names = list(dict.fromkeys(c for s in sources for c in s.columns))
    kinds = {f.name: f.dataType.simpleString() for s in sources for f in s.schema.fields}
    out = None
    for rank, s in enumerate(sources):
        blank = {c: F.lit("" if kinds[c] == "string" else None).cast(kinds[c]) for c in names if c not in s.columns}
        s = s.withColumns(blank).withColumn("source_rank", F.lit(rank))
        out = s if out is None else out.unionByName(s)
    return out


# ---- the build ------------------------------------------------------------------------


def canonical_sides(records: DataFrame, of: Backend, keys: Sequence[str]) -> DataFrame:
    """Adds ``lefts, rights``: canonical molecules of each side, or null if one has none.

    A native backend stays a narrow expression. Others run once for each distinct molecule; sides are put
    together again by a join on the molecule and one aggregation over ``keys``.
    """
    records = records.withColumn("_sides", E.split_reaction(F.col("reaction")))
    if of.native:
        side = lambda name: E.all_or_null(F.transform(F.col(f"_sides.{name}"), of.canonical))
        return records.withColumn("lefts", side("reactants")).withColumn("rights", side("products")).drop("_sides")
    both = F.concat(F.transform("_sides.reactants", lambda m: F.struct(F.lit(True).alias("left"), m.alias("molecule"))), F.transform("_sides.products", lambda m: F.struct(F.lit(False).alias("left"), m.alias("molecule"))))
    each = records.where("_sides IS NOT NULL").select(*keys, F.explode(both).alias("m")).select(*keys, "m.*")
    named = each.join(dimension(each, "molecule", of), "molecule")
    gathered = named.groupBy(*keys).agg(
        F.bool_or(F.col("canonical").isNull() & F.col("left")).alias("bad_left"),
        F.bool_or(F.col("canonical").isNull() & ~F.col("left")).alias("bad_right"),
        F.collect_list(F.when(F.col("left"), F.col("canonical"))).alias("lefts"),
        F.collect_list(F.when(~F.col("left"), F.col("canonical"))).alias("rights"),
    )
    gathered = gathered.select(*keys, F.when(~F.col("bad_left"), F.col("lefts")).alias("lefts"), F.when(~F.col("bad_right"), F.col("rights")).alias("rights"))
    return records.drop("_sides").join(gathered, list(keys), "left")


def judged(records: DataFrame, order: Sequence[str], max_tokens: int = 300, drop_identity: bool = True, of: Backend | None = None) -> DataFrame:
    """Records with canonical sides, token counts and ``first_status``: what can be told of a record without the others. With a native backend
    this is narrow, and so works on streams."""
    rows = canonical_sides(records, of or Identity(), order)
    rows = rows.withColumn("reactant_smiles", E.join_molecules(F.col("lefts"))).withColumn("product_smiles", E.join_molecules(F.col("rights")))
    rows = rows.withColumn("src_n_tokens", F.size(E.atom_tokens(F.col("reactant_smiles")))).withColumn("tgt_n_tokens", F.size(E.atom_tokens(F.col("product_smiles"))))
    return rows.withColumn(
        "first_status",
        F.when(F.col("lefts").isNull() | F.col("rights").isNull(), "invalid")
        .when(F.lit(drop_identity) & (F.col("reactant_smiles") == F.col("product_smiles")), "identity")
        .when((F.col("src_n_tokens") > max_tokens) | (F.col("tgt_n_tokens") > max_tokens), "too_long")
        .otherwise("out"),
    )


def told(records: DataFrame, order: Sequence[str], max_tokens: int = 300, drop_identity: bool = True, extra_cols: Sequence[str] = (), dedup_extra_cols: Sequence[str] = (), of: Backend | None = None) -> DataFrame:
    """Every record with its ``status``, of those in STATUSES the first that fits; rejected records never count as the first of their kind.
    Extra columns that the records lack are empty."""
    if missing := set(dedup_extra_cols) - set(extra_cols):
        raise ValueError(f"columns to dedupe by that are no extra columns: {sorted(missing)}")
    if clash := set(extra_cols) & set(REACTION_COLUMNS):
        raise ValueError(f"extra columns with names of the core: {sorted(clash)}")
    for c in extra_cols:
        if c not in records.columns:
            records = records.withColumn(c, F.lit(""))
    rows = judged(records, order, max_tokens, drop_identity, of)
    return _duplicates_told(rows, ["reactant_smiles", "product_smiles", *dedup_extra_cols], order)


def processed(rows: DataFrame, source: str = "", extra_cols: Sequence[str] = ()) -> DataFrame:
    """The processed table of the rows of status ``out``, numbered; its last columns are ``extra_cols``."""
    out = rows.where("status = 'out'").select(
        "reactant_smiles",
        "product_smiles",
        F.lit(source).alias("source") if "source" not in extra_cols else F.col("source"),
        F.size("lefts").alias("n_reactants"),
        F.size("rights").alias("n_products"),
        "src_n_tokens",
        "tgt_n_tokens",
        *extra_cols,
    )
    return numbered(out, ["reactant_smiles", "product_smiles", *extra_cols]).select(*REACTION_COLUMNS, *extra_cols)


def build_reactions(
    records: DataFrame,
    order: Sequence[str],
    max_tokens: int = 300,
    source: str = "",
    drop_identity: bool = True,
    extra_cols: Sequence[str] = (),
    dedup_extra_cols: Sequence[str] = (),
    of: Backend | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The processed table, and every record with its ``status``, for ``build_stats``.

    ``order`` names columns that order the records totally; of equal ones the first stays.
    """
    rows = told(records, order, max_tokens, drop_identity, extra_cols, dedup_extra_cols, of)
    return processed(rows, source, extra_cols), rows


def _duplicates_told(rows: DataFrame, key: Sequence[str], order: Sequence[str], salts: int = 64) -> DataFrame:
    """``status`` from ``first_status``: of good rows with equal keys all but the first are duplicates.

    Rejects, which may share a key of nulls, are dealt by a hash and compared with none. A key of very many good rows is
    dealt over ``salts`` parts, and only the first row of each part meets those of the others.
    """
    spread = F.xxhash64(*order)
    good = F.col("first_status") == "out"
    first_in = lambda part: F.row_number().over(Window.partitionBy(*key, part).orderBy(*order)) == 1
    rows = rows.withColumn("_part", F.when(good, F.pmod(spread, F.lit(salts))).otherwise(spread))
    rows = rows.withColumn("_first", good & first_in("_part"))
    rows = rows.withColumn("_part", F.when(F.col("_first"), -1).otherwise(spread))
    rows = rows.withColumn("_first", F.col("_first") & first_in("_part"))
    return rows.withColumn("status", F.when(good & ~F.col("_first"), "duplicate").otherwise(F.col("first_status"))).drop("first_status", "_part", "_first")


def numbered(df: DataFrame, by: Sequence[str], name: str = "reaction_id") -> DataFrame:
    """Consecutive numbers from 0 in a total order, without sorting all rows in one task.

    Rows are range-partitioned and sorted; each partition starts after the counts of those before it.
    """
    from rxflow.sources.tables import with_ordinal

    return with_ordinal(df.drop(name).repartitionByRange(*by).sortWithinPartitions(*by), name)


def build_stats(rows: DataFrame) -> DataFrame:
    """One row: ``n_in`` and how many records have each status."""
    return rows.agg(F.count("*").alias("n_in"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES))


def attach_sequences(reactions: DataFrame, sequences: DataFrame) -> DataFrame:
    """``sequence`` and ``seq_len`` by accession; an inline sequence wins, rows without one go, and ids close up."""
    found = sequences.select(F.col("accession").alias("uniprot_id"), F.col("sequence").alias("_found"))
    inline = F.nullif(F.col("sequence"), F.lit("")) if "sequence" in reactions.columns else F.lit(None).cast("string")
    rows = reactions.join(found, "uniprot_id", "left").withColumn("sequence", F.coalesce(inline, F.nullif("_found", F.lit("")))).drop("_found")
    rows = rows.where("sequence IS NOT NULL").withColumn("seq_len", F.length("sequence"))
    back = numbered(rows.withColumnRenamed("reaction_id", "_old"), ["_old"]).drop("_old")
    return back.select(*reactions.columns, *[c for c in ("sequence", "seq_len") if c not in reactions.columns])


def first_of(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key in an order, found before any shuffle by partial minima."""
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first")).select(key, "_first.*")


def lacking(rows: DataFrame, held: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in no row of ``held``; rows without a key stay."""
    return rows.join(held.select(on).distinct(), on, "left_anti")


def train_products(reactions: DataFrame, split_col: str = "split") -> DataFrame:
    """Distinct product molecules of the training rows."""
    return reactions.where(F.col(split_col) == "train").select(F.explode(E.molecules(F.col("product_smiles"))).alias("smiles")).distinct()


def list_elements(df: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """``element`` of every list written as text, blank ones left out."""
    return df.select(F.explode(F.split(F.coalesce(column, F.lit("")), separator)).alias("element")).where(F.trim("element") != "")


def first_seen(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values in the order in which they come up."""
    return df.groupBy(column).agg(F.min(order).alias("_at")).orderBy("_at", column).select(column)
