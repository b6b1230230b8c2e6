"""What a processed table holds: counts, leaks, clusters, lengths, classes; one small table each. Tables with a median find it when they are made."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxflow.functions import exprs as E
from rxflow.operators.quantiles import median
from rxflow.operators.split import leaking_groups, overlap, split_counts
from rxflow.sources.tables import durable


#: Longer sequences and larger clusters count as these in histograms.
LENGTH_CLIP, CLUSTER_CLIP = 1500.0, 50.0


def _median(df: DataFrame, column: str) -> Column:
    return F.lit(median(df, column)).cast("double")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row that comes first; nulls are a key, too."""
    one = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_row"))
    return one.select(key, "_row.*").select(df.columns)


def value_counts(df: DataFrame, column: Column | str, name: str = "value") -> DataFrame:
    """``value, n``, most frequent first, equal ones by value."""
    c = F.col(column) if isinstance(column, str) else column
    return df.groupBy(c.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def histogram(df: DataFrame, value: str, bins: int, clip: float | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """``bin, bin_start, n`` of equal widths over [low, high], by default from the least to the largest value;
    values over ``clip`` count as it; the last bin is closed; empty bins are left out. One pass to find the range
    (none if it is given), one to count."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select((F.least(v, F.lit(float(clip))) if clip is not None else v).alias("v"))
    if low is None or high is None:
        edge = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        if edge["lo"] is None:
            return df.sparkSession.createDataFrame([], "bin int, bin_start double, n long")
        low, high = edge["lo"] if low is None else low, edge["hi"] if high is None else high
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    at = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    inside = rows.where((F.col("v") >= low) & (F.col("v") <= high))
    return inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_start"), "n").orderBy("bin")


def overview(df: DataFrame) -> DataFrame:
    """One row: rows, and distinct values of the columns there are (nulls don't count, empty strings do)."""
    some = [c for c in ("uniprot_id", "organism", "ec_num", "sequence", "enzyme_cluster") if c in df.columns]
    key = E.undirected_key(F.col("reactant_smiles"), F.col("product_smiles"))
    return df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("undirected_reactions"), *(F.countDistinct(c).alias(f"n_{c}") for c in some))


def cluster_sizes(df: DataFrame, cluster: str = "enzyme_cluster", member: str = "uniprot_id") -> DataFrame:
    return df.select(cluster, member).distinct().groupBy(cluster).agg(F.count("*").alias("size"))


def cluster_stats(sizes: DataFrame) -> DataFrame:
    """One row: clusters, singletons and their share, largest, mean and median size."""
    single = F.count_if(F.col("size") == 1)
    sizes = durable(sizes.select("size"))
    return sizes.agg(
        F.count("*").alias("n_clusters"),
        single.alias("n_singletons"),
        F.coalesce(F.try_divide(single.cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("singleton_share"),
        F.max("size").alias("largest"),
        F.avg("size").alias("mean_size"),
        _median(sizes, "size").alias("median_size"),
    )


def largest_clusters(df: DataFrame, cluster: str, member: str, label: Column, order: str, n: int = 12) -> DataFrame:
    """``cluster, size, label, label_share`` of the n largest; label is the most frequent one, of equal ones that which comes first."""
    one = first_per_key(df, member, order).withColumn("_label", label)
    each = one.groupBy(cluster, "_label").agg(F.count("*").alias("k"), F.min(order).alias("at"))
    best = F.max_by("_label", F.struct(F.col("k"), -F.col("at")))
    sums = each.groupBy(F.col(cluster).alias("cluster")).agg(F.sum("k").alias("size"), best.alias("label"), F.max("k").alias("_k"))
    return sums.select("cluster", "size", "label", (F.col("_k") / F.col("size")).alias("label_share")).orderBy(F.desc("size"), "cluster").limit(n)


def length_stats(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(value).alias("min"), F.floor(_median(df, value)).cast("long").alias("median"), F.max(value).alias("max"), F.avg(value).alias("mean"))


def side_stats(df: DataFrame) -> DataFrame:
    names = ("n_reactants", "n_products")
    tokens = ("src_n_tokens", "tgt_n_tokens")
    return df.agg(*(F.avg(c).alias(f"mean_{c}") for c in names), *(_median(df, c).alias(f"median_{c}") for c in tokens))


def split_summary(df: DataFrame, split_cols: Sequence[str], entity: str, reaction: Column) -> DataFrame:
    """For each split column its counts and how far test entities and reactions occur in train."""
    out = None
    rows = df.withColumn("_reaction", reaction)
    for c in split_cols:
        counts = split_counts(rows, c).groupBy().pivot("split", ["train", "valid", "test"]).agg(F.first("n"))
        one = counts.crossJoin(overlap(rows, entity, c).withColumnRenamed("share", "entity_overlap")).crossJoin(overlap(rows, "_reaction", c).withColumnRenamed("share", "reaction_overlap"))  # single rows
        one = one.select(F.lit(c).alias("split_col"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def profile(df: DataFrame) -> dict[str, DataFrame]:
    """All tables that the columns of ``df`` allow."""
    out = {"overview": overview(df), "reactions": side_stats(df)}
    has = set(df.columns).issuperset
    key = E.undirected_key(F.col("reactant_smiles"), F.col("product_smiles"))
    splits = [c for c in ("split", "enzyme_split") if c in df.columns]
    for c in splits:
        out[f"{c}_counts"] = split_counts(df, c)
    if splits and has(["uniprot_id"]):
        out["split_summary"] = split_summary(df, splits, "uniprot_id", key)
        out["entity_leaks"] = leaking_groups(df, "uniprot_id", splits[0])
    if has(["uniprot_id", "enzyme_cluster"]):
        sizes = cluster_sizes(df)
        out |= {"cluster_stats": cluster_stats(sizes), "cluster_sizes": value_counts(sizes, "size"), "cluster_size_histogram": histogram(sizes, "size", 50, clip=CLUSTER_CLIP, low=0.0, high=CLUSTER_CLIP)}
        if has(["ec_num"]):
            out["largest_clusters"] = largest_clusters(df, "enzyme_cluster", "uniprot_id", E.ec_class_name(F.col("ec_num")), "reaction_id")
    if has(["uniprot_id", "seq_len"]):
        entities = durable(first_per_key(df, "uniprot_id", "reaction_id").select("uniprot_id", "seq_len"))
        out |= {"sequence_lengths": length_stats(entities, "seq_len"), "sequence_length_histogram": histogram(entities, "seq_len", 50, clip=LENGTH_CLIP)}
    for side, n, size in (("reactants", "n_reactants", "src_n_tokens"), ("products", "n_products", "tgt_n_tokens")):
        out |= {f"{side}_counts": value_counts(df, n), f"{side}_token_histogram": histogram(df, size, 40)}
    if has(["ec_num"]):
        out["classes"] = value_counts(df, E.ec_class_name(F.col("ec_num")), "ec_class")
    return out


# ---- browsing -------------------------------------------------------------------------


def entries(df: DataFrame) -> DataFrame:
    """Rows to choose from: missing columns are empty, ``label`` is short."""
    if "reactant_smiles" not in df.columns:
        raise ValueError("missing columns: reactant_smiles")
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    dash = lambda c: F.when(c == "", "—").otherwise(c)
    index = F.col("reaction_id") if "reaction_id" in df.columns else F.monotonically_increasing_id()
    label = F.concat(
        F.lit("#"), index.cast("string"), F.lit(" · EC "), dash(text("ec_num")), F.lit(" · "), dash(F.substring(text("organism"), 1, 24)), F.lit(" · "), dash(text("uniprot_id")), F.lit(" — "), E.shortened(text("reactant_smiles"))
    )
    named = [text(c).alias(c) for c in ("reactant_smiles", "product_smiles", "ec_num", "organism", "uniprot_id", "sequence")]
    return df.select(index.alias("index"), *named, E.molecules(text("reactant_smiles")).alias("reactants"), E.molecules(text("product_smiles")).alias("references"), label.alias("label"))


def entity_options(df: DataFrame, limit: int = 400, order: str = "reaction_id") -> DataFrame:
    """The first ``limit`` entities by first appearance, with a label; blank ids are skipped."""
    if "uniprot_id" not in df.columns:
        return df.sparkSession.createDataFrame([], "uniprot_id string, ec_num string, organism string, sequence string, seq_len int, label string")
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")
    size = F.coalesce(F.col("seq_len"), F.length(text("sequence"))) if "seq_len" in df.columns else F.length(text("sequence"))
    rows = df.where(F.coalesce("uniprot_id", F.lit("")) != "").select(order, "uniprot_id", text("ec_num").alias("ec_num"), text("organism").alias("organism"), text("sequence").alias("sequence"), size.cast("int").alias("seq_len"))
    one = first_per_key(rows, "uniprot_id", order).orderBy(order).limit(limit)
    ec = F.when(F.col("ec_num") == "", "EC —").otherwise(F.concat(F.lit("EC "), "ec_num"))
    label = F.concat("uniprot_id", F.lit(" · "), ec, F.lit(" · "), F.substring("organism", 1, 30), F.lit(" ("), F.col("seq_len").cast("string"), F.lit(" aa)"))
    return one.orderBy(order).withColumn("label", label).drop(order)


def search(rows: DataFrame, needle: str, columns: Sequence[str] = ("ec_num", "organism", "uniprot_id"), limit: int = 500, order: str = "index") -> DataFrame:
    return rows.where(E.matches(needle, *map(F.col, columns))).orderBy(order).limit(limit)
