"""Whole dataset runs: what is written is counted by the job that writes it, and a manifest says what went in and what came out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rxflow.functions import exprs as E
from rxflow.functions.backends import Backend
from rxflow.operators import build, split
from rxflow.plans.runner import EXTRA, BuildConfig, checked, content_hash, grouped, utc_now
from rxflow.schema import SPLITS
from rxflow.sources import tables

#: Finds sequences: from ``accession`` to ``accession, sequence``, and perhaps ``sequence_source``.
Find = Callable[[DataFrame], DataFrame]


def written(df: DataFrame, path: str, counts: dict[str, Column], without: Sequence[str] = ()) -> dict[str, int]:
    """Writes a table, less some columns, and counts its rows in the same job."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("rows"), *(F.coalesce(c, F.lit(0)).alias(name) for name, c in counts.items())).drop(*without).write.mode("overwrite").parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def _statuses() -> dict[str, Column]:
    return {f"n_{s}": F.count_if(F.col("status") == s) for s in build.STATUSES}


def _splits(*columns: str) -> dict[str, Column]:
    return {f"{c}:{s}": F.count_if(F.col(c) == s) for c in columns for s in SPLITS}


def _by_split(found: dict[str, int], column: str) -> dict[str, int]:
    return {s: found[f"{column}:{s}"] for s in SPLITS}


def _stats(found: dict[str, int]) -> dict[str, int]:
    return {"n_in": found["rows"]} | {f"n_{s}": found[f"n_{s}"] for s in build.STATUSES}


def _files(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """SHA-256 of each file, by its name."""
    rows = [r for p in paths for r in tables.file_hashes(spark, p).collect()]  # one row a file
    return {Path(r["path"]).name: r["sha256"] for r in rows}


def _distinct(df: DataFrame, *columns: str) -> dict[str, int]:
    return df.agg(*(F.countDistinct(c).alias(c) for c in columns)).first().asDict()


def run_with_sequences(
    spark: SparkSession, sources: dict[str, DataFrame], find: Find, config: BuildConfig, folder: str, files: Sequence[str] = (), resolved: DataFrame | None = None, forced: Column | None = None, of: Backend | None = None
) -> dict[str, Any]:
    """Records with accessions, best source first, to a table with sequences, clusters and both splits, and its manifest.

    Statuses are counted while all judged records are written, splits and provenance while the table is; ``find`` is asked for accessions without
    an inline sequence. ``forced`` picks the rows whose groups go to test.
    """
    records = build.in_order(*sources.values())
    extra = [*EXTRA, "uniprot_id", "accession_source", *[c for c in ("organism_class", "sequence") if c in records.columns]]
    kind = lambda name: F.col("accession_source") == name
    rows = build.told(records, ["source_rank", "ord", "pos"], config.max_tokens, extra_cols=extra, dedup_extra_cols=["uniprot_id"], of=of)
    loaded = {f"loaded:{name}": F.count_if(kind(name)) for name in sources}
    stage = written(rows, f"{folder}/records", _statuses() | loaded)
    pairs = tables.durable(build.processed(spark.read.parquet(f"{folder}/records"), config.name, extra))

    inline = F.coalesce("sequence", F.lit("")) != "" if "sequence" in pairs.columns else F.lit(False)
    wanted = tables.durable(pairs.where(~inline).select(F.col("uniprot_id").alias("accession")).distinct())
    found = tables.durable(find(wanted).where(F.coalesce("sequence", F.lit("")) != ""))
    told_by = F.col("sequence_source") if "sequence_source" in found.columns else F.lit("primary")
    origins = {r["s"]: r["n"] for r in found.groupBy(told_by.alias("s")).agg(F.count("*").alias("n")).collect()}

    df = grouped(build.attach_sequences(pairs, found.select("accession", "sequence")), config)
    picked = F.lit(False) if forced is None else F.coalesce(forced, F.lit(False))
    df = df.withColumn("_before", F.col("split"))
    if forced is not None:
        df = split.force_to_test(df, forced, "_undirected", ["split"])
        df = split.force_to_test(df, forced, "enzyme_cluster", ["enzyme_split"])
    df = tables.durable(df)
    checked(df, [("_undirected", "split"), ("enzyme_cluster", "enzyme_split")], forced)
    human = F.col("organism_class") == "human" if "organism_class" in df.columns else F.lit(False)
    counts = _splits("split", "enzyme_split") | {f"source:{name}": F.count_if(kind(name)) for name in sources}
    counts |= {"cyp_human": F.count_if(kind("cyp") & human), "forced": F.count_if(picked), "pulled": F.count_if((F.col("_before") != "test") & (F.col("split") == "test") & ~picked)}
    final = written(df, f"{folder}/reactions", counts, without=("_undirected", "_before"))

    held = spark.read.parquet(f"{folder}/reactions")
    distinct = _distinct(held, "ec_num", "enzyme_cluster", "uniprot_id")
    # The names of a manifest's entries.
    manifest = {
        "dataset_id": config.name,
        "created": utc_now(),
        "content_hash": content_hash(held).first()[0],
        "raw_sha256": _files(spark, files),
        "filters": {"max_tokens": config.max_tokens, "min_quality": E.MIN_QUALITY, "only_single_step": True, "uniprot_dbs": list(E.ACCESSION_DBS)},
        "multi_accession": "explode_all" if config.explode_all else "pick_one",
        "accession_source_counts": {name: final[f"source:{name}"] for name in sources},
        "records_loaded": {name: stage[f"loaded:{name}"] for name in sources},
        "build_stats": _stats(stage),
        "split": {"fractions": list(config.fractions), "seed": config.seed, "group": "undirected_reaction_key"},
        "enzyme_split": {"method": config.cluster_method, "k": config.k, "threshold": config.threshold, "group": "enzyme_cluster", "n_clusters": distinct["enzyme_cluster"], "per_split": _by_split(final, "enzyme_split")},
        "n_pairs_before_seq": stage["n_out"],
        "n_accessions_need_fetch": wanted.count(),
        "sequences_found": origins,
        "n_dropped_no_seq": stage["n_out"] - final["rows"],
        "n_out": final["rows"],
        "per_split": _by_split(final, "split"),
        "n_ec_numbers": distinct["ec_num"],
        "n_unique_accessions": distinct["uniprot_id"],
        "config": tables.plain(config),
    }
    if "cyp" in sources:
        manifest["cyp"] = {
            "n_cyp_rows_loaded": stage["loaded:cyp"],
            "n_cyp_kept": final["source:cyp"],
            "n_cyp_human": final["cyp_human"],
            "n_cyp_non_human": final["source:cyp"] - final["cyp_human"],
            "n_human_forced_test": final["forced"],
            "n_rows_pulled_into_test_by_human_collision": final["pulled"],
        }
    if resolved is not None:
        manifest["resolved_input"] = resolved_counts(resolved)
    tables.save_json(spark, f"{folder}/build_manifest.json", manifest)
    return manifest


def resolved_counts(resolved: DataFrame) -> dict[str, int]:
    """Pairs of a table of found accessions (``;``-joined), and the distinct accessions in it."""
    return {"n_pairs_resolved": resolved.count(), "n_distinct_resolved_accessions": build.list_elements(resolved, "accessions").select(F.countDistinct("element")).first()[0]}


def run_drug_pairs(spark: SparkSession, pairs: DataFrame, find: Find, config: BuildConfig, folder: str, files: Sequence[str] = (), of: Backend | None = None) -> dict[str, Any]:
    """Parents and metabolites with the isoform that makes them, as an evaluation-only table, and its manifest.

    Raw pairs are counted by isoform in the job that writes the judged records.
    """
    extra, known = ["uniprot_id", "cyp", "ec_num", "organism", "origin", "source_pair_id"], sorted(build.CYP_TO_ACCESSION)
    seen = Observation()
    raw = pairs.observe(seen, F.count("*").alias("n_raw"), *(F.count_if(F.col("cyp") == c).alias(c) for c in known))
    rows = build.told(build.load_drug_pairs(raw), ["ord"], config.max_tokens, extra_cols=extra, dedup_extra_cols=["uniprot_id"], of=of)
    stage = written(rows, f"{folder}/records", _statuses())
    by_isoform = {k: int(v) for k, v in seen.get.items()}
    out = build.processed(spark.read.parquet(f"{folder}/records"), config.name, extra)
    wanted = out.select(F.col("uniprot_id").alias("accession")).distinct()
    df = build.attach_sequences(out, find(wanted).select("accession", "sequence")).withColumn("split", F.lit("test"))
    final = written(df, f"{folder}/reactions", {})
    held = spark.read.parquet(f"{folder}/reactions")
    n_raw, kept = by_isoform.pop("n_raw"), {c: n for c, n in by_isoform.items() if n}
    manifest = {
        "dataset_id": config.name,
        "created": utc_now(),
        "content_hash": content_hash(held).first()[0],
        "raw_files": _files(spark, files),
        "n_raw_pairs": n_raw,
        "n_dropped_unmapped_cyp": n_raw - sum(kept.values()),
        "kept_by_cyp": kept,
        "n_dropped_no_seq": stage["n_out"] - final["rows"],
        "n_out": final["rows"],
        "split": "all rows are test (evaluation-only)",
        "max_tokens": config.max_tokens,
        "build_stats": _stats(stage),
        "cyp_to_uniprot": dict(sorted(build.CYP_TO_ACCESSION.items())),
        "n_enzymes": _distinct(held, "uniprot_id")["uniprot_id"],
    }
    tables.save_json(spark, f"{folder}/build_manifest.json", manifest)
    return manifest


def run_resolve(spark: SparkSession, raw: DataFrame, search: Callable[[DataFrame], DataFrame], path: str) -> dict[str, int]:
    """Looks for the accessions of (class, organism) pairs that have none, and writes them as CSV: ``ec_num, organism, n_accessions, accessions``.

    ``search`` gives ``ec_num, organism, accessions`` (an array) of the pairs that it could look up; a pair without hits stays in the table.
    """
    pairs = tables.durable(build.accession_less_pairs(raw))
    found = search(pairs).select("ec_num", "organism", F.size("accessions").cast("long").alias("n_accessions"), F.array_join("accessions", ";").alias("accessions"))
    seen = Observation()
    counted = found.observe(seen, F.count("*").alias("n_pairs"), F.coalesce(F.sum("n_accessions"), F.lit(0)).alias("n_accessions"))
    tables.write_csv(counted, path)
    held = spark.read.options(header=True, escape='"').csv(path)
    distinct = _distinct(held.where(F.coalesce("accessions", F.lit("")) != ""), "ec_num")["ec_num"]
    return {k: int(v) for k, v in seen.get.items()} | {"n_queries": pairs.count(), "n_classes_found": distinct, "n_distinct_accessions": resolved_counts(held)["n_distinct_resolved_accessions"]}
