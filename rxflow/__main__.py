"""Command line: ``python -m rxflow profile|evaluate|build|drug-pairs ...``. Paths may be in any store that Spark reads."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxflow import schema
from rxflow.functions.backends import backend
from rxflow.operators import build, profile
from rxflow.plans import builds, runner
from rxflow.sources import tables


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="rxflow")
    does = out.add_subparsers(dest="command", required=True)
    one = does.add_parser("profile", help="tables and histograms of a processed table, as text")
    one.add_argument("table")
    one.add_argument("--out", help="file for the report; it is printed otherwise")
    one = does.add_parser("evaluate", help="metrics of references and ranked predictions (row_id, references, predictions)")
    one.add_argument("frame")
    one.add_argument("--name", required=True)
    one.add_argument("--runs", default="runs")
    one.add_argument("--train", help="processed table whose training products are not novel")
    one.add_argument("--split-column", default="split")
    one.add_argument("--backend", default="pure")
    one = does.add_parser("build", help="raw reactions and sequences to a table with splits and clusters")
    one.add_argument("raw", help="CSV of raw reactions")
    one.add_argument("sequences", help="Parquet of accession, sequence")
    one.add_argument("folder")
    one.add_argument("--resolved", help="CSV of accessions found for classes and organisms")
    one.add_argument("--cyp", help="CSV of cytochrome reactions, latin-1; their human rows go to test")
    one = does.add_parser("drug-pairs", help="parents and metabolites to an evaluation-only table")
    one.add_argument("pairs")
    one.add_argument("sequences")
    one.add_argument("folder")
    for name in ("build", "drug-pairs"):
        does.choices[name].add_argument("--preset", default="with_sequences" if name == "build" else "drug_pairs")
        does.choices[name].add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
        does.choices[name].add_argument("--backend", default="pure")
    return out


def _build(spark: SparkSession, given: argparse.Namespace) -> dict:
    config = runner.configured(given.preset, given.set)
    raw = tables.read_csv(spark, given.raw, schema.RAW_REACTIONS, ordinal="ord")
    sources = {"curated": build.load_with_accessions(raw)}
    files, resolved, forced = [given.raw], None, None
    if given.resolved:
        resolved = tables.read_csv(spark, given.resolved, schema.RESOLVED, ordinal="ord")
        sources["resolved"] = build.load_resolved(raw, resolved, config.explode_all)
        files.append(given.resolved)
    if given.cyp:
        sources["cyp"] = build.load_cyp(tables.read_csv(spark, given.cyp, schema.CYP_REACTIONS, encoding="ISO-8859-1", ordinal="ord"))
        files.append(given.cyp)
        forced = F.col("organism_class") == "human"
    return builds.run_with_sequences(spark, sources, _find(spark, given.sequences), config, given.folder, files, resolved, forced, backend(given.backend))


def _find(spark: SparkSession, path: str) -> builds.Find:
    held = spark.read.parquet(path).select("accession", "sequence")
    return lambda wanted: wanted.join(held, "accession")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs a command; returns (and prints) the report or manifest."""
    given = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("rxflow").getOrCreate()
    if given.command == "profile":
        said = runner.profile_report(profile.profile(spark.read.parquet(given.table)), given.table)
        if given.out:
            tables.write_text(given.out, said)
    elif given.command == "evaluate":
        train: DataFrame | None = build.train_products(spark.read.parquet(given.train), given.split_column) if given.train else None
        said = str(runner.evaluate_run(spark.read.parquet(given.frame), runner.RunMetadata.capture(spark, given.name), given.runs, train, backend(given.backend)))
    elif given.command == "build":
        said = json.dumps(_build(spark, given), indent=2, sort_keys=True)
    else:
        pairs = tables.read_csv(spark, given.pairs, schema.DRUG_PAIRS, ordinal="ord")
        manifest = builds.run_drug_pairs(spark, pairs, _find(spark, given.sequences), runner.configured(given.preset, given.set), given.folder, [given.pairs], backend(given.backend))
        said = json.dumps(manifest, indent=2, sort_keys=True)
    print(said)
    return said


if __name__ == "__main__":
    main()
