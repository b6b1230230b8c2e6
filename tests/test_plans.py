import duckdb
import pytest
from pyspark.sql import functions as F

from rxflow.operators import profile
from rxflow.plans import catalog, runner
from rxflow.streaming import incremental

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def cells(rows):
    shown = lambda x: "~" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(shown, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = cells(df.select(names).collect())
    found = duck.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == names
    order = [cols.index(c) for c in names]
    assert got == cells([tuple(r[i] for i in order) for r in found.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).first()["train"] > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_read_only_what_they_need(spark, sf):
    text = plan(catalog.queries()["complement_rows"](spark, sf))
    assert "ReadSchema: struct<doc_id:bigint>" in text and "Cartesian" not in text
    assert "Python" not in plan(catalog.queries()["build_stats"](spark, sf))
    assert plan(catalog.queries()["metrics_matrix"](spark, sf)).count("Python") == 0
    for name in ("overlap_leakage", "jaccard_pairs", "resolve_pick_one"):
        assert "CartesianProduct" not in plan(catalog.queries()[name](spark, sf))


def table(spark):
    rows = [(i, f"A{i % 4}", f"B{i % 4}", f"1.{i}" if i % 2 else "x", f"E{i // 2}", "M" * (i + 1), ["train"] * 8 + ["valid"] * 2 + ["test"] * 2) for i in range(12)]
    rows = [(*r[:6], r[6][r[0]], r[0] // 2 % 6, r[0] + 1) for r in rows]
    return spark.createDataFrame(rows, "reaction_id long, reactant_smiles string, product_smiles string, ec_num string, uniprot_id string, sequence string, split string, enzyme_cluster long, seq_len int").withColumns({c: F.lit(1) for c in ("n_reactants", "n_products", "src_n_tokens", "tgt_n_tokens")})


def test_profile(spark):
    found = profile.profile(table(spark))
    assert {"overview", "split_counts", "split_summary", "cluster_stats", "largest_clusters", "sequence_lengths", "classes"} <= set(found)
    assert found["cluster_stats"].first()["n_clusters"] == 6 and found["sequence_lengths"].first()["max"] == 11
    assert "cluster_stats" in runner.profile_report(found)
    assert set(profile.profile(table(spark).drop("uniprot_id", "enzyme_cluster", "seq_len"))) >= {"overview", "classes"}


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (99.0,), (None,), (float("nan"),)], "x double")
    assert {r["bin"]: r["n"] for r in profile.histogram(rows, "x", 2, clip=10).collect()} == {0: 1, 1: 3}
    assert profile.histogram(rows.limit(0), "x", 2).count() == 0
    assert profile.histogram(rows.limit(1), "x", 2).count() == 1


def test_browsing(spark):
    rows = profile.entries(table(spark).drop("organism"))
    first = rows.orderBy("index").first()
    assert first["label"] == "#0 · EC x · — · E0 — A0" and first["reactants"] == ["A0"]
    assert profile.search(rows, "e5").count() == 2
    with pytest.raises(ValueError):
        profile.entries(spark.range(1))
    assert [r["uniprot_id"] for r in profile.entity_options(table(spark), 3).collect()] == ["E0", "E1", "E2"]
    assert profile.entity_options(spark.range(1)).count() == 0


def test_content_hash_ignores_order_and_ids(spark):
    a = spark.createDataFrame([(0, "x", None), (1, "y", "1:a")], "reaction_id long, s string, t string")
    b = spark.createDataFrame([(5, "y", "1:a"), (9, "x", None)], "reaction_id long, s string, t string").repartition(3)
    h = lambda df: runner.content_hash(df).first()[0]
    assert h(a) == h(b) != h(a.unionByName(a.limit(1))) and runner.content_hash_exact(a) == runner.content_hash_exact(b)
    assert h(a) != h(a.withColumn("t", F.coalesce("t", F.lit("~"))))


def test_dataset_build_and_run(spark, tmp_path):
    raw = spark.range(200).select(F.concat(F.lit("A"), (F.col("id") % 90).cast("string"), F.lit(">>B"), (F.col("id") % 45).cast("string")).alias("unmapped"), F.col("id").alias("rxn_idx"), F.lit("1.1").alias("ec_num"), F.lit("o").alias("organism"), F.lit("d").alias("source"), F.lit(0.9).alias("quality"), F.lit(True).alias("natural"), F.lit("single").alias("steps"), F.lit("uniprot").alias("protein_db"), F.concat(F.lit("['P"), (F.col("id") % 20).cast("string"), F.lit("']")).alias("protein_refs"), F.col("id").alias("ord"))
    config = runner.BuildConfig("plain")
    df, rows = runner.build_plain(raw, config)
    runner.checked(df, [("_undirected", "split")])
    manifest = runner.write_dataset(df, rows, str(tmp_path / "data"), tmp_path / "manifest.json", config)
    assert manifest["stats"]["n_in"] == 200 and manifest["stats"]["n_out"] == sum(manifest["splits"]["split"].values()) == 90

    from rxflow.operators import build

    seqs = spark.range(20).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("accession"), F.repeat(F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), F.col("id").cast("int") + 1, F.lit(5)), 4).alias("sequence"))
    forced = F.col("uniprot_id") == "P3"
    both, rows = runner.build_with_sequences([build.load_with_accessions(raw)], seqs, config.but(split_mode="exact"), forced=forced)
    runner.checked(both, [("_undirected", "split"), ("enzyme_cluster", "enzyme_split")], forced)
    assert {"sequence", "seq_len", "enzyme_cluster", "enzyme_split"} <= set(both.columns)

    frame = spark.createDataFrame([(0, ["A"], ["A", "B"])], "row_id long, references array<string>, predictions array<string>")
    out = runner.evaluate_run(frame, runner.RunMetadata.capture(spark, "test run"), tmp_path / "runs", spark.createDataFrame([("A",)], "smiles string"))
    held = runner.load_run(out)
    assert {m["name"] for m in held["metrics"]} == {"validity", "per_molecule_validity", "uniqueness", "novelty", "mean_tanimoto_top1"}
    assert len(held["tables"]["top_k_metrics"]) == 6 and held["metadata"]["name"] == "test run"
    with pytest.raises(KeyError):
        runner.evaluator("other")


def test_flatten():
    assert runner.flatten({"a": {"b": 1, "c": []}, "d": [1, 2]}) == {"a.b": 1, "a.c": "[]", "d": "1, 2"}


def test_reports_of_the_environment(tmp_path):
    assert runner.capture_git(tmp_path) == {"commit": "", "branch": "", "dirty": False}
    assert runner.capture_libraries(("pyspark", "no-such-package"))["no-such-package"] == "absent"


def test_stream_build_is_incremental(spark, tmp_path):
    raw = spark.range(6).select(F.concat(F.lit("A"), (F.col("id") % 3).cast("string"), F.lit(">>B")).alias("unmapped"), F.col("id").alias("rxn_idx"), F.lit("1").alias("ec_num"), F.lit("o").alias("organism"), F.lit("d").alias("source"), F.lit(0.9).alias("quality"), F.lit(True).alias("natural"), F.lit("single").alias("steps"), F.col("id").alias("ord"))
    raw.where("id < 3").drop("id").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    src = spark.readStream.schema(raw.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    go = lambda: incremental.build_stream(src, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    go()
    assert incremental.read_stream_table(spark, str(tmp_path / "out")).count() == 3
    raw.withColumn("unmapped", F.when(F.col("ord") == 5, "Z>>B").otherwise(F.col("unmapped"))).where("ord >= 3").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    go()
    assert incremental.read_stream_table(spark, str(tmp_path / "out")).count() == 4
