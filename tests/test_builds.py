import hashlib

import pytest
from pyspark.sql import functions as F

from rxflow.operators import build
from rxflow.plans import builds, runner
from rxflow.sources import lookups, tables

RAW = "unmapped string, rxn_idx long, ec_num string, organism string, source string, quality double, natural boolean, steps string, protein_db string, protein_refs string, ord long"


def raw(spark):
    rows = []
    for i in range(60):
        db, refs = ("uniprot", f"['P{i % 7}', 'Q{i % 3}']") if i % 3 else ("genbank", "[]")
        rows.append((f"A{i % 20}>>B{i % 10}", i, f"{i % 4 + 1}.1", f"org{i % 5}" if i % 6 else None, "d", 1.0 if i % 11 else 0.1, True, "single", db, refs, i))
    rows += [("same>>same", 60, "1.1", "org1", "d", 1.0, True, "single", "uniprot", "['P1']", 60), ("broken", 61, "1.1", "org1", "d", 1.0, True, "single", "uniprot", "'P1'", 61)]
    return spark.createDataFrame(rows, RAW)


def cyp(spark):
    names = ["sub_Smiles1", "pro_Smiles1", "blast", "Symbol", "Uniprot", "EC number", "Species1", "Species", "Txid", "ord"]
    rows = [(f"C{i}", f"D{i}", "MKLV" * (i + 1), "CYP1", f"P9{i}", "1.14", "Homo sapiens" if i < 2 else "Mus", "animal", 9606.0 if i < 2 else 10090.0, i) for i in range(5)]
    rows += [("A1", "B1", "MKAA", "CYP1", "P1", "1.14", "Homo sapiens", "animal", 9606.0, 5), ("C9", None, "M", "X", "P", "", "", "", None, 6)]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {'double' if n == 'Txid' else 'long' if n == 'ord' else 'string'}" for n in names))


def sequences(spark):
    rows = [(f"P{i}", "ACDEFGHIKL"[i:] * 3) for i in range(6)] + [("Q0", "MMMMKKKK"), ("Q1", "LLLLWWWW")]
    first = spark.createDataFrame(rows, "accession string, sequence string")
    archive = spark.createDataFrame([("Q2", "GGGGHHHH")], "accession string, sequence string")
    return lambda wanted: lookups.with_fallback(spark, wanted, lambda w: w.join(first, "accession"), lambda w: w.join(archive, "accession"))


def test_run_with_sequences_counts_while_it_writes(spark, tmp_path):
    data, folder = raw(spark), str(tmp_path / "plus")
    resolved = spark.createDataFrame([("1.1", "org1", "P3;P4", 0), ("2.1", "org3", "P3;P5;", 1), ("3.1", "org2", None, 2)], "ec_num string, organism string, accessions string, ord long")
    (tmp_path / "raw.csv").write_text("x,y\n")
    sources = {"curated": build.load_with_accessions(data), "resolved": build.load_resolved(data, resolved), "cyp": build.load_cyp(cyp(spark))}
    human = F.coalesce(F.col("organism_class") == "human", F.lit(False))
    config = runner.BuildConfig("plus", k=2, threshold=0.5)
    manifest = builds.run_with_sequences(spark, sources, sequences(spark), config, folder, [str(tmp_path / "raw.csv")], resolved, human)
    held = spark.read.parquet(f"{folder}/reactions")
    rows = held.collect()
    judged = spark.read.parquet(f"{folder}/records").collect()
    stats = manifest["build_stats"]
    assert stats["n_in"] == len(judged) == sum(v for k, v in stats.items() if k != "n_in")
    assert all(stats[f"n_{s}"] == sum(r["status"] == s for r in judged) for s in build.STATUSES) and stats["n_identity"] >= 1
    of = lambda c, v: sum(r[c] == v for r in rows)
    assert manifest["accession_source_counts"] == {s: of("accession_source", s) for s in ("curated", "resolved", "cyp")}
    assert manifest["per_split"] == {s: of("split", s) for s in ("train", "valid", "test")} and manifest["enzyme_split"]["per_split"] == {s: of("enzyme_split", s) for s in ("train", "valid", "test")}
    assert manifest["n_out"] == len(rows) and manifest["n_pairs_before_seq"] - manifest["n_dropped_no_seq"] == len(rows) and manifest["n_dropped_no_seq"] > 0
    assert manifest["n_ec_numbers"] == len({r["ec_num"] for r in rows}) and manifest["enzyme_split"]["n_clusters"] == len({r["enzyme_cluster"] for r in rows})
    assert manifest["cyp"]["n_cyp_human"] == sum(r["accession_source"] == "cyp" and r["organism_class"] == "human" for r in rows) >= 2
    assert manifest["cyp"]["n_human_forced_test"] == sum(r["organism_class"] == "human" for r in rows) and all(r["split"] == r["enzyme_split"] == "test" for r in rows if r["organism_class"] == "human")
    assert manifest["resolved_input"] == {"n_pairs_resolved": 3, "n_distinct_resolved_accessions": 3}
    assert manifest["raw_sha256"] == {"raw.csv": hashlib.sha256(b"x,y\n").hexdigest()} and manifest["sequences_found"]["archive"] == 1
    assert tables.load_json(spark, f"{folder}/build_manifest.json") == manifest and "_before" not in held.columns
    again = builds.run_with_sequences(spark, sources, sequences(spark), config, folder, [], resolved, human)
    assert again["content_hash"] == manifest["content_hash"]


def test_counts_are_those_of_one_write(spark, tmp_path):
    rows = spark.range(10, numPartitions=4).withColumn("_x", F.col("id") % 3)
    got = builds.written(rows, str(tmp_path / "a"), {"threes": F.count_if(F.col("_x") == 0), "total": F.sum("id")}, without=("_x",))
    assert got == {"rows": 10, "threes": 4, "total": 45} and spark.read.parquet(str(tmp_path / "a")).columns == ["id"]
    assert builds.written(rows.where("id > 99"), str(tmp_path / "b"), {"total": F.sum("id")}) == {"rows": 0, "total": 0}


def test_drug_pairs(spark, tmp_path):
    rows = [(i, f"C{i}", f"D{i}", ["CYP1A2", "CYP2D6", "unknown", None][i % 4], "db", i) for i in range(10)]
    pairs = spark.createDataFrame(rows, "pair_id long, parent_smiles string, metabolite_smiles string, cyp string, origin string, ord long")
    found = spark.createDataFrame([("P05177", "MKLV")], "accession string, sequence string")
    manifest = builds.run_drug_pairs(spark, pairs, lambda w: w.join(found, "accession"), runner.BuildConfig("drugs"), str(tmp_path / "drugs"))
    assert (manifest["n_raw_pairs"], manifest["n_dropped_unmapped_cyp"], manifest["kept_by_cyp"]) == (10, 4, {"CYP1A2": 3, "CYP2D6": 3})
    assert (manifest["build_stats"]["n_out"], manifest["n_dropped_no_seq"], manifest["n_out"], manifest["n_enzymes"]) == (6, 3, 3, 1)
    held = spark.read.parquet(str(tmp_path / "drugs" / "reactions"))
    assert {r["split"] for r in held.collect()} == {"test"} and sorted(r["reaction_id"] for r in held.collect()) == [0, 1, 2]


def test_resolve_run(spark, tmp_path):
    data = raw(spark)
    asked = build.accession_less_pairs(data).collect()
    hits = {(r["ec_num"], r["organism"]): [f"X{k % 3}", f"Y{k}"][: k % 3] for k, r in enumerate(asked)}
    search = lambda pairs: lookups.search_accessions(spark, pairs, str(tmp_path / "cache"), fetch_one=lambda ec, organism: hits[ec, organism])
    got = builds.run_resolve(spark, data, search, str(tmp_path / "resolved"))
    assert got["n_queries"] == got["n_pairs"] == len(asked) and got["n_accessions"] == sum(map(len, hits.values()))
    assert got["n_distinct_accessions"] == len({a for h in hits.values() for a in h}) and got["n_classes_found"] == len({ec for (ec, _), h in hits.items() if h})
    back = spark.read.options(header=True, escape='"').csv(str(tmp_path / "resolved")).withColumn("ord", F.monotonically_increasing_id())
    assert build.load_resolved(data, back).count() > 0


@pytest.mark.parametrize(("refs", "builder", "search"), [("['A']", True, True), ("('A', 'B')", True, True), ("('A',)", True, True), ("'A'", True, False), ("('A')", True, False), ("[]", False, False), ("()", False, False), (None, False, False), ("A b", False, False)])
def test_two_notions_of_having_an_accession(spark, refs, builder, search):
    rows = spark.createDataFrame([("uniprot", refs), ("genbank", refs), (None, refs)], "db string, refs string")
    got = [tuple(r) for r in rows.select(build.has_accession(F.col("db"), F.col("refs")), build.has_accession(F.col("db"), F.col("refs"), listed=True)).collect()]
    assert got == [(builder, search), (False, False), (False, False)]


def test_train_products_lists_and_first_seen(spark):
    rows = spark.createDataFrame([(0, "C.O", "train"), (1, "O.N", "train"), (2, "F", "test")], "reaction_id long, product_smiles string, split string")
    assert {r[0] for r in build.train_products(rows).collect()} == {"C", "O", "N"}
    lists = spark.createDataFrame([("a;b;;a",), (None,), (" ;c",)], "x string")
    assert sorted(r[0] for r in build.list_elements(lists, "x").collect()) == ["a", "a", "b", "c"]
    seen = spark.createDataFrame([("b", 3), ("a", 5), ("b", 1), ("c", 2)], "x string, at int")
    assert [r[0] for r in build.first_seen(seen, "x", "at").collect()] == ["b", "c", "a"]
