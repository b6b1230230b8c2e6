from collections import Counter

import pytest
from pyspark.sql import functions as F

from rxflow.functions.backends import Pure
from rxflow.operators import build
from rxflow.schema import REACTION_COLUMNS

SIX = ["CCO>>CC=O", "OCC>>O=CC", "CCO>>(((", "CCO>>OCC", "CCO", "CCC>>CCCO"]


def records(spark, reactions, **more):
    rows = [(i, r) for i, r in enumerate(reactions)]
    return spark.createDataFrame(rows, "ord int, reaction string").withColumns({k: F.lit(v) for k, v in more.items()})


def stats(rows):
    return build.build_stats(rows).first().asDict()


def test_every_reject_is_counted_once(spark):
    out, rows = build.build_reactions(records(spark, SIX), ["ord"], of=Pure())
    assert stats(rows) == {"n_in": 6, "n_invalid": 2, "n_identity": 1, "n_too_long": 0, "n_duplicate": 1, "n_out": 2}
    assert out.columns == list(REACTION_COLUMNS) and sorted(r["reaction_id"] for r in out.collect()) == [0, 1]


def test_token_cap_and_identity(spark):
    _, rows = build.build_reactions(records(spark, ["C" * 50 + ">>CO"]), ["ord"], max_tokens=10)
    assert stats(rows)["n_too_long"] == 1
    _, rows = build.build_reactions(records(spark, ["CCO>>CCO"]), ["ord"], drop_identity=False)
    assert stats(rows)["n_out"] == 1


def test_dedupe_by_class(spark):
    rows = spark.createDataFrame([(0, "A>>B", "1"), (1, "A>>B", "2"), (2, "A>>B", "1")], "ord int, reaction string, ec string")
    assert build.build_reactions(rows, ["ord"])[0].count() == 1
    out, _ = build.build_reactions(rows, ["ord"], extra_cols=["ec"], dedup_extra_cols=["ec"])
    assert [r["ec"] for r in out.orderBy("reaction_id").collect()] == ["1", "2"]


def test_argument_errors(spark):
    rows = records(spark, SIX)
    with pytest.raises(ValueError):
        build.build_reactions(rows, ["ord"], dedup_extra_cols=["ec"])
    with pytest.raises(ValueError):
        build.build_reactions(rows, ["ord"], extra_cols=["n_products"])


def test_rejected_records_never_shadow_good_ones(spark):
    _, rows = build.build_reactions(records(spark, ["A>>A", "A>>A", "A>>B"]), ["ord"])
    assert stats(rows)["n_identity"] == 2 and stats(rows)["n_out"] == 1


def test_missing_extra_columns_are_empty_and_empty_tables_work(spark):
    out, rows = build.build_reactions(records(spark, ["A>>B"]), ["ord"], extra_cols=["organism"])
    assert out.first()["organism"] == ""
    out, rows = build.build_reactions(records(spark, ["A>>B"]).limit(0), ["ord"])
    assert out.count() == 0 and stats(rows)["n_in"] == 0


RAW = "unmapped string, rxn_idx long, ec_num string, organism string, source string, quality double, natural boolean, steps string, protein_db string, protein_refs string, ord long"


def raw(spark):
    rows = [
        ("A>>B", 1, "1.1", "Org1", "direct", 0.9, True, "single", "uniprot", "['C1','C2']"),
        ("A>>C", 2, "1.1", "Org1", "direct", 0.9, True, "single", "genbank", "['G']"),
        ("A>>D", 3, "2.2", "Org2", "reversed", 0.9, True, "single", None, None),
        ("A>>E", 4, "3.3", "", "direct", 0.9, True, "single", None, None),
        ("A>>F", 5, "1.1", "Org1", "direct", 0.1, True, "single", None, None),
        ("A>>G", 6, None, None, "direct", 0.9, True, "single", "swissprot", "[]"),
    ]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], RAW)


def test_loaders(spark):
    every = build.load_records(raw(spark)).collect()
    assert len(every) == 5 and {r["ec_num"] for r in every} == {"1.1", "2.2", "3.3", "nan"}
    cur = build.load_with_accessions(raw(spark))
    assert sorted(r["uniprot_id"] for r in cur.collect()) == ["C1", "C2"]


def test_resolution(spark):
    found = spark.createDataFrame([("1.1", "Org1", "OLD", 0), ("1.1", "Org1", "P1;P2;P3", 1), ("2.2", "Org2", "R1", 2), ("3.3", "", "N", 3)], "ec_num string, organism string, accessions string, ord int")
    one = sorted(r["uniprot_id"] for r in build.load_resolved(raw(spark), found).collect())
    every = sorted(r["uniprot_id"] for r in build.load_resolved(raw(spark), found, True).collect())
    assert one == ["P1", "R1"] and every == ["P1", "P2", "P3", "R1"]
    pairs = [tuple(r) for r in build.accession_less_pairs(raw(spark)).collect()]
    assert pairs == [("1.1", "Org1"), ("2.2", "Org2")]


def test_cyp_loader_keeps_row_numbers(spark):
    schema = "sub_Smiles1 string, pro_Smiles1 string, blast string, Symbol string, Uniprot string, `EC number` string, Species1 string, Species string, Txid double, ord long"
    rows = [("A", "B", "MK", "S1", "/", "/", "Homo sapiens", "Animal", None, 0), ("/", "B", "MK", "S", "U", "1", "x", "Plant", 1.0, 1), ("A", "B", "MK", None, "U3", "1.1", "Zea", "Plant", 2.0, 2)]
    got = build.load_cyp(spark.createDataFrame(rows, schema)).orderBy("ord").collect()
    assert [(r["rxn_idx"] - build.CYP_OFFSET, r["uniprot_id"], r["ec_num"], r["organism_class"]) for r in got] == [(0, "S1", "", "human"), (2, "U3", "1.1", "plant")]


def test_earlier_sources_win(spark):
    a = records(spark, ["A>>B"], tag="first")
    b = records(spark, ["A>>B"], tag="second")
    both = build.in_order(a, b)
    out, rows = build.build_reactions(both, ["source_rank", "ord"], extra_cols=["tag"])
    assert out.first()["tag"] == "first" and stats(rows)["n_duplicate"] == 1


def test_drug_pairs(spark):
    rows = spark.createDataFrame([(1, "A", "B", "CYP3A4", None, 0), (2, "A", "B", "other", "x", 1)], "pair_id long, parent_smiles string, metabolite_smiles string, cyp string, origin string, ord int")
    got = build.load_drug_pairs(rows).collect()
    assert [(r["uniprot_id"], r["origin"], r["source_pair_id"]) for r in got] == [("P08684", "", 1)]


def test_attach_sequences_closes_ids(spark):
    rows = spark.createDataFrame([(0, "P1", ""), (1, "P2", ""), (2, "P3", "INLINE")], "reaction_id long, uniprot_id string, sequence string")
    seqs = spark.createDataFrame([("P2", "MKV"), ("P3", "OTHER")], "accession string, sequence string")
    got = build.attach_sequences(rows, seqs).orderBy("reaction_id").collect()
    assert [(r["reaction_id"], r["uniprot_id"], r["sequence"], r["seq_len"]) for r in got] == [(0, "P2", "MKV", 3), (1, "P3", "INLINE", 6)]


def test_duplicates_are_told_in_parts(spark):
    rows = spark.range(300).select(F.when(F.col("id") % 3 == 0, "bad").otherwise("out").alias("first_status"), F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("key"), F.col("id").alias("ord"))
    got = {r["ord"]: r["status"] for r in build._duplicates_told(rows, ["key"], ["ord"], salts=4).collect()}
    assert got == {i: "bad" if i % 3 == 0 else "out" if i in (1, 2) else "duplicate" for i in range(300)}


def test_rejects_share_no_window(spark):
    rows = records(spark, ["x"] * 50 + ["A>>B"] * 3)
    _, told = build.build_reactions(rows, ["ord"])
    text = told._jdf.queryExecution().executedPlan().toString()
    assert text.count("Window [row_number") == 2 and "_part" in text.split("Window [row_number")[1].split("\n")[0]
    assert stats(told)["n_invalid"] == 50 and stats(told)["n_duplicate"] == 2


def test_rows_of_one_resolved_list_follow_each_other(spark, sf):
    """So the repeats of a list take little space in a file, however long it is; also if the lists are broadcast."""
    from rxflow.plans import catalog

    nations = {str(r["s_suppkey"]): r["s_nationkey"] for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()}
    out = catalog.resolve_explode_all(spark, sf).select("uniprot_id", F.spark_partition_id().alias("part")).collect()
    at = [(r["part"], nations[r["uniprot_id"]]) for r in out]
    runs = 1 + sum(x != y for x, y in zip(at, at[1:]))
    assert len(out) > 100 and runs == len(set(at)), (len(out), runs)


@pytest.mark.parametrize("broadcast", [True, False])
def test_long_resolved_lists_are_told_in_tiles(spark, monkeypatch, broadcast):
    """Tasks are bounded, and near rows of the output repeat few accessions, however long the list is."""
    monkeypatch.setattr(build, "PART_PAIRS", 100_000, raising=False)
    if not broadcast:
        monkeypatch.setattr(build, "BROADCAST_ACCESSIONS", 0, raising=False)
    n, m = 500, 2000
    rows = spark.range(n).select(F.lit("A>>B").alias("unmapped"), F.col("id").alias("rxn_idx"), F.lit("1.1").alias("ec_num"), F.lit("Org1").alias("organism"), F.lit("direct").alias("source"))
    rows = rows.withColumns({"quality": F.lit(1.0), "natural": F.lit(True), "steps": F.lit("single"), "protein_db": F.lit("genbank"), "protein_refs": F.lit("[]"), "ord": F.col("rxn_idx")})
    found = spark.createDataFrame([("1.1", "Org1", ";".join(f"P{i}" for i in range(m)), 0)], "ec_num string, organism string, accessions string, ord int")
    monkeypatch.setattr(build, "PIECE_ROWS", 64, raising=False)
    got = build.load_resolved(rows, found, True).select("rxn_idx", "pos", "uniprot_id", F.spark_partition_id().alias("part")).collect()
    assert len(got) == n * m and {(r["rxn_idx"], r["pos"]) for r in got} == {(i, p) for i in range(n) for p in range(m)}
    assert all(r["uniprot_id"] == f"P{r['pos']}" for r in got)
    assert max(Counter(r["part"] for r in got).values()) <= (256_000 if broadcast else 750_000)
    assert max(len({r["pos"] for r in got[i : i + 10_000]}) for i in range(0, n * m, 10_000)) <= 512
