import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rxflow.functions import exprs as E
from rxflow.functions.literals import literal_items
from rxflow.sources.tables import list_literal


def value(spark, column, **given):
    rows = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items())) if given else spark.range(1)
    return rows.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["A.B", "A>B", "A>>", ">>B", "A>>B>>C", "", ".>>B"])
def test_malformed_reactions_are_null(spark, text):
    assert value(spark, E.split_reaction(F.lit(text))) is None


def test_split_drops_empty_molecules(spark):
    got = value(spark, E.split_reaction(F.lit("A..B>>C.")))
    assert (got["reactants"], got["products"]) == (["A", "B"], ["C"])


def test_keys(spark):
    assert value(spark, E.join_molecules(F.array(*map(F.lit, "BAA")))) == "A.A.B"
    assert value(spark, E.reaction_key(F.lit("a"), F.lit("b"))) == "a>>b"
    assert value(spark, E.undirected_key(F.lit("b"), F.lit("a"))) == value(spark, E.undirected_key(F.lit("a"), F.lit("b"))) == "a|b"


def test_all_or_null(spark):
    assert value(spark, E.all_or_null(F.array(F.lit("a"), F.lit(None)))) is None


@pytest.mark.parametrize(("seq", "k", "want"), [("ABCDE", 3, {"ABC", "BCD", "CDE"}), ("AB", 3, {"AB"}), ("", 3, set()), ("AAAA", 2, {"AA"})])
def test_kmers(spark, seq, k, want):
    assert set(value(spark, E.kmers(F.lit(seq), k))) == want


def test_kmers_need_a_positive_k():
    with pytest.raises(ValueError):
        E.kmers(F.lit("A"), 0)


def test_overlap_ratio(spark):
    arr = lambda s: F.array(*map(F.lit, s)) if s else F.array().cast("array<string>")
    got = [value(spark, E.overlap_ratio(arr(a), arr(b))) for a, b in (("", ""), ("ab", "cd"), ("ab", "ba"), ("abc", "abd"))]
    assert got == [1.0, 0.0, 1.0, 0.5]


def test_tanimoto_of_null_is_null(spark):
    assert value(spark, E.tanimoto(F.array(F.lit(1)), F.lit(None).cast("array<int>"))) is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="CNOBrcl[]+-()=#%12345@/\\.>x ", max_size=20), min_size=1, max_size=20))
def test_tokens_match_python(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", E.atom_tokens(F.col("s")).alias("t"), E.reconstructs(F.col("s")).alias("r")).collect()
    for r in rows:
        want = re.findall(E.TOKEN_PATTERN, r["s"])
        assert r["t"] == want and r["r"] == ("".join(want) == r["s"])


def test_tokens_keep_atoms_whole(spark):
    assert value(spark, E.atom_tokens(F.lit("BrCCl[nH]"))) == ["Br", "C", "Cl", "[nH]"]
    assert value(spark, E.text_to_smiles(E.tokens_to_text(F.lit("CC(=O)O")))) == "CC(=O)O"


def test_direction_and_quality(spark):
    rows = spark.createDataFrame([(None, 0.3, "single"), ("x reversed", float("nan"), "single"), ("d", 0.2, "single"), ("d", 0.9, "multi"), ("d", None, "single")], "s string, q double, n string")
    got = rows.select(E.direction(F.col("s")).alias("d"), E.good_quality(F.col("q"), F.col("n")).alias("g")).collect()
    assert [tuple(r) for r in got] == [("forward", True), ("reversed", False), ("forward", False), ("forward", False), ("forward", False)]


def test_organism_class(spark):
    rows = spark.createDataFrame([(9606.0, None, "Plant"), (None, "Homo sapiens (man)", "/"), (1.0, "x", " Animal "), (None, None, "fungus"), (9606.7, "", None)], "t double, s string, c string")
    assert [r[0] for r in rows.select(E.organism_class(F.col("t"), F.col("s"), F.col("c"))).collect()] == ["human", "human", "animal", "", "human"]


def test_ec_class(spark):
    rows = spark.createDataFrame([("1.2.3",), (" 7 .1",), ("8.1",), ("",), (None,), ("nan",)], "e string")
    assert [r[0] for r in rows.select(E.ec_class(F.col("e"))).collect()] == ["1", "7", "other", "other", "other", "other"]


def test_list_literals(spark):
    cells = ["['A','B']", "('A','B')", "'A'", "None", "['A',]", "[1, 2]", "nope(", "[]", None, "['a\\'b']"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", list_literal(F.col("c")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in rows] == [literal_items(c) if c is not None else [] for c in cells]


def test_text_functions(spark):
    assert value(spark, E.escape_xml(F.lit("a<b>&c"))) == "a&lt;b&gt;&amp;c"
    assert value(spark, E.slug(F.lit("a b/c"))) == "a-b-c" and value(spark, E.slug(F.lit("//"))) == "run"
    assert value(spark, E.shortened(F.lit("x" * 43))) == "x" * 39 + "…" and value(spark, E.shortened(F.lit("x" * 42))) == "x" * 42


def test_mean_pool_leaves_masked_positions_out(spark):
    rows = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0])], "s array<array<double>>, m array<int>")
    assert [r[0] for r in rows.select(E.mean_pool(F.col("s"), F.col("m"))).collect()] == [[2.0, 3.0], [0.0, 0.0]]


def test_padding(spark):
    assert value(spark, E.padded(F.array(F.lit(1)), 3, -100)) == [1, -100, -100]


def test_shingles(spark):
    texts = [None, "", " \t", "a b", "a b c d e", "a  b\tc\nd e f", "x " * 40]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(E.shingles(F.col("x"))).collect()]
    assert list(map(len, got)) == [0, 0, 0, 1, 1, 2, 1]
    assert got[4][0] == got[5][0]
