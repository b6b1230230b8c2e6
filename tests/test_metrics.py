import pytest

from rxflow.functions.backends import Pure
from rxflow.operators import metrics as M


def frame(spark, refs, preds, raw=None):
    rows = [(i, r, p, *([raw[i]] if raw else [])) for i, (r, p) in enumerate(zip(refs, preds))]
    schema = "row_id long, references array<string>, predictions array<string>" + (", raw_predictions array<string>" if raw else "")
    return spark.createDataFrame(rows, schema)


def at(spark, refs, preds, ks=(1, 2)):
    return M.evaluate(frame(spark, refs, preds), ks, Pure()).first().asDict()


def test_single_molecules(spark):
    got = at(spark, [["CCO"], ["c1ccccc1"]], [["CCO", "CCC"], ["CCC", "c1ccccc1"]])
    assert (got["accuracy_at_1"], got["accuracy_at_2"]) == (0.5, 1.0)
    assert (got["recall_at_1"], got["recall_at_2"]) == (0.5, 1.0)
    assert (got["precision_at_1"], got["precision_at_2"]) == (0.5, 0.5)
    assert got["f1_at_1"] == 0.5 and got["f1_at_2"] == pytest.approx(2 / 3)


def test_multi_molecule_sides(spark):
    got = at(spark, [["CCO", "CC=O"]], [["CCO.CC=O", "CCO.CCC"]])
    assert all(got[f"{m}_at_1"] == 1 for m in ("accuracy", "recall", "precision", "f1", "exact_match"))
    assert got["precision_at_2"] == pytest.approx(2 / 3) and got["recall_at_2"] == 1


def test_exact_sets(spark):
    got = at(spark, [["CCO"], ["CCO", "CC=O"]], [["CCO"], ["CCO", "CCO.CC=O"]])
    assert (got["exact_match_at_1"], got["exact_match_at_2"]) == (0.5, 1.0)


def test_invalid_fragments_are_dropped_from_sets(spark):
    assert at(spark, [["CCO"]], [["CCO.((("]])["exact_match_at_1"] == 1


def test_validity_and_uniqueness(spark):
    got = at(spark, [["CCO"], ["CCO"]], [["CCO", "OCC", "((("], []])
    assert got["validity"] == pytest.approx(2 / 3) and got["uniqueness"] == 0.5
    got = at(spark, [["CCO"]], [["CCO.((("]])
    assert got["per_molecule_validity"] == 0.5 and got["validity"] == 0


def test_raw_predictions_fall_back_when_empty(spark):
    rows = frame(spark, [["CCO"], ["CCO"]], [["CCO"], ["((("]], raw=[[], ["CCO", "((("]])
    assert M.evaluate(rows, (1,), Pure()).first()["validity"] == pytest.approx(2 / 3)


def test_no_rows(spark):
    got = M.evaluate(frame(spark, [["C"]], [["C"]]).limit(0)).first().asDict()
    assert set(got.values()) == {0.0}


def test_populations_differ(spark):
    got = at(spark, [["CCO"], [], ["((("]], [[], ["CCO"], ["CCO"]])
    assert got["accuracy_at_1"] == 0 and got["precision_at_1"] == 0 and got["recall_at_1"] == 0 and got["f1_at_1"] == 0


def test_novelty_by_side_and_by_molecule(spark):
    train = spark.createDataFrame([("OCC",), ("((((",)], "smiles string")
    rows = frame(spark, [["C"]], [["CCO", "CCO.CCO", "CCC", "((("]])
    assert M.novelty(rows, train, Pure()).first()["novelty"] == pytest.approx(2 / 3)
    assert M.novelty(rows, train, Pure(), "molecule").first()["novelty"] == pytest.approx(1 / 3)


def test_nearest_reference(spark):
    rows = frame(spark, [["CCO", "((("], [], ["CCO"]], [["(((", "OCC"], ["CCO"], ["((("]])
    assert [tuple(r) for r in M.nearest_reference(rows, Pure()).collect()] == [(0, 1.0)]


def test_matches_and_recovered(spark):
    rows = frame(spark, [["CCO", "C"]], [["C.OCC", "C"]])
    assert [r["exact"] for r in M.matches(rows, Pure()).orderBy("rank").collect()] == [True, False]
    best = {r["rank"]: r["best_tanimoto"] for r in M.matches(rows, Pure()).collect()}
    assert best[2] == 1.0 and 0 < best[1] < 1  # the whole side against its nearest reference
    none = M.matches(frame(spark, [[], ["CCO"]], [["C"], ["((("]]), Pure()).collect()
    assert [r["best_tanimoto"] for r in none] == [None, None]
    got = M.recovered(rows, Pure()).first()
    assert got["found"] == got["expected"] and len(got["expected"]) == 2


def test_alignment_is_checked(spark):
    refs = spark.createDataFrame([(0, ["C"]), (1, ["C"])], "row_id long, references array<string>")
    preds = spark.createDataFrame([(0, ["C"])], "row_id long, predictions array<string>")
    with pytest.raises(ValueError):
        M.aligned(refs, preds)


def test_matrix_has_a_row_for_each_metric(spark):
    rows = M.matrix(frame(spark, [["C"]], [["C"]])).collect()
    assert [r["metric"] for r in rows] == list(M.PER_K) and all(r["top_1"] == 1 for r in rows)


def test_null_references_count_as_nothing(spark):
    rows = spark.createDataFrame([(0, [None], ["C"]), (1, ["C", None], ["C", None])], "row_id long, references array<string>, predictions array<string>")
    assert sorted(tuple(r) for r in M.nearest_reference(rows).collect()) == [(0, 0.0), (1, 1.0)]
    assert {(r["row_id"], r["rank"]): r["best_tanimoto"] for r in M.matches(rows).collect()} == {(0, 1): None, (1, 1): 1.0, (1, 2): None}


def test_frames_are_planned_once(spark, tmp_path):
    """However many branches need the frame, its sources are read once."""
    rows = frame(spark, [["C.CO"], ["C"]] * 5, [["C", "CO"], ["CC"]] * 5)
    for of in (M.matches, M.nearest_reference):
        plan = of(rows)._jdf.queryExecution().optimizedPlan().toString()
        assert "references" in plan and "LocalRelation" not in plan and plan.count("LogicalRDD") <= 6
