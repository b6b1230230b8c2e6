"""Retrieval metrics of ranked predictions, all from one aggregation.

Input: ``row_id, references, predictions`` and perhaps ``raw_predictions`` (arrays of sides). A side is a dot-joined
set of molecules. What canonical means is a backend's matter; with one that needs Python,
each distinct molecule is evaluated once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxflow.functions import exprs as E
from rxflow.functions.backends import Backend, Identity, dimension
from rxflow.sources.tables import durable

KS = (1, 5, 10)


@dataclass
class Metric:
    name: str
    value: float | None
    higher_is_better: bool = True
    detail: dict[str, str] = field(default_factory=dict)


def aligned(references: DataFrame, predictions: DataFrame) -> DataFrame:
    """Joins both by row_id; raises unless they have the same rows."""
    both = references.join(predictions, "row_id", "full_outer")
    if not both.where("references IS NULL OR predictions IS NULL").isEmpty():
        raise ValueError("references and predictions have different rows")
    return both


def _side_sets(sides: Column, canonical) -> Column:
    return F.transform(sides, lambda s: E.molecule_set(s, canonical))


def prepared(frame: DataFrame, of: Backend | None = None) -> DataFrame:
    """Adds what the metrics read: ``ref_set``, ``pred_sets``, ``whole`` (canonical sides of predictions) and ``raw``."""
    of = of or Identity()
    raw = F.col("predictions")
    if "raw_predictions" in frame.columns:
        raw = F.when(F.size(F.coalesce("raw_predictions", F.array())) > 0, F.col("raw_predictions")).otherwise(raw)
    rows = frame.withColumn("raw", raw)
    if of.native:
        canonical = of.canonical
    else:
        sides = rows.select("row_id", F.explode(F.concat("references", "predictions", "raw")).alias("side"))
        parts = sides.select("row_id", F.explode(F.array_union(E.molecules(F.col("side")), F.array("side"))).alias("molecule"))
        named = parts.distinct().join(dimension(parts, "molecule", of), "molecule")
        lookup = named.where("canonical IS NOT NULL").groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("molecule", "canonical"))).alias("names"))
        rows = rows.join(lookup, "row_id", "left").withColumn("names", F.coalesce("names", F.create_map().cast("map<string,string>")))
        canonical = lambda m: F.try_element_at("names", m)
    mols = lambda sides: F.flatten(F.transform(sides, lambda s: E.molecules(s)))
    rows = rows.withColumns(
        {
            "ref_set": E.molecule_set(F.array_join("references", "."), canonical),
            "pred_sets": _side_sets(F.col("predictions"), canonical),
            "whole": F.transform("predictions", canonical),
            "ref_mols": F.filter(F.transform("references", canonical), lambda m: m.isNotNull()),
            "n_raw": F.size("raw"),
            "n_raw_valid": F.size(F.filter(F.transform("raw", canonical), lambda m: m.isNotNull())),
            "n_mols": F.size(mols(F.col("raw"))),
            "n_mols_valid": F.size(F.filter(F.transform(mols(F.col("raw")), canonical), lambda m: m.isNotNull())),
            "raw_valid": F.filter(F.transform("raw", canonical), lambda m: m.isNotNull()),
        }
    )
    return rows.drop("names")


def top_set(k: int, sets: str = "pred_sets") -> Column:
    """Distinct molecules of the first k predictions; ranks count invalid ones, too."""
    return F.array_distinct(F.flatten(F.slice(sets, 1, k)))


def hits(k: int) -> Column:
    return F.size(F.array_intersect("ref_set", top_set(k)))


def _mean(value: Column, where: Column | None = None) -> Column:
    """Mean over all rows, or over those of a condition; 0 without any."""
    return F.coalesce(F.avg(value if where is None else F.when(where, value)), F.lit(0.0))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / F.when(whole > 0, whole)).otherwise(0.0)


def accuracy(k: int) -> Column:
    return _mean((hits(k) > 0).cast("double"))


def recall(k: int) -> Column:
    n = F.size("ref_set")
    return _mean(_share(hits(k), n), n > 0)


def precision(k: int) -> Column:
    n = F.size(top_set(k))
    return _mean(_share(hits(k), n), n > 0)


def f1(k: int) -> Column:
    n, m = F.size("ref_set"), F.size(top_set(k))
    return _mean(_share(2.0 * hits(k), n + m), (n > 0) & (m > 0))


def exact_match(k: int) -> Column:
    found = F.exists(F.slice("pred_sets", 1, k), lambda s: (F.size(s) > 0) & E.same_set(s, F.col("ref_set")))
    return _mean(found.cast("double"))


def validity() -> Column:
    return _micro("n_raw_valid", "n_raw")


def molecule_validity() -> Column:
    return _micro("n_mols_valid", "n_mols")


def uniqueness() -> Column:
    valid = F.size("raw_valid")
    return _mean(_share(F.size(F.array_distinct("raw_valid")), valid), valid > 0)


def _micro(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.sum(part).cast("double"), F.sum(whole).cast("double")), F.lit(0.0))


PER_K = {"accuracy": accuracy, "exact_match": exact_match, "precision": precision, "recall": recall, "f1": f1}
SCALARS = {"validity": validity, "per_molecule_validity": molecule_validity, "uniqueness": uniqueness}


def evaluate(frame: DataFrame, ks: Sequence[int] = KS, of: Backend | None = None) -> DataFrame:
    """One row with every metric of ``PER_K`` (``name_at_k``) and of ``SCALARS``."""
    rows = prepared(frame, of)
    return rows.agg(*(make(k).alias(f"{name}_at_{k}") for name, make in PER_K.items() for k in ks), *(make().alias(name) for name, make in SCALARS.items()))


def matrix(frame: DataFrame, ks: Sequence[int] = KS, of: Backend | None = None) -> DataFrame:
    """``metric`` and a column ``top_k`` for each k."""
    one = evaluate(frame, ks, of)
    row = lambda name: F.struct(F.lit(name).alias("metric"), *(F.col(f"{name}_at_{k}").alias(f"top_{k}") for k in ks))
    return one.select(F.inline(F.array(*map(row, PER_K))))


def novelty(frame: DataFrame, train: DataFrame, of: Backend | None = None, level: str = "side") -> DataFrame:
    """One row, ``novelty``: valid predictions that aren't among the training molecules (column ``smiles``).

    Level ``side`` compares whole sides, ``molecule`` each of their molecules.
    """
    of = of or Identity()
    rows = prepared(frame, of)
    items = F.filter("whole", lambda m: m.isNotNull()) if level == "side" else F.flatten("pred_sets")
    each = rows.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    known = dimension(train, "smiles", of).where("canonical IS NOT NULL").select(F.col("canonical").alias("item")).distinct().withColumn("old", F.lit(True))
    joined = each.join(known, "item", "left")
    return joined.agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("old").isNull(), F.col("n")).otherwise(0)).cast("double"), F.sum("n").cast("double")), F.lit(0.0)).alias("novelty"))


def _bits(sides: DataFrame, of: Backend) -> DataFrame:
    """``molecule, bits`` of the distinct valid sides (column ``molecule``), stored: every join with them reads these few rows."""
    return durable(dimension(sides, "molecule", of, fingerprints=True).where("bits IS NOT NULL").select("molecule", "bits"))


def nearest_reference(frame: DataFrame, of: Backend | None = None) -> DataFrame:
    """``row_id, similarity``: the largest Tanimoto similarity of the first valid prediction to a reference.

    Rows without a valid prediction or without references are left out; invalid and null references count as 0.
    """
    of = of or Identity()
    rows = prepared(frame, of).select("row_id", F.get(F.filter("whole", lambda m: m.isNotNull()), F.lit(0)).alias("first"), F.array_distinct("references").alias("references"))
    rows = durable(rows.where(F.col("first").isNotNull() & (F.size("references") > 0)))
    bits = _bits(rows.select(F.explode(F.concat("references", F.array("first"))).alias("molecule")), of)
    pairs = rows.select(F.explode("references").alias("reference"), "first").distinct()
    pairs = pairs.join(bits.select(F.col("molecule").alias("first"), F.col("bits").alias("x")), "first").join(bits.select(F.col("molecule").alias("reference"), F.col("bits").alias("y")), "reference")
    scored = pairs.select("first", "reference", E.tanimoto(F.col("x"), F.col("y")).alias("score"))
    each = rows.select("row_id", "first", F.explode("references").alias("reference")).join(scored, ["first", "reference"], "left")
    return each.groupBy("row_id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("similarity"))


def matches(frame: DataFrame, of: Backend | None = None) -> DataFrame:
    """``row_id, rank, prediction, exact, best_tanimoto`` of each prediction: whether it is the whole reference set, and its
    largest Tanimoto similarity to a reference.

    That is null without references, or if the prediction or all references are invalid. Fingerprints are made once for each distinct side, and
    similarities once for each prediction with the same references; the frame is planned once and stored.
    """
    of = of or Identity()
    columns = ("row_id", "ref_set", "pred_sets", "predictions", F.array_sort(F.array_distinct(F.array_compact("references"))).alias("references"))
    rows = durable(prepared(frame, of).select(*columns))
    bits = _bits(rows.select(F.explode(F.concat("references", "predictions")).alias("molecule")), of)
    asked = rows.select("references", F.explode("predictions").alias("prediction")).distinct()
    refs = asked.select("references").distinct().select("references", F.explode("references").alias("molecule")).join(bits, "molecule").groupBy("references").agg(F.collect_list("bits").alias("ref_bits"))
    best = F.array_max(F.transform("ref_bits", lambda r: E.tanimoto(F.col("bits"), r)))
    best = asked.join(bits, asked.prediction == bits.molecule).join(refs, "references").select("references", "prediction", best.alias("best_tanimoto"))
    each = rows.select("row_id", "ref_set", "references", F.posexplode(F.arrays_zip(F.col("predictions").alias("prediction"), "pred_sets")).alias("at", "p"))
    each = each.select("row_id", "at", "ref_set", "references", "p.*").join(best, ["references", "prediction"], "left")
    exact = (F.size("pred_sets") > 0) & E.same_set(F.col("pred_sets"), F.col("ref_set"))
    return each.select("row_id", (F.col("at") + 1).alias("rank"), "prediction", exact.alias("exact"), "best_tanimoto")


def recovered(frame: DataFrame, of: Backend | None = None) -> DataFrame:
    """``row_id, found, expected``: reference molecules that any prediction has, and all of them; sorted."""
    rows = prepared(frame, of)
    every = F.array_distinct(F.flatten("pred_sets"))
    return rows.select("row_id", F.array_sort(F.array_intersect("ref_set", every)).alias("found"), F.array_sort("ref_set").alias("expected"))


def report(frame: DataFrame, train: DataFrame | None = None, of: Backend | None = None) -> tuple[list[Metric], DataFrame]:
    """Scalar metrics as records, and the matrix."""
    one = evaluate(frame, KS, of).first().asDict()
    out = [Metric(name, one[name]) for name in SCALARS]
    if train is not None:
        out.append(Metric("novelty", novelty(frame, train, of).first()["novelty"]))
    if (mean := nearest_reference(frame, of).agg(F.avg("similarity").alias("m")).first()["m"]) is not None:
        out.append(Metric("mean_tanimoto_top1", mean))
    return out, matrix(frame, KS, of)
