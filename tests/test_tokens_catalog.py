import pytest
from pyspark.sql import functions as F

from rxflow.operators import tokens
from rxflow.plans.datasets import Catalog, Dataset, Model


def test_additions(spark):
    rows = spark.createDataFrame([("CCBr[nH]",), ("Cl[O-]C%12",)], "s string")
    found = tokens.atom_vocabulary(rows, "s")
    assert [r["token"] for r in found.collect()] == ["%12", "Br", "Cl", "[O-]", "[nH]"]
    known = spark.createDataFrame([("Br",), ("C",)], "token string")
    assert [r["token"] for r in tokens.additions(found, known).collect()] == ["%12", "Cl", "[O-]", "[nH]"]
    assert [r["token"] for r in tokens.additions(found, known, lambda t: t.isalpha()).collect()] == ["%12", "[O-]", "[nH]"]


def test_catalog(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(0, "A.B", "C", "U1", "train"), (1, "A", "D", "U1", "test")], "reaction_id long, reactant_smiles string, product_smiles string, uniprot_id string, split string").write.parquet(path)
    catalog = Catalog()
    catalog.add(Dataset("d", path))
    catalog.add(Model("m", lambda: lambda texts, e: [[t] for t in texts]))
    assert catalog.dataset("d").entries(spark, "test").select(F.size("reactants")).first()[0] == 1
    assert catalog.dataset("d").entities(spark).count() == 1 and catalog.names(Model) == ["m"]
    with pytest.raises(KeyError):
        catalog.model("d")
    with pytest.raises(ValueError):
        catalog.add(Dataset("d", path))
