"""Molecule backends: what is canonical, how many atoms, which fingerprint.

A backend turns a column of molecules into another; those that need Python are evaluated
once for each distinct molecule (see ``dimension``), since the same few molecules
make up most sides.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxflow.functions import smiles


class Backend(Protocol):
    name: str
    native: bool  # whether canonical() is a plain expression

    def canonical(self, molecule: Column) -> Column: ...

    def atoms(self, molecule: Column) -> Column: ...

    def fingerprint(self, molecule: Column) -> Column: ...


class Identity:
    """Every non-blank string is a molecule; its canonical form is itself, trimmed. Its fingerprint are its 2-mers."""

    name, native = "identity", True

    def canonical(self, molecule: Column) -> Column:
        return F.when(F.trim(molecule) != "", F.trim(molecule))

    def atoms(self, molecule: Column) -> Column:
        from rxflow.functions.exprs import atom_tokens

        return F.size(F.filter(atom_tokens(molecule), lambda t: F.regexp_like(t, F.lit("^[A-Za-z\\[]"))))

    def fingerprint(self, molecule: Column) -> Column:
        from rxflow.functions.exprs import kmers

        return F.array_sort(F.transform(kmers(molecule, 2), lambda k: F.ascii(k) * 0x110000 + F.ascii(F.substring(k, 2, 1))))


class Pure:
    """Our own SMILES reader, through Arrow."""

    name, native = "pure", False

    def __init__(self, isomeric: bool = True):
        self.isomeric = isomeric

    def canonical(self, molecule: Column) -> Column:
        isomeric = self.isomeric

        @F.pandas_udf("string")
        def run(m: pd.Series) -> pd.Series:
            return m.map(lambda s: smiles.canonical(s, isomeric))

        return run(molecule)

    def atoms(self, molecule: Column) -> Column:
        @F.pandas_udf("int")
        def run(m: pd.Series) -> pd.Series:
            return m.map(smiles.heavy_atoms).astype("Int32")

        return run(molecule)

    def fingerprint(self, molecule: Column) -> Column:
        @F.pandas_udf("array<int>")
        def run(m: pd.Series) -> pd.Series:
            return m.map(smiles.fingerprint)

        return run(molecule)


def backend(name: str) -> Backend:
    known = {"identity": Identity, "pure": Pure}
    if name not in known:
        raise KeyError(f"no backend {name}; there are {', '.join(sorted(known))}")
    return known[name]()


def dimension(molecules: DataFrame, column: str, of: Backend, fingerprints: bool = False) -> DataFrame:
    """``molecule, canonical`` (and ``atoms, bits``) of each distinct molecule."""
    one = molecules.select(F.col(column).alias("molecule")).where("molecule IS NOT NULL").distinct()
    out = one.withColumn("canonical", of.canonical(F.col("molecule")))
    if fingerprints:
        valid = F.col("canonical").isNotNull()
        out = out.withColumn("atoms", F.when(valid, of.atoms(F.col("molecule")))).withColumn("bits", F.when(valid, of.fingerprint(F.col("molecule"))))
    return out
