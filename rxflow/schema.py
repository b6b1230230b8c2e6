"""Schemas and the errors that checks raise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The columns of a processed reaction table, in order, and the names of its splits.
REACTION_COLUMNS = ("reaction_id", "reactant_smiles", "product_smiles", "source", "n_reactants", "n_products", "src_n_tokens", "tgt_n_tokens")
SPLITS = ("train", "valid", "test")


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
RAW_REACTIONS = struct(
    unmapped=_S, rxn_idx=_L, ec_num=_S, organism=_S, source=_S, quality=_D, natural=_B, steps=_S, protein_db=_S, protein_refs=_S, mapped=_S, orig_rxn_text=_S, rule=_S, rule_id=_S
)
RESOLVED = struct(ec_num=_S, organism=_S, n_accessions=T.IntegerType(), accessions=_S)
CYP_REACTIONS = struct(**{"sub_Smiles1": _S, "pro_Smiles1": _S, "blast": _S, "Symbol": _S, "Uniprot": _S, "EC number": _S, "Species1": _S, "Species": _S, "Txid": _D})
DRUG_PAIRS = struct(pair_id=_L, parent_smiles=_S, metabolite_smiles=_S, cyp=_S, origin=_S)


class CheckFailed(RuntimeError):
    """A table breaks a rule that later steps rely on."""


def require(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
