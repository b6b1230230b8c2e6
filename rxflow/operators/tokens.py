"""Vocabulary work: the atom tokens of a corpus, and which of them a tokenizer lacks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxflow.functions import exprs as E


def atom_vocabulary(df: DataFrame, column: str) -> DataFrame:
    """``token`` of more than one character that occur, in order."""
    each = df.select(F.explode(E.atom_tokens(F.col(column))).alias("token"))
    return each.where(F.length("token") > 1).distinct().orderBy("token")


def additions(tokens: DataFrame, vocabulary: DataFrame, round_trips: Callable[[str], bool] | None = None) -> DataFrame:
    """Tokens that are neither in the vocabulary (``token``) nor reproduced by the tokenizer from its own pieces."""
    rest = tokens.join(vocabulary.select("token").distinct(), "token", "left_anti")
    if round_trips is None:
        return rest.orderBy("token")

    @F.pandas_udf("boolean")
    def holds(items: pd.Series) -> pd.Series:
        return items.map(round_trips)

    return rest.where(~holds("token")).orderBy("token")
