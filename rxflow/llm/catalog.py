"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rxflow.llm import bpe, html, merkle, neighbours, ngram_join, packing, personal, phrases, quality, records, rotations, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_byte_bpe": bpe.query,
        "op2_neighbours": neighbours.query,
        "op3_toxicity": toxicity.query,
        "op4_html_main_text": html.query,
        "op5_binary_records": records.query,
        "op6_url_filter": urls.query,
        "op7_ngram_join": ngram_join.query,
        "op8_packing": packing.query,
        "op9_quality_rules": quality.query,
        "op10_personal_data": personal.query,
        "op11_phrases": phrases.query,
        "op12_merkle_manifest": merkle.query,
        "op13_embedding_duplicates": rotations.query,
    }


def oracle_sql() -> dict[str, str]:
    """For those that SQL can express; tokenizers, models, trees and transducers are held against libraries and brute force in tests."""
    return {
        "op2_neighbours": neighbours.SQL,
        "op7_ngram_join": ngram_join.SQL,
        "op9_quality_rules": quality.SQL,
        "op11_phrases": phrases.SQL,
        "op12_merkle_manifest": merkle.SQL,
        "op13_embedding_duplicates": rotations.SQL,
    }
