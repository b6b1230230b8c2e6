"""A corpus pipeline over ``documents``: toxicity, quality, near duplicates, personal data, packing.

Every stage works on all that the one before it kept. A stage may read its input more than once, so
each result is written to the shared folder and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxflow.llm import ngram_join, packing, personal, quality, toxicity, vocab
from rxflow.llm.common import stored, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score reaches the threshold.

    A null or empty text has the score of no evidence; without labels of both classes, or of an empty table, nothing is dropped;
    repeated rows are judged each; all columns stay as they are, also such as ``score`` or ``predicted``.
    """
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, scorer, names=("__toxic_score", "__toxic"))
    return scored.where("__toxic = 0").select(*(f"`{c}`" for c in docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject, null and empty texts among them; repeated rows are judged each."""
    return quality.passed(docs)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the smallest doc_id.

    Texts without words are near none; of rows that share a doc_id and a group the smallest stays; rows without doc_id stay.
    """
    return ngram_join.one_of_each(docs)


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; no row goes, a null text stays null, and ``n_chars``, if there is one, counts the masked text."""
    out = personal.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences; a null or empty text is its end id alone."""
    return packing.pack(docs, vocab.vocab_file("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", not_toxic),
    ("quality_rules", good_quality),
    ("ngram_join", no_near_duplicates),
    ("personal_data", no_personal_data),
    ("packing", packed),
]

#: Models, suffix arrays and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
