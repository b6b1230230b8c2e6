"""Operator 6: URL filters by given rules and mined association rules.

Given rules (host suffix, path prefix) come first; the longest that fits decides. Other
URLs are judged by token combinations mined from labels: FP-growth finds sets of tokens
that are frequent among labelled-bad URLs; each is matched against all labelled URLs, and
it becomes a rule if enough of these have it (support) and enough of those are bad
(confidence), unless a part of it is as sure. A rule is filed in an inverted index under its
rarest token; a URL only meets the rules of its own tokens.

Labels of the query: a page is bad if the document that it shows (the last number in its path) is labelled toxic or of low
quality; it is good if that document is labelled otherwise. A caller with labels of URLs gives those to ``judge`` instead.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no tokens,
and is allowed; repeated rows are judged each; a doc_id labelled twice is bad if one label says so; of given rules that fit, the longer
one wins, of equally long ones the last in the order of their texts; without bad labels, or on an empty table, there are no mined rules;
very long URLs are read whole; other columns of the tables are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from rxflow.llm.common import map_arrow, stored, table, tune

#: Rules of the query: host, path, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: Least share of the bad URLs, least number of labelled URLs and least confidence of a mined rule; its tokens at most.
SUPPORT, COUNT, CONFIDENCE, TOKENS = 0.01, 5, 0.8, 3
#: Least lower bound of that confidence (Wilson's, at 99 %), so that rules of few URLs are not chance.
SURE, Z = 0.55, 2.576
#: Mined rules that are sent to the executors at once.
BLOCK = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """From the first :// up to a slash, question mark, hash or the end; A to Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct host labels and their parts, path words and query keys, each marked by where it stands."""
    def marked(text: Column, by: str, mark: str) -> Column:
        return F.transform(F.filter(F.split(text, by), lambda t: F.length(t) > 1), lambda t: F.concat(F.lit(mark), t))

    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    keys = F.regexp_replace(query, "=[^&]*", "")
    words = F.filter(F.split(F.lower(path(url)), "[^a-z]+"), lambda t: F.length(t) > 1)
    return F.array_distinct(
        F.concat(marked(host(url), "[.-]", "h:"), F.transform(words, lambda t: F.concat(F.lit("p:"), t)), marked(keys, "&", "q:"))
    )


def fitting(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does. For lists of some hundred rules."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest is asked first
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _has_any(rows: DataFrame, found: list[list[str]], out: str, each: bool) -> DataFrame:
    """Match token sets by an inverted index: whether a row has one (``out`` boolean), or, if ``each``, ``bad, out`` rows of the
    numbers of all that it has."""
    rarest: dict[str, int] = {}
    for items in found:
        for t in items:
            rarest[t] = rarest.get(t, 0) + 1
    index: dict[str, list[tuple[int, frozenset[str]]]] = {}
    for k, items in enumerate(found):
        index.setdefault(min(items, key=lambda t: (rarest[t], t)), []).append((k, frozenset(items)))
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def hits(items: list[str] | None) -> list[int]:
        have, index = set(items or ()), sent.value
        return [k for t in have for k, want in index.get(t, ()) if want <= have]

    if each:
        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            seen: dict[tuple[int, int], int] = {}
            for items, bad in zip(batch["items"].to_pylist(), batch["bad"].to_pylist()):
                for k in hits(items):
                    seen[k, bad] = seen.get((k, bad), 0) + 1
            cols = [[k for k, _ in seen], [b for _, b in seen], list(seen.values())]
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], [out, "bad", "n"])

        return map_arrow(rows.select("items", "bad"), count, f"{out} long, bad long, n long")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index(out)
        new = [old or bool(hits(x)) for old, x in zip(batch.column(at).to_pylist(), batch["items"].to_pylist())]
        return batch.set_column(at, out, pa.array(new, pa.bool_()))

    return map_arrow(rows, run, StructType([StructField(out, BooleanType()) if f.name == out else f for f in rows.schema.fields]))


def mine(rows: DataFrame, support: float = SUPPORT, count: int = COUNT, confidence: float = CONFIDENCE, most: int = TOKENS) -> list[list[str]]:
    """Token sets of bad URLs, from ``items, bad`` (1 or 0)."""
    rows = stored(rows.select("items", F.col("bad").cast("long").alias("bad")))
    bad = rows.where((F.col("bad") == 1) & (F.size("items") > 0))
    if bad.isEmpty():
        return []
    common = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(bad.select("items")).freqItemsets
    sets = sorted(sorted(r.items) for r in common.where(F.size("items") <= most).select("items").toLocalIterator())
    scored: list[tuple[float, list[str]]] = []
    for at in range(0, len(sets), BLOCK):
        part = sets[at : at + BLOCK]
        seen = _has_any(rows, part, "k", True).groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bad")).alias("b"))
        scored += [(r.b / r.n, part[r.k]) for r in seen.where(f"n >= {count} and b >= {confidence} * n").toLocalIterator() if lower_bound(r.b, r.n) >= SURE]
    kept: dict[frozenset[str], float] = {}
    for sure, items in sorted(scored, key=lambda x: (len(x[1]), x[1])):  # parts come before wholes
        own = frozenset(items)
        if not any(own - {t} and _within(kept, own - {t}, sure) for t in own):
            kept[own] = sure
    return [sorted(k) for k in kept]


def lower_bound(bad: int, n: int, z: float = Z) -> float:
    """Of the share of bad URLs."""
    p = bad / n
    return (p + z * z / (2 * n) - z * ((p * (1 - p) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)


def _within(kept: dict[frozenset[str], float], items: frozenset[str], sure: float) -> bool:
    """Whether these tokens or some of them are a rule that is as sure."""
    return kept.get(items, -1.0) >= sure or any(_within(kept, items - {t}, sure) for t in items if len(items) > 1)


def judge(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined`` of every page; labelled: see ``mine``."""
    tune(pages.sparkSession)
    found = mine(labelled)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), tokens(F.col("url")).alias("items"), F.lit(False).alias("mined"))
    for at in range(0, len(found), BLOCK):
        rows = _has_any(rows, found[at : at + BLOCK], "mined", False)
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")


def labels_of(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``items, bad`` of the pages whose document is labelled. Pages without a number take no part in the join."""
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    known = labels.where(F.col("doc_id").isNotNull() & bad.isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(bad.cast("int")).alias("bad"))
    doc = F.regexp_extract(path(F.col("url")), "([0-9]{1,18})[^0-9]*$", 1)
    rows = pages.select(tokens(F.col("url")).alias("items"), F.when(doc != "", doc).cast("long").alias("doc")).where("doc IS NOT NULL")
    return rows.join(known, "doc").select("items", "bad")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    return judge(pages, labels_of(pages, table(spark, sf_dir, "labels")))
