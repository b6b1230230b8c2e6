"""Operator 9: quality rules, with repetition by suffix arrays.

The words of a text are numbered and their suffixes sorted by prefix doubling. Where
neighbours in that order share a prefix of at least ``min_words`` words, an interval of
longest common prefixes holds a maximal repeated substring; the spans of all occurrences
are united. A text is rejected if they cover too large a part of it or the longest repeat is
too long. The work is O(n log^2 n) for n words, whatever the text repeats.

Defined cases: a null or empty text has no words and fails the base rules; lines are equal
if all their characters are; repeated rows are judged each, very long texts whole; other columns are not read by ``judge`` and kept
by ``passed``; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rxflow.llm.common import hold, map_arrow, table, texts, tune

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"

#: Shortest repeat in words, largest covered fraction, longest repeat in words. All words in such repeats also lie in
#: repeated 3-word windows, of which the base rule allows 50 %, so the fraction must be well below that to decide anything.
MIN_WORDS = 8
MAX_COVERED = 0.2
MAX_LONGEST = 50


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs of two arrays of small numbers (b from -1)."""
    return np.unique(a * (b.max(initial=0) + 2) + b + 1, return_inverse=True)[1]


def levels(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of all runs of 1, 2, 4, ... words (cut at the end), until no two are equal; ids count from 0 without gaps."""
    n = len(ids)
    out = [ids]
    while len(out[-1]) and out[-1].max() < n - 1 and 1 << (len(out) - 1) < n:
        k = 1 << (len(out) - 1)
        after = np.full(n, -1, np.int64)
        after[: n - k] = out[-1][k:]
        out.append(pairs(out[-1], after))
    return out


def suffixes(ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and, for each suffix but the first, the words it shares with the one before."""
    n = len(ranks[0])
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        k = 1 << level
        fits = (a + k <= n) & (b + k <= n)
        same = np.zeros(len(a), bool)
        same[fits] = ranks[level][a[fits]] == ranks[level][b[fits]]
        a, b, common = a + k * same, b + k * same, common + k * same
    return order, common


def repetition(ids: np.ndarray, min_words: int = MIN_WORDS) -> tuple[int, int]:
    """Words covered by repeats of at least min_words words, and the longest repeat."""
    n = len(ids)
    if n <= min_words:
        return 0, 0
    order, common = suffixes(levels(ids))
    longest = int(common.max(initial=0))
    if longest < min_words:
        return 0, longest
    reach = np.zeros(n, np.int64)  # of the repeat that starts at a word, by its rank
    reach[:-1] = common
    reach[1:] = np.maximum(reach[1:], common)
    reach[reach < min_words] = 0
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, order, reach > 0)
    np.add.at(edge, order + reach, -(reach > 0).astype(np.int64))
    return int((np.cumsum(edge)[:-1] > 0).sum()), longest


def repeated_windows(ids: np.ndarray, size: int = 3) -> int:
    """Words that lie in a window of size words which occurs at least twice."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    w = ids[:n]
    for k in range(1, size):
        w = pairs(w, ids[k : k + n])
    twice = np.flatnonzero(np.bincount(w)[w] > 1)
    hit = np.zeros(len(ids), bool)
    for k in range(size):
        hit[twice + k] = True
    return int(hit.sum())


def measure(text: str, min_words: int = MIN_WORDS) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered words, longest repeat."""
    hold("quality", int)  # has no table of its own
    words = _WORDS.findall(text)
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif _WORDS.search(line):
            seen.add(line)
    if len(number) == len(words):  # no word twice
        return len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), again, 0, 0, 0
    return (len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), again, repeated_windows(ids), *repetition(ids, min_words))


def passed(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([kept(measure(t, min_words), max_covered, max_longest) for t in texts(batch.column(at))], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def kept(measures: tuple[int, ...], max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> bool:
    n, _, _, _, again, covered, longest = measures
    return not base_failed(n, again) and covered <= max_covered * n and longest <= max_longest


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The measures, ``base_failed`` and ``kept`` of every text."""
    tune(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(t, min_words) for t in texts(batch["text"])]
        verdicts = [[base_failed(r[0], r[4]) for r in rows], [kept(r, max_covered, max_longest) for r in rows]]
        cols = [*(pa.array(x, pa.int64()) for x in zip(*rows)), *(pa.array(x, pa.bool_()) for x in verdicts)]
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), *cols], ["doc_id", *names, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, kept boolean"
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered"
    )


def _sql_windows(name: str, size: int) -> str:
    """Words in windows of a size that a text holds at least twice."""
    return f"""{name} AS (SELECT doc_id, COUNT(DISTINCT i + j) AS n FROM (
  SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, w) AS twice FROM (
    SELECT doc_id, i, array_to_string(words[i:i + {size - 1}], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - {size - 2})) AS i FROM t))), (SELECT unnest(range({size})) AS j)
  WHERE twice > 1 GROUP BY doc_id)"""


#: A word lies in a repeat of MIN_WORDS words or more if it lies in a repeated window of so many; the longest repeat exceeds
#: MAX_LONGEST if a window of one word more is repeated.
SQL = f"""
WITH t AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
lines AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
{_sql_windows("again", 3)},
{_sql_windows("covered", MIN_WORDS)},
{_sql_windows("long", MAX_LONGEST + 1)},
m AS (SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, coalesce(covered.n, 0) AS n_covered, coalesce(long.n, 0) AS n_long
  FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN long USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_covered <= {MAX_COVERED}::DOUBLE * n_words AND n_long = 0 AS kept, n_covered FROM m
"""