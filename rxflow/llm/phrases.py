"""Operator 11: phrases whose words stand together more often than chance has it, found level by level.

Every level is a pass over all texts. The first counts words; each later one counts phrases of k words, but only where the
phrases of k - 1 words at their start and at their end were both found often enough, since no phrase can be more frequent than its
parts. Tasks count in batches of some megabytes, and the counts are summed before and after the shuffle.

What a pass must know of the level before it is broadcast as a sieve: a bitmap of hashes that never misses a frequent phrase and
lets through some others, which are then counted and dropped. So it has a fixed greatest size (SIEVE) however many phrases there are.
All parts of a frequent phrase are frequent, hence the level tables hold every count that the scores of its cuts need.

Defined cases: a null or empty text has no words, a null language is ``und``; texts of any length are read whole, repeated rows count each;
a phrase never spans two pieces or documents; ties are settled by score, count, then phrase in the order of UTF-8 bytes; without frequent words, or of an
empty table, the result is empty; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxflow.llm.common import BROADCAST_ROWS, stored, table, tune

#: Words of a phrase at most, how often it must occur, and how many of each language are reported.
LONGEST, LEAST, FIRST = 5, 100, 2000
#: Bytes of text that a task counts at a time, and rows that it returns at a time.
CHUNK, ROWS = 8 << 20, 1 << 16
#: Bits of a sieve: so many for each phrase, at most 16 MB.
EACH, SIEVE = 32, 1 << 27
#: Parts of a language whose first phrases are told before they meet.
SALTS = 64

# How bytes are read. A-Z in lower case, ends of pieces as line feeds, white space as a space.
_READ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")

Sieve = Callable[[np.ndarray], np.ndarray]


def _codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values, and the place of each value among them."""
    found = pa.array(values).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _hashes(words: pa.StringArray) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def _chain(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer; the first hash is that of a language."""
    return ((before ^ (before >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) ^ word


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a sieve that stand for a phrase."""
    x = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return x & np.uint64(bits - 1), (x >> np.uint64(32)) & np.uint64(bits - 1)


def _words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """Different words; then of each word of the texts its place among them, its piece, and its text."""
    _, offsets, data = texts.buffers()
    low = pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(data.to_pybytes().translate(_READ) if data else b""))
    pieces = pc.split_pattern(low, "\n")
    cut = pc.split_pattern(pieces.flatten(), " ")
    words, piece = cut.flatten(), pc.list_parent_indices(cut)
    there = pc.not_equal(words, "")
    words, piece = words.filter(there), piece.filter(there).to_numpy()
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), piece, pc.list_parent_indices(pieces).to_numpy()[piece]


def count_batch(texts: pa.StringArray, langs: pa.StringArray, size: int, sieves: list[Sieve]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Languages, phrases and counts of the phrases of ``size`` words whose two parts of one word less pass the sieves."""
    words, word, piece, text = _words(texts)
    tongues = langs.dictionary_encode()
    tongue = tongues.indices.to_numpy()[text]
    start = np.arange(len(word))
    if size > 1:
        one = _hashes(words)[word]
        hashed, known = _chain(_hashes(tongues.dictionary)[tongue], one), None
        for k in range(1, size):  # where phrases of k words begin that pass
            if k > 1:
                hashed = _chain(hashed[:-1], one[k - 1 :])
            known = sieves[k - 1](hashed) if known is None else known & sieves[k - 1](hashed)
            n = max(0, len(known) - 1)
            known = known[:n] & known[1:] & (piece[:n] == piece[k : k + n])  # both parts, in one piece
        start = np.flatnonzero(known)
    gram = _codes(tongue[start].astype(np.int64) * max(len(words), 1) + word[start])[1].astype(np.int64)
    for k in range(1, size):
        gram = _codes(gram * max(len(words), 1) + word[start + k])[1].astype(np.int64)
    n = np.bincount(gram)
    first = np.empty(len(n), np.int64)
    first[gram[::-1]] = start[::-1]  # one place of each phrase
    parts = [words.take(pa.array(word[first + k])) for k in range(size)]
    return tongues.dictionary.take(pa.array(tongue[first])), pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0], n.astype(np.int64)


def sieve(level: DataFrame, size: int) -> Sieve:
    """A test of hashes that passes all phrases of a stored level table of ``size`` words and few others."""
    spark = level.sparkSession
    bits = 1 << max(10, min(SIEVE.bit_length() - 1, int(level.count() * EACH).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = batch["lang"].dictionary_encode(), pc.split_pattern(batch["phrase"], " ").flatten().dictionary_encode()
            hashed = _hashes(langs.dictionary)[langs.indices.to_numpy()]
            for word in _hashes(words.dictionary)[words.indices.to_numpy()].reshape(-1, size).T:
                hashed = _chain(hashed, word)
            yield pa.record_batch([pa.array(np.concatenate(_places(hashed, bits)).astype(np.int64))], ["p"])

    one = F.expr("shiftleft(1L, int(p & 63))")
    places = level.where("phrase IS NOT NULL").mapInArrow(place, "p long")
    rows = places.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(one).alias("held")).toArrow()
    held = np.zeros(bits >> 6, np.int64)
    held[rows["at"].to_numpy()] = rows["held"].to_numpy()
    sent = spark.sparkContext.broadcast(held.view(np.uint64))

    def passes(hashed: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashed), bool)
        for p in _places(hashed, bits):
            out &= (sent.value[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out

    return passes


def counts(docs: DataFrame, size: int, sieves: list[Sieve]) -> DataFrame:
    """``lang, phrase, f`` of all phrases of ``size`` words that pass; with ``size`` 1 also a row without a phrase for all words of a language."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def counted(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches)
        text, lang = (pa.concat_arrays(whole[c].cast(pa.string()).chunks) for c in ("text", "lang"))
        langs, phrases, n = count_batch(text, lang, size, sieves)
        out = pa.table([langs, phrases, pa.array(n)], schema=schema)
        if size == 1:
            every = out.group_by("lang").aggregate([("n", "sum")])
            out = pa.concat_tables([out, pa.table([every["lang"], pa.nulls(len(every), pa.string()), every["n_sum"]], schema=schema)])
        yield from out.to_batches(max_chunksize=ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        for batch in batches:
            held.append(batch)
            size_held += batch.nbytes
            if size_held >= CHUNK:
                yield from counted(held)
                held, size_held = [], 0
        if sum(b.num_rows for b in held):
            yield from counted(held)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> list[DataFrame]:
    """The level tables ``lang, phrase, f`` of sizes from 1 to ``longest``, frequent phrases only, each stored."""
    tune(docs.sparkSession)
    out = [stored(counts(docs, 1, []).where((F.col("f") >= least) | F.col("phrase").isNull()))]
    sieves: list[Sieve] = []
    for k in range(2, longest + 1):
        sieves.append(sieve(out[-1], k - 1))
        out.append(stored(counts(docs, k, sieves).where(F.col("f") >= least)))
    return out


def _parts(words: Column, cut: Column) -> tuple[Column, Column]:
    return F.array_join(F.slice(words, 1, cut), " "), F.array_join(F.slice(words, cut + 1, F.size(words) - cut), " ")


def scored(tables: list[DataFrame]) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of every phrase of two words and more, by its lowest-scoring cut."""
    known = reduce(DataFrame.unionByName, tables).where("phrase IS NOT NULL")
    totals = tables[0].where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    longer = reduce(DataFrame.unionByName, tables[1:]).select("lang", "phrase", F.col("f").alias("a"), words.alias("words"))
    cuts = longer.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    first, rest = _parts(F.col("words"), F.col("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", first.alias("first"), rest.alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    side = F.broadcast(totals) if totals.count() <= BROADCAST_ROWS else totals
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(cast(1000 as decimal(4,0)) * (a * n)) div (l * r)")
    cuts = cuts.join(side, "lang").select("lang", "phrase", "k", *(wide(c).alias(c) for c in "alrn")).withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    return best.select("lang", "phrase", *(F.col(f"cut.{c}").cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))


def covered(tables: list[DataFrame]) -> DataFrame:
    """``lang, phrase, most``: how often the most frequent phrase of one more word that holds this one occurs.

    A longer one yet is not more frequent than that one, so looking one word further is enough.
    """
    words = F.split("phrase", " ")
    ends = [F.array_join(F.slice(words, 1, F.size(words) - 1), " "), F.array_join(F.slice(words, 2, F.size(words) - 1), " ")]
    rows = reduce(DataFrame.unionByName, tables[2:]) if len(tables) > 2 else tables[0].limit(0)
    return rows.select("lang", F.explode(F.array(*ends)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """The best ``first`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Phrases that always stand inside one longer phrase are left out. A language's first ones are told in parts, so that
    the task that ranks them gets SALTS times ``first`` rows at most.
    """
    tables = levels(docs, longest, least)
    rows = scored(tables).join(covered(tables), ["lang", "phrase"], "left").where("most IS NULL OR most < a").drop("most")
    by = (F.desc("score"), F.desc("a"), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("rank") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM worded WHERE len(w) > 0),
spans AS (SELECT lang, w, i, k FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
freq AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM spans GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE k > 1),
cuts AS (SELECT lang, phrase, k, a, w, unnest(generate_series(1, k - 1)) AS c FROM cand),
scores AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, a, c, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN total USING (lang)
  JOIN freq x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:c], ' ')
  JOIN freq y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[c + 1:cuts.k], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM cand q WHERE q.lang = b.lang AND q.k > b.k AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * q.a >= 100 * b.a)),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""
