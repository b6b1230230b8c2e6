"""Resumable lookups through injected fetchers: sequences, archived sequences, accessions.

Executors fetch; what they find is appended to a cache batch by batch, so that a run which stops
continues where it was. Fetchers are plain functions; tests inject fakes and need no network.
"""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from http.client import HTTPException

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from rxflow.operators.build import lacking
from rxflow.sources.tables import KeyValueCache

# The public addresses of the protein databases.
SEQUENCES_URL = "https://rest.uniprot.org/uniprotkb/accessions"
SEARCH_URL = "https://rest.uniprot.org/uniprotkb/search"
ARCHIVE_URL = "https://rest.uniprot.org/uniparc/search"


def http_get(url: str, params: dict[str, str], tries: int = 3, wait: float = 2.0, timeout: float = 60.0, opened: Callable = urllib.request.urlopen) -> str:
    """An answer as text; waits longer after each failure and raises RuntimeError after the last."""
    address = f"{url}?{urllib.parse.urlencode(params)}"
    failed: Exception | None = None
    for n in range(tries):
        if n:
            time.sleep(wait * n)
        try:
            with opened(urllib.request.Request(address, headers={"User-Agent": "rxflow"}), timeout=timeout) as answer:
                return answer.read().decode()
        except (OSError, HTTPException) as e:
            failed = e
    raise RuntimeError(f"{url}: no answer in {tries} tries: {failed}")


def parse_fasta(text: str) -> dict[str, str]:
    """Sequences by accession, on the driver; see tables.fasta_records for columns."""
    out: dict[str, str] = {}
    for entry in ("\n" + text).split("\n>")[1:]:
        header, _, body = entry.partition("\n")
        pipes = header.split("|")
        name = pipes[1] if len(pipes) >= 2 else (header.split() or [""])[0]
        out[name] = "".join(body.split())
    return out


def fetch_sequences_http(batch: list[str]) -> dict[str, str]:
    return parse_fasta(http_get(SEQUENCES_URL, {"accessions": ",".join(batch), "format": "fasta"}))


def fetch_archived_http(accession: str) -> str:
    answer = json.loads(http_get(ARCHIVE_URL, {"query": accession, "fields": "upi,sequence", "format": "json", "size": "1"}))
    hits = answer.get("results") or [{}]
    return (hits[0].get("sequence") or {}).get("value") or ""


def search_text(ec: str, organism: str, reviewed: bool = False) -> str:
    parts = [f"(ec:{ec})"] + ([f'(organism_name:"{organism}")'] if organism else []) + (["(reviewed:true)"] if reviewed else [])
    return " AND ".join(parts)


def parse_hits(tsv: str) -> list[str]:
    return [line.split("\t")[0] for line in tsv.splitlines() if line.strip()][1:]


def search_accessions_http(ec: str, organism: str, most: int = 5, prefer_reviewed: bool = True) -> list[str]:
    """Reviewed entries alone, if there are any, else all."""
    for reviewed in (True, False) if prefer_reviewed else (False,):
        params = {"query": search_text(ec, organism, reviewed), "fields": "accession", "format": "tsv", "size": str(most)}
        if hits := parse_hits(http_get(SEARCH_URL, params)):
            return hits
    return []


def _fetched(todo: DataFrame, keys: list[str], value: str, kind: str, size: int, fetch: Callable[[list[tuple]], list]) -> DataFrame:
    """Calls ``fetch`` for ``size`` keys at a time; it returns a value, or None for one to be tried again, for each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                got = fetch(list(part.itertuples(index=False, name=None)))
                known = [g is not None for g in got]
                yield part[known].assign(**{value: [g for g in got if g is not None]})

    schema = ", ".join([*(f"{k} string" for k in keys), f"{value} {kind}"])
    return todo.select(*keys).mapInPandas(run, schema)


def _resume(cache: KeyValueCache, wanted: DataFrame, kind: str, size: int, per_flush: int, fetch: Callable[[list[tuple]], list]) -> DataFrame:
    """Looks up what is missing, in flushes of about ``per_flush`` keys, and returns the cached rows of the wanted keys."""
    todo = cache.missing(wanted).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        flushes = -(-todo.count() // per_flush)
        numbered = todo.withColumn("flush", F.pmod(F.xxhash64(*cache.keys), F.lit(max(1, flushes))))
        stamp = int(time.time() * 1000)
        for n in range(flushes):
            cache.add(_fetched(numbered.where(F.col("flush") == n), cache.keys, cache.value, kind, size, fetch), stamp + n)
    finally:
        todo.unpersist()
    return wanted.select(*cache.keys).distinct().join(cache.rows(), cache.keys)


def fetch_sequences(spark: SparkSession, wanted: DataFrame, cache_path: str, batch_size: int = 200, per_flush: int = 20_000, fetch_batch: Callable[[list[str]], dict[str, str]] = fetch_sequences_http) -> DataFrame:
    """``accession, sequence`` of the accessions that resolve; misses are remembered as empty and left out."""
    cache = KeyValueCache(spark, cache_path, ["accession"], "sequence", "string")

    def fetch(keys: list[tuple]) -> list:
        found = fetch_batch([k[0] for k in keys])
        return [found.get(k[0], "") for k in keys]

    return _resume(cache, wanted, "string", batch_size, per_flush, fetch).where("sequence <> ''")


def archived_sequences(spark: SparkSession, wanted: DataFrame, cache_path: str, per_flush: int = 5_000, fetch_one: Callable[[str], str] = fetch_archived_http) -> DataFrame:
    """The same, one accession at a time, from an archive."""
    cache = KeyValueCache(spark, cache_path, ["accession"], "sequence", "string")
    return _resume(cache, wanted, "string", 50, per_flush, lambda keys: [fetch_one(k[0]) or "" for k in keys]).where("sequence <> ''")


def search_accessions(spark: SparkSession, pairs: DataFrame, cache_path: str, per_flush: int = 2_500, skip_errors: bool = False, fetch_one: Callable[[str, str], list[str]] = search_accessions_http) -> DataFrame:
    """``ec_num, organism, accessions`` of distinct pairs; a pair without hits has an empty list.

    With ``skip_errors`` a pair that fails stays unknown and is tried again by the next run.
    """
    cache = KeyValueCache(spark, cache_path, ["ec_num", "organism"], "accessions", "array<string>")

    def fetch(keys: list[tuple]) -> list:
        out = []
        for ec, organism in keys:
            try:
                out.append(list(fetch_one(ec, organism)))
            except Exception:
                if not skip_errors:
                    raise
                out.append(None)
        return out

    return _resume(cache, pairs, "array<string>", 25, per_flush, fetch)


def with_fallback(spark: SparkSession, wanted: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], key: str = "accession", told: str = "sequence_source", names: tuple[str, str] = ("primary", "archive")) -> DataFrame:
    """Rows of the first source, and of the second for keys that the first lacks; column ``told`` says of which."""
    found = first(wanted)
    rest = lacking(wanted.select(key).distinct(), found, key)
    return found.withColumn(told, F.lit(names[0])).unionByName(second(rest).withColumn(told, F.lit(names[1])))
