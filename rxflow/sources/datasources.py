"""Python data sources: FASTA files split by byte ranges, and paged searches as tables and streams.

``register(spark)`` makes ``spark.read.format("fasta")``, ``spark.read.format("paged")`` and ``spark.readStream.format("paged")`` known. Tasks open
files through Arrow's file systems (local, HDFS, S3 and what else Arrow reads by URI).
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a FASTA file that a task reads, and rows that a task returns at a time.
SPLIT_BYTES, ROWS = 32 << 20, 4096


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if urlsplit(path).scheme else (fs.LocalFileSystem(), path)


# ---- FASTA ----------------------------------------------------------------------------


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class FastaReader(DataSourceReader):
    """Records by the place of their header: a task reads those whose header begins in its range, and the last one to its end."""

    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> Sequence[InputPartition]:
        store, at = _store(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File]
        prefix = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        return [ByteRange(prefix + f.path, s, min(s + self.split, f.size)) for f in sorted(files, key=lambda f: f.path) for s in range(0, f.size, self.split)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, str, int]] = []
        for accession, sequence, at in fasta_range(partition.path, partition.start, partition.end):
            held.append((accession, sequence, partition.path, at))
            if len(held) >= ROWS:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple[str, str, str, int]]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["accession", "sequence", "file", "at"])


def accession_of(header: str) -> str:
    """The second field of a header with bars, else its first word."""
    fields = header.split("|")
    return fields[1] if len(fields) >= 2 else (header.split() or [""])[0]


def _lines(file: Any, piece: int = 1 << 20) -> Iterator[bytes]:
    """Lines with their ends, of a file from where it stands."""
    left = b""
    while data := file.read(piece):
        *whole, left = (left + data).split(b"\n")
        yield from (line + b"\n" for line in whole)
    if left:
        yield left


def fasta_range(path: str, start: int, end: int) -> Iterator[tuple[str, str, int]]:
    """Accession, sequence and place of the records whose header begins at ``start`` or later and before ``end``."""
    store, name = _store(path)
    with store.open_input_file(name) as file:
        at = max(0, start - 1)  # one byte earlier, to see whether a line begins at the start
        file.seek(at)
        header, place, parts = None, 0, []
        for k, line in enumerate(_lines(file)):
            begins = at
            at += len(line)
            if k == 0 and start > 0:  # the rest of a line that began before
                continue
            if line.startswith(b">"):
                if header is not None:
                    yield accession_of(header), "".join(parts), place
                header, parts = None, []
                if begins >= end:
                    return
                header, place = line[1:].decode().rstrip("\r\n"), begins
            elif header is not None:
                parts.append("".join(line.decode().split()))
        if header is not None:
            yield accession_of(header), "".join(parts), place


class FastaSource(DataSource):
    """``accession, sequence, file, at``; options ``path`` (a file or folder) and ``splitBytes``. Text before the first header is ignored; of an
    accession that repeats each record is a row, ordered by ``at``."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return "accession string, sequence string, file string, at long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastaReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


# ---- paged searches -------------------------------------------------------------------

#: Gives (pages that there are, items) of one page of a query.
Fetch = Callable[[dict[str, str], int], tuple[int, list[str]]]


def fetch_page(options: dict[str, str], page: int) -> tuple[int, list[str]]:
    """One page by HTTP: ``url`` with ``page`` and ``size``; the answer is JSON with ``pages`` and ``items``."""
    from rxflow.sources.lookups import http_get

    given = {k: v for k, v in options.items() if k.lower().startswith("query.")}
    answer = json.loads(http_get(options["url"], {k[6:]: v for k, v in given.items()} | {"page": str(page), "size": options.get("size", "100")}))
    return int(answer["pages"]), [x if isinstance(x, str) else json.dumps(x, sort_keys=True) for x in answer["items"]]


def _fetcher(options: dict[str, str]) -> Fetch:
    """That of option ``fetch`` (``module:function``), else HTTP."""
    module, _, name = options.get("fetch", f"{__name__}:fetch_page").partition(":")
    return getattr(importlib.import_module(module), name)


@dataclass
class Pages(InputPartition):
    first: int
    last: int  # exclusive


def _dealt(first: int, last: int, each: int) -> list[Pages]:
    return [Pages(p, min(p + each, last)) for p in range(first, last, each)]


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.held = dict(options)
        self.each = int(options.get("pagespertask", options.get("pagesPerTask", 10)))

    def partitions(self) -> Sequence[InputPartition]:
        return _dealt(0, _fetcher(self.held)(self.held, 0)[0], self.each)

    def read(self, partition: Pages) -> Iterator[tuple]:
        fetch = _fetcher(self.held)
        for page in range(partition.first, partition.last):
            yield from ((page, k, item) for k, item in enumerate(fetch(self.held, page)[1]))


class PagedStreamReader(DataSourceStreamReader):
    """Pages that came up since the last batch. The offset is the number of pages that are done, so a query that is started again goes on there."""

    def __init__(self, options: dict[str, str]):
        self.batch = PagedReader(options)

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        return {"pages": _fetcher(self.batch.held)(self.batch.held, 0)[0]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _dealt(start["pages"], end["pages"], self.batch.each)

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.batch.read(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    """``page, place, item`` of a search that answers in pages; options ``url``, ``size``, ``query.*``, ``pagesPerTask`` and ``fetch``."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, place int, item string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagedStreamReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (FastaSource, PagedSource):
        spark.dataSource.register(source)
