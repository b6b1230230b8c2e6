"""Operator 1: byte-level BPE encoding and decoding.

A piece (one match of the splitting pattern) is merged over a segment tree whose leaves
are byte positions. Leaf ``i`` holds the rank of the pair that starts at ``i`` (its live
token and the next live one); a node holds the leftmost smallest of its leaves. A merge
takes the root, joins two neighbours and updates the leaves of three positions, each in
logarithmic time, so that a piece of n bytes takes O(n log n) at any length.

Defined cases: a null or empty text has no ids; repeated rows are encoded each; an empty
table gives an empty result; only ``doc_id`` and ``text`` are read, whatever else a table has.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rxflow.llm import vocab
from rxflow.llm.common import hold, map_arrow, table, texts, tune

_NONE = 1 << 62


def merge(piece: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """Ids of one piece: always join the leftmost pair of the smallest rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(0, n - 2).bit_length()
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r * size + i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))  # where the token that starts at i ends
    before = list(range(-1, n))  # where the token before the one that starts at i starts

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    def rank(i: int) -> int:
        """Of the pair that starts at i."""
        j = after[i]
        if j >= n or (r := get(piece[i : after[j]])) is None:
            return _NONE
        return r * size + i

    while (least := tree[1]) != _NONE:
        i = least % size
        j = after[i]
        end = after[i] = after[j]
        if end < n:
            before[end] = i
        put(j, _NONE) if j < size else None
        put(i, rank(i))
        if (p := before[i]) >= 0:
            put(p, rank(p))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Texts to ids and back, by a vocabulary file of ranks and a splitting pattern (None: the public one)."""

    def __init__(self, path: str, pattern: str | None = None):
        self.ranks = vocab.ranks_of(path)
        self.pieces = vocab.bytes_of(path)
        find = vocab.splitter(pattern).findall if pattern else None
        self.words = vocab.Words(self._merged, lambda word: [word], find) if find else vocab.Words(self._merged)

    def _merged(self, piece: str) -> bytes:
        return array("I", merge(piece.encode(), self.ranks)).tobytes()

    def encode_all(self, batch: list[str]) -> Iterator[np.ndarray]:
        return map(self.encode, batch)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.words.ids(text), "<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])


_encoders: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, pattern: str | None = None) -> Encoder:
    """The encoder of this process."""
    hold("bpe", _encoders.clear)
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids``: the ids of every text."""
    tune(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path, pattern)
        ids = [x.astype(np.int32) for x in e.encode_all(texts(batch["text"]))]
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """``doc_id, bytes``: the bytes of every row of ``encode``; a null row has none."""
    tune(ids.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        out = [e.decode(x or ()) for x in batch["ids"].to_pylist()]
        return pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return map_arrow(ids.select("doc_id", "ids"), run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """Digests of the ids of every text and of the bytes that they decode to, in one pass.

    The same as ``encode`` and ``decode`` after it, without carrying ids between them.
    """
    tune(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path, pattern)
        n, sums, back = [], [], []
        for ids in e.encode_all(texts(batch["text"])):
            n.append(len(ids))
            sums.append(hashlib.sha256(ids).hexdigest())
            back.append(hashlib.sha256(e.decode(ids.tolist())).hexdigest())
        return pa.record_batch(
            [batch["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocab.vocab_file("byte_bpe_50k.tiktoken"))
