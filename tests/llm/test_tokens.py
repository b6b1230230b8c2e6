"""Operators 1, 5 and 8 against the libraries and round trips."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rxflow.llm import bpe, packing, records, vocab

RANKS, JSON = vocab.vocab_file("byte_bpe_50k.tiktoken"), vocab.vocab_file("byte_bpe_50k.json")
ODD = [None, "", " ", "  a", "a  b ", "\n\n x\xa0\xa0y", "don't  we'll", "é中文🙂̈", "<|endoftext|>", "a <|endoftext|> b", "x" * 30_000, "1 " * 5_000, "࢏\U0001d7d8", "a \n\n b\t "]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def other_library():
    return Tokenizer.from_file(JSON)


def documents(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("part", F.lit(1))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoding_matches_the_library(library, text):
    ids = bpe.encoder(RANKS).encode(text).tolist()
    assert ids == library.encode_ordinary(text) and bpe.encoder(RANKS).decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\xa0ab's1²é中_!\x1c\x85\0", max_size=30) | st.text(alphabet="  \n\na'.", max_size=30), max_size=8))
def test_word_cache_matches_the_library(other_library, texts):
    got = [x.tolist() for x in vocab.words_of(JSON).encode_all(texts)]
    assert got == [other_library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_forgotten_without_harm(other_library, monkeypatch):
    monkeypatch.setattr(vocab, "CACHE_WORDS", 20)
    cache, rng = vocab.WordCache(JSON), random.Random(1)
    for _ in range(20):
        text = " ".join("".join(rng.choice("abc") for _ in range(3)) for _ in range(12))
        assert next(cache.encode_all([text])).tolist() == other_library.encode(text, add_special_tokens=False).ids
        assert len(cache.words) <= 10 and len(cache.words.old) <= 10


def test_a_long_piece_is_no_square(library):
    piece = ("the" * 20_000).encode()
    assert bpe.merge(piece, vocab.ranks_of(RANKS)) == library.encode_ordinary(piece.decode())


def test_encode_and_decode_tables(spark, library):
    docs = documents(spark, ODD)
    ids = bpe.encode(docs, RANKS)
    assert {r["doc_id"]: r["ids"] for r in ids.collect()} == {i: library.encode_ordinary(t or "") for i, t in enumerate(ODD)}
    assert {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode(ids, RANKS).collect()} == {i: (t or "").encode() for i, t in enumerate(ODD)}
    assert bpe.round_trip(docs.limit(0), RANKS).count() == 0


def test_frames_round_trip_and_tell_damage():
    ids = np.arange(5, dtype="<u2")
    data = b"".join(records.pack(i, ids[:i]) + records.END for i in range(4))
    assert [(d, x.tolist()) for _, d, x in records.unpack(data)] == [(i, list(range(i))) for i in range(4)]
    for at in range(0, len(data), 7):
        broken = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
        with pytest.raises(ValueError):
            list(records.unpack(broken))
    with pytest.raises(ValueError):
        list(records.unpack(data[:-3]))


def test_record_files(spark, other_library, tmp_path):
    docs = documents(spark, ODD).unionByName(documents(spark, ODD[3:4])).repartition(5)
    index = records.write(docs, f"file://{tmp_path}/r", JSON)
    got = records.starts(index).orderBy("start").collect()
    start = 0
    for r, (i, t) in zip(got, sorted([(0, ODD[3])] + list(enumerate(ODD)), key=lambda x: (x[0], x[1] or "", x[1] is not None))):
        assert r["doc_id"] == i and r["start"] == start
        start += r["n_tokens"]
    by_id = {(r["doc_id"], r["n_tokens"]): r["ids_crc32"] for r in got}
    for i, t in enumerate(ODD):
        ids = other_library.encode(t or "", add_special_tokens=False).ids + [0]
        assert by_id[i, len(ids)] == zlib.crc32(np.array(ids, "<u4").tobytes())
    one = next(r for r in got if r["doc_id"] == 6)  # a seek by the index
    with open(f"{tmp_path}/r/data/{one['file']}", "rb") as f:
        f.seek(one["offset"])
        (_, doc, ids), = records.unpack(f.read(one["length"]))
    assert doc == 6 and len(ids) == one["n_tokens"]


def test_rows_without_doc_id_come_first(spark, tmp_path):
    docs = spark.createDataFrame([(None, "b c"), (2, "d"), (None, None), (1, "a" * 50_000)], "doc_id long, text string")
    got = records.starts(records.write(docs, f"file://{tmp_path}/n", JSON)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 2] and sorted(r["n_tokens"] for r in got[:2])[0] == 1


def test_copies_of_one_doc_id_may_share_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "FILE_BYTES", 100)
    monkeypatch.setattr(records, "QUANTILES", 5)
    docs = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("t "), F.col("id").cast("string")).alias("text"))
    got = records.starts(records.write(docs, f"file://{tmp_path}/s", JSON)).orderBy("start").collect()
    assert len(got) == 400 and len({r["file"] for r in got}) > 4
    assert [r["start"] for r in got] == [sum(p["n_tokens"] for p in got[:k]) for k in range(400)]


def test_files_are_in_order_of_their_numbers(spark):
    names = [f"part-{k:05d}-x-c000.txt" for k in (99_998, 99_999, 100_000, 1_000_000)]
    rows = spark.createDataFrame([(n, 10**k, 0) for k, n in enumerate(names)], "file string, n_tokens long, position long")
    assert [r["start"] for r in records.starts(rows).orderBy("file").collect()] == [r for _, r in sorted(zip(names, [0, 1, 11, 111]))]


def test_no_records(spark, tmp_path):
    assert records.starts(records.write(documents(spark, ["x"]).limit(0), f"file://{tmp_path}/e", JSON)).count() == 0


def brute_best_fit(lengths, size):
    rooms, out = [], []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            room, i = min(fits)
            rooms[i] -= n
        else:
            rooms.append(size - n)
    return sorted(rooms)


@settings(max_examples=2_000, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    size = 16
    counts = {n: lengths.count(n) for n in set(lengths)}
    windows, placed = {}, []
    for length, rank, n, first, at in packing.plan(counts.items(), size):
        for k in range(n):
            windows.setdefault(first + k, []).append((at, length))
            placed.append((length, rank + k))
    assert sorted(placed) == sorted((n, k) for n, c in counts.items() for k in range(c))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(size - sum(n for _, n in parts) for parts in windows.values()) == brute_best_fit(lengths, size)
    assert sorted(windows) == list(range(len(windows)))


def test_rooms_find_the_tightest():
    rooms = packing.Rooms(16)
    for r in (3, 7, 16):
        rooms.add(r, 1)
    assert [rooms.tightest(n) for n in (1, 3, 4, 8, 16)] == [3, 3, 7, 16, 16]
    rooms.add(16, -1)
    assert rooms.tightest(8) is None


def test_packed_documents(spark, other_library):
    texts = ODD + ["a b c"] * 50 + ["word " * n for n in range(1, 200, 7)]
    rows = packing.pack(documents(spark, texts), JSON, size=64).collect()
    for i, t in enumerate(texts):
        ids = other_library.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in mine] == list(range(0, len(ids), 64)) and sum(r["length"] for r in mine) == len(ids) == mine[0]["doc_tokens"]
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in mine)
    for s in {r["sequence_id"] for r in rows}:
        parts = sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"])
        held = sum(r["length"] for r in parts)
        assert [r["offset"] for r in parts] == [sum(p["length"] for p in parts[:k]) for k in range(len(parts))] and held <= 64
        assert {r["padded_length"] for r in parts} == {held if held & (held - 1) == 0 else 64}
    assert packing.pack(documents(spark, ["x"]).limit(0), JSON).count() == 0
