"""Operator 12 against a tree built by hand."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from rxflow.llm import merkle
from rxflow.llm.common import table

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash string, tree long, pos int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text, more=0):
    n_chars = None if n_chars is None else n_chars + more
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The top of a tree, and for each node its siblings, as (hashes, own place) from below."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            run = nodes[at // 2 * 2 : at // 2 * 2 + 2]
            paths[k].append((run, at % 2))
        nodes = [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        where = [at // 2 for at in where]
    return nodes[0], paths


def expected(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    out, tops = [], []
    for lang in order:
        held = sorted(((r, leaf(*r[:5])) for r in trees[lang]), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        top, paths = climb([h for _, h in held])
        tops.append(top)
        out += [(r, h, len(tops) - 1, path) for (r, h), path in zip(held, paths, strict=True)]
    root, above = climb(tops)
    found = []
    for r, h, tree, path in out:
        whole = path + above[tree]
        siblings = "".join(x for run, at in whole for k, x in enumerate(run) if k != at)
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        own = leaf(*r[:5], more=1) if hit else h
        for run, at in whole:
            own = digest("".join(own if k == at else x for k, x in enumerate(run)))
        found.append((r[0], h, tops[tree], root, digest(siblings), own, own == root))
    return sorted(found, key=str)


def rows_of(sizes):
    out = []
    for lang, n in sizes.items():
        for i in range(n):
            k = len(out)
            out.append((k * 3 % 1009, None if k % 5 == 0 else "s", lang, None if k % 4 == 0 else k, [f"text {k}", "", None, "ü" * 50][k % 4], "clash", 7, None))
    return out


def run(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, merkle.query(spark, str(folder)).collect()), key=str)


def test_equals_trees_built_by_hand(spark, tmp_path):
    """Null languages and fields, trees of one, two, 64, 65 and many rows, doc_ids that repeat, clashing columns."""
    rows = rows_of({None: 3, "": 1, "de": 64, "en": 300, "fr": 65, "zz": 2}) + [(None, None, None, None, None, None, None, None)] * 2 + [(5, "s", "en", 1, "same", "clash", 7, None)] * 3 + [(5, "s", "en", 2, "x" * 200_000, "clash", 7, None)]
    got = run(spark, rows, tmp_path)
    assert got == expected(rows)
    assert not all(r[-1] for r in got) and sum(r[-1] for r in got) > len(got) / 2


def test_largest_number_is_tampered_with_without_overflow(spark, tmp_path):
    doc = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0)
    rows = [(doc, "s", "en", 2**63 - 1, "t", None, None, None), (doc + 1, "s", "en", 1, "t", None, None, None)]
    assert run(spark, rows, tmp_path) == expected(rows)


@pytest.mark.parametrize("n", [0, 1])
def test_none_and_one(spark, tmp_path, n):
    rows = rows_of({"en": n})
    got = run(spark, rows, tmp_path)
    assert got == (expected(rows) if n else [])
    if n:
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == digest("")


def test_preimages_are_the_hashes_of_children(spark, sf):
    made = merkle.Manifest(table(spark, sf, "documents"))
    held = made.preimages().collect()
    parents = {(r["tree"], r["level"], r["index"]): digest(r["preimage"]) for r in held}
    assert parents[(None, max(r["level"] for r in held if r["tree"] is None), 0)] == made.root
    for r in held:
        if r["level"] > 1:
            below = [parents[k] for i in (0, 1) if (k := (r["tree"], r["level"] - 1, 2 * r["index"] + i)) in parents]
            assert r["preimage"] == "".join(below)
    assert made.proofs().where("folded_root <> root").isEmpty()


def test_proofs_need_no_python(spark, sf):
    plan = merkle.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert merkle.query(spark, sf).where(F.col("verified")).count() > 0
