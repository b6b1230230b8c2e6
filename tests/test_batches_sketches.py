import random

import pytest
from pyspark.sql import functions as F

from rxflow.operators import embed, sketches


def lengths(spark, sizes):
    return spark.createDataFrame([(f"r{i:05d}", n, i) for i, n in enumerate(sizes)], "id string, n int, at int").repartition(3)


def test_batches_stay_within_the_budget_with_little_padding(spark):
    rng = random.Random(1)
    sizes = [min(4000, int(rng.paretovariate(1.1) * 20)) for _ in range(8000)]  # skewed
    rows = lengths(spark, sizes)
    got = embed.token_batches(rows, "n", 8192).collect()
    batches = {}
    for r in got:
        batches.setdefault(r["batch"], []).append(r)
    assert sorted((r["at"], r["n"]) for r in got) == list(enumerate(sizes))
    for held in batches.values():
        assert len({r["width"] for r in held}) == 1 and held[0]["width"] == max(max(r["n"] for r in held), 1)
        assert len(held) == 1 or len(held) * held[0]["width"] <= 8192
    found = embed.padding(embed.token_batches(rows, "n", 8192), "n").first()
    assert found["padding"] < 0.05 and found["n_batches"] == len(batches) and found["n_rows"] == 8000
    full = [h for h in batches.values() if (len(h) + 1) * h[0]["width"] > 8192]
    assert len(batches) - len(full) <= rows.sparkSession.sparkContext.defaultParallelism + 4  # the last of each task


def test_odd_lengths(spark):
    got = embed.token_batches(lengths(spark, [None, 0, 0, 9000, 5, 5]), "n", 10).collect()
    alone = [r for r in got if r["n"] == 9000]
    assert sum(r["batch"] == alone[0]["batch"] for r in got) == 1 and alone[0]["width"] == 9000
    assert len(got) == 6 and embed.token_batches(lengths(spark, [1]).limit(0), "n", 10).count() == 0
    with pytest.raises(ValueError):
        embed.token_batches(lengths(spark, [1]), "n", 0)


def test_embeddings_by_tokens_equal_those_by_rows(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(f"p{i}", "ACDE"[i % 4] * rng.randrange(1, 300)) for i in range(400)], "id string, sequence string")
    encode = lambda texts: [[float(len(t)), float(ord(t[0]))] for t in texts]
    read = lambda df: {r["id"]: list(r["embedding"]) for r in df.collect()}
    assert read(embed.embed_by_tokens(rows, encode, 1000)) == read(embed.embed(rows, encode))


def test_labels_are_padded_to_their_batch(spark):
    rows = spark.createDataFrame([("a", [1, 2, 3]), ("b", [4]), ("c", [5, 6])], "id string, labels array<int>").withColumn("n", F.size("labels"))
    got = embed.batch_padded(embed.token_batches(rows.coalesce(1), "n", 100), "labels").collect()
    assert all(len(r["labels"]) == r["width"] for r in got) and {tuple(x for x in r["labels"] if x != -100) for r in got} == {(1, 2, 3), (4,), (5, 6)}


def test_sketches_of_ten_builds_add_up(spark, tmp_path):
    path = str(tmp_path / "counts")
    for b in range(10):
        rows = spark.range(b * 3000, b * 3000 + 6000).select(F.concat(F.lit("P"), "id").alias("uniprot_id"), (F.col("id") % 97).cast("string").alias("ec num"), F.when(F.col("id") % 2 == 0, "").alias("organism"))
        sketches.save(rows, ["uniprot_id", "ec num", "organism"], path, f"b{b}", exact=True)
    want = {"uniprot_id": 33000, "ec num": 97, "organism": 1}
    assert {r["column"]: r["n_distinct"] for r in sketches.exact(spark, path).collect()} == want
    got = {r["column"]: r for r in sketches.estimates(spark, path).collect()}
    assert all(abs(got[c]["n_distinct"] - n) <= 4 * sketches.error() * n for c, n in want.items()) and got["uniprot_id"]["rows"] == 60000
    some = {r["column"]: r["n_distinct"] for r in sketches.exact(spark, path, ["b0", "b2"]).collect()}
    near = {r["column"]: r["n_distinct"] for r in sketches.estimates(spark, path, ["b0", "b2"]).collect()}
    assert some["uniprot_id"] == 12000 and abs(near["uniprot_id"] - 12000) <= 4 * sketches.error() * 12000
    sketches.save(spark.range(5).select(F.col("id").cast("string").alias("uniprot_id")), ["uniprot_id"], path, "b0")  # a build is replaced
    assert {r["column"]: r["rows"] for r in sketches.estimates(spark, path, ["b0"]).collect()} == {"uniprot_id": 5}


def test_sketch_of_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(None,)], "x string")
    sketches.save(rows, ["x"], str(tmp_path), "none", exact=True)
    assert sketches.estimates(spark, str(tmp_path)).first()["n_distinct"] == 0
