import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rxflow.operators import cluster, split
from rxflow.schema import CheckFailed


def test_shuffled_split_counts_and_seeds():
    groups = list(range(100))
    a, b, c = (split.shuffled_split(groups, seed=s) for s in (0, 0, 1))
    assert a == b != c
    assert [list(a.values()).count(s) for s in ("train", "valid", "test")] == [80, 10, 10]


def test_fractions_must_sum_to_one():
    with pytest.raises(ValueError):
        split.shuffled_split([1], (0.5, 0.3, 0.1))


@settings(max_examples=30, deadline=None)
@given(st.sets(st.text(max_size=4), max_size=40), st.integers(0, 99))
def test_every_group_gets_one_split(groups, seed):
    got = split.shuffled_split(list(groups), seed=seed)
    assert set(got) == groups and set(got.values()) <= {"train", "valid", "test"}


@pytest.mark.parametrize("mode", ["hash", "exact"])
def test_groups_stay_whole(spark, mode):
    rows = spark.range(1000).withColumn("g", F.col("id") % 100)
    out = split.assign_splits(rows, "g", mode=mode)
    split.assert_no_leak(out, "g")
    assert {r["split"]: r["n"] for r in split.split_counts(out).collect()} == {"train": 800, "valid": 100, "test": 100}


def test_forced_groups(spark):
    rows = spark.createDataFrame([("g1", "train", True), ("g1", "valid", False), ("g2", "valid", False), ("g3", "train", None), (None, "train", False)], "g string, split string, human boolean")
    out = split.force_to_test(rows, F.col("human"), "g")
    assert sorted((r["g"] or "", r["split"]) for r in out.collect()) == [("", "train"), ("g1", "test"), ("g1", "test"), ("g2", "valid"), ("g3", "train")]
    split.assert_held_out(out, F.col("human"), ["split"])
    with pytest.raises(CheckFailed):
        split.assert_held_out(rows, F.col("human"), ["split"])


def test_leaks_are_found(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "test")], "g string, split string")
    with pytest.raises(CheckFailed):
        split.assert_no_leak(rows, "g")


def test_overlap_matches_nulls(spark):
    rows = spark.createDataFrame([("A", "train"), (None, "train"), ("A", "test"), ("C", "test"), (None, "test"), ("D", "test")], "k string, split string")
    assert split.overlap(rows, "k").first()["share"] == 0.5
    assert split.overlap(rows.where("split = 'train'"), "k").first()["share"] == 0.0


@pytest.mark.parametrize("exact", [False, True])
def test_shuffle_control_keeps_pairs(spark, exact):
    rows = spark.createDataFrame([(i, u, s) for i, (u, s) in enumerate([("A", "x"), ("A", "x"), ("B", "y"), ("C", "z"), ("C", "z")])], "i int, u string, s string")
    out = split.shuffled_pairs(rows, ["i"], ["u", "s"], exact=exact)
    pairs = lambda df: sorted((r["u"], r["s"]) for r in df.collect())
    assert pairs(out) == pairs(rows) and sorted(r["i"] for r in out.collect()) == list(range(5))


def test_exact_shuffles_refuse_many_rows(spark, monkeypatch):
    monkeypatch.setattr(split, "EXACT_ROWS", 4)
    rows = spark.range(5).withColumn("s", F.col("id"))
    with pytest.raises(ValueError):
        split.shuffled_pairs(rows, ["id"], ["s"], exact=True)
    assert split.shuffled_pairs(rows, ["id"], ["s"]).count() == 5


def greedy(ids: list[str], lengths: list[int], sets: list[frozenset], threshold: float) -> list[int]:
    """The index of the representative of each sequence: longest first, each joins the most similar
    representative of at least the threshold (the earliest of equal ones), or becomes one."""
    out = [0] * len(ids)
    chosen: list[int] = []
    for i in sorted(range(len(ids)), key=lambda i: (-lengths[i], ids[i])):
        best, at = 0.0, -1
        for r in chosen if sets[i] else ():
            both = len(sets[i] & sets[r])
            s = both / (len(sets[i]) + len(sets[r]) - both)
            if s >= threshold and s > best:
                best, at = s, r
        if at < 0:
            chosen.append(i)
            at = i
        out[i] = at
    return out


def mutated(base, n, rng):
    s = list(base)
    for i in rng.sample(range(len(s)), n):
        s[i] = rng.choice("ACDEFGHIKLMNPQRSTVWY")
    return "".join(s)


def test_clusters_match_a_global_greedy_run(spark):
    rng = random.Random(5)
    bases = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(80)) for _ in range(5)]
    seqs = {f"s{i}": mutated(rng.choice(bases), rng.randrange(14), rng) for i in range(60)} | {"e1": "", "e2": ""}
    got = cluster.cluster_frame(spark, seqs, k=4, threshold=0.4)
    ids = sorted(seqs)
    sets = [frozenset(seqs[i][j : j + 4] for j in range(len(seqs[i]) - 3)) for i in ids]
    want = greedy(ids, [len(seqs[i]) for i in ids], sets, 0.4)
    part = lambda labels: {frozenset(i for i in ids if labels[i] == x) for x in set(labels.values())}
    assert part(got) == part(dict(zip(ids, want)))
    assert sorted(set(got.values())) == list(range(len(set(want))))


def test_exact_and_identity_clusters(spark):
    seqs = {"b": "MK", "a": "MK", "c": "X"}
    assert cluster.cluster_frame(spark, seqs, method="exact") == {"a": 0, "b": 0, "c": 1}
    assert cluster.cluster_frame(spark, seqs, method="uniprot") == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError):
        cluster.cluster_frame(spark, seqs, method="other")


def test_similar_pairs_match_brute_force(spark):
    rng = random.Random(2)
    sets = {i: sorted(rng.sample(range(12), rng.randrange(1, 7))) for i in range(60)}
    rows = spark.createDataFrame(list(sets.items()), "id int, items array<int>")
    for t in (0.3, 0.5, 0.8, 1.0):
        want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= t}
        assert {(r["a"], r["b"]) for r in cluster.similar_pairs(rows, t).collect()} == want


def test_equal_sets_nulls_and_hot_items(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 16)  # so that items are cut into tiles
    rng = random.Random(3)
    sets = {i: sorted(rng.sample(range(1, 40), rng.randrange(0, 4))) + [0] for i in range(150)}
    sets |= {200 + i: [0, 1, 2] for i in range(30)} | {300: [], 301: [], 302: None}
    rows = spark.createDataFrame([(i, None if s is None else [*s, *s[:1], None]) for i, s in sets.items()], "id int, items array<int>")
    for t in (0.25, 0.6):
        some = {i: set(s) for i, s in sets.items() if s}
        want = {(a, b): len(some[a] & some[b]) / len(some[a] | some[b]) for a in some for b in some if a < b}
        got = {(r["a"], r["b"]): r["similarity"] for r in cluster.similar_pairs(rows, t).collect()}
        assert got == {p: s for p, s in want.items() if s >= t}
        members, pairs = cluster.class_pairs(rows.where("items IS NOT NULL"), t)
        of = {r["id"]: r["class"] for r in members.collect()}
        assert {i: of[i] for i in some} == {i: min(j for j in some if some[j] == some[i]) for i in some}
        assert {(r["a"], r["b"]) for r in pairs.collect()} == {p for p in got if of[p[0]] == p[0] and of[p[1]] == p[1] and some[p[0]] != some[p[1]]}


def test_an_item_of_every_set_spreads(spark):
    """Of an item that all sets have, no task gets more than twice the rows of the median one."""
    n = 20_000
    rows = spark.range(n).select(F.lit(7).alias("item"), "id")
    dealt = cluster._blocks(rows).repartition(8, "item", "_i", "_j").groupBy(F.spark_partition_id()).count().collect()
    each = sorted(r["count"] for r in dealt)
    assert len(each) == 8 and each[-1] <= 2 * each[4]
    tiles = -(-n // cluster.BLOCK)
    assert sum(each) == n * tiles


def independent(nodes, on):
    chosen = {}
    for i in nodes:
        chosen[i] = not any(chosen[j] for j in on.get(i, ()))
    return chosen


def test_rounds_equal_the_rule_on_a_thousand_graphs(spark):
    """All graphs are parts of one table, so that one run decides them."""
    rng = random.Random(6)
    nodes, edges = [], {}
    for g in range(1000):
        n, p = rng.randrange(1, 25), rng.choice([0.05, 0.15, 0.4, 0.9])
        ids = [1000 * g + i for i in range(n)]
        nodes += ids
        for a in range(n):
            for b in range(a):
                if rng.random() < p or (g % 10 == 0 and a - b == 1):
                    edges.setdefault(ids[a], []).append(ids[b])
    rows = spark.createDataFrame([(i,) for i in nodes], "id long")
    pairs = spark.createDataFrame([(a, b) for a, bs in edges.items() for b in bs], "id long, on long")
    got = {r["id"]: r["chosen"] for r in cluster.first_independent(rows, pairs).collect()}
    assert got == independent(nodes, edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    steps = []
    chased = cluster._chased
    monkeypatch.setattr(cluster, "_chased", lambda links: steps.append(1) or chased(links))
    n = 50_000
    nodes = spark.range(n, numPartitions=4)
    got = cluster.first_independent(nodes, nodes.where("id > 0").select("id", (F.col("id") - 1).alias("on")))
    assert got.groupBy((F.col("id") % 2).alias("odd"), "chosen").count().collect() and got.where("chosen = (id % 2 = 1)").isEmpty() and got.count() == n
    assert len(steps) <= 3


@pytest.mark.parametrize("seed", range(2))
def test_rounds_equal_the_greedy_rule_with_equal_sets(spark, seed):
    """Equal sets of different lengths, ties and chains of similar ones."""
    rng = random.Random(seed)
    items = [frozenset(rng.sample(range(12), rng.randrange(0, 6))) for _ in range(40)]
    rows = [(f"r{rng.randrange(10**6)}-{i}", rng.randrange(1, 6), rng.choice(items)) for i in range(150)]
    frame = spark.createDataFrame([(i, n, sorted(s)) for i, n, s in rows], "id string, length int, items array<int>")
    for t in (0.3, 0.5):
        want = greedy([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], t)
        got = {r["id"]: r["rep"] for r in cluster.greedy_clusters(frame, t).collect()}
        assert got == {rows[i][0]: rows[w][0] for i, w in enumerate(want)}


def test_no_group_of_python_is_a_component(spark):
    rows = spark.createDataFrame([("a", "MKLV"), ("b", "MKLVA")], "id string, sequence string")
    plan = cluster.cluster_sequences(rows)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "Python" not in plan


def shuffled_bytes(spark):
    """Bytes that stages shuffled and spilled so far, as the status store has them."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).diskBytesSpilled() for i in range(stages.size()))


def test_items_of_a_set_are_shuffled_once(spark):
    """Whole sets don't move: an item without a partner crosses the network once, with the id of its set."""
    n, each = 400, 500
    rows = spark.range(n, numPartitions=4).select("id", F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda i: F.xxhash64("id", i)).alias("items"))
    before = shuffled_bytes(spark)
    members, pairs = cluster.class_pairs(rows, 0.5)
    assert pairs.isEmpty() and members.where("id = class").count() == n
    assert shuffled_bytes(spark) - before < 20 * n * each


@pytest.mark.parametrize("few", [0, 100])
def test_sets_small_and_large_with_copies(spark, few, monkeypatch):
    """Pairs of sets around SMALL, of which some are told at once and others later, whether ids of classes are broadcast or joined."""
    monkeypatch.setattr(cluster, "BROADCAST_ROWS", few)
    monkeypatch.setattr(cluster, "SMALL", 6)
    rng = random.Random(8)
    sets = {i: set(rng.sample(range(i % 3 * 20, i % 3 * 20 + 14), rng.randrange(1, 13))) for i in range(80)}
    sets |= {100 + i: sets[i] for i in range(40)}
    rows = spark.createDataFrame([(i, [str(x) for x in s]) for i, s in sets.items()], "id long, items array<string>")
    for t in (0.4, 0.7):
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
        got = [(r["a"], r["b"], r["similarity"]) for r in cluster.similar_pairs(rows, t).collect()]
        assert len(got) == len({g[:2] for g in got}) and {(a, b): s for a, b, s in got} == {p: s for p, s in want.items() if s >= t}


def near_copies(spark, n, each):
    """Sets that all are alike: of each of ``n``, some 5 % of ``each`` items are missing."""
    items = F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda i: F.xxhash64(i))
    return spark.range(n, numPartitions=4).select("id", F.filter(items, lambda i: F.pmod(F.xxhash64("id", i), F.lit(20)) > 0).alias("items"))


def test_sets_of_many_pairs_are_not_moved_for_each_pair(spark):
    n, each = 300, 400
    rows = near_copies(spark, n, each)
    before = shuffled_bytes(spark)
    assert cluster.class_pairs(rows, 0.5)[1].count() == n * (n - 1) // 2
    assert shuffled_bytes(spark) - before < n * (n - 1) // 2 * each  # with a set of each pair: 8 times that and more


def test_near_copies_are_met_a_few_times(spark):
    """Not at each of the items that they share: of two blocks, few have the same pair."""
    ranked = cluster._ranked(near_copies(spark, 60, 200).withColumn("n", F.size("items")), 0.5)
    met = cluster._meetings(ranked, 0.5)
    assert met.select("a", "b").distinct().count() == 60 * 59 // 2 and met.count() < 2 * 60 * 59 // 2


@pytest.mark.parametrize("few", [0, 100])
def test_cells_of_few_sets(spark, few, monkeypatch):
    """Families of sets of more than SMALL items over many cells, with sets between families, whether homes are broadcast or joined."""
    for name, value in {"BROADCAST_ROWS": few, "SMALL": 3, "CELL": 4, "FEW": 1, "BEFORE": 2, "BLOCK": 8}.items():
        monkeypatch.setattr(cluster, name, value)
    rng = random.Random(9)
    sets = {i: set(rng.sample(range(i % 4 * 12, i % 4 * 12 + 20), rng.randrange(1, 19))) for i in range(120)}
    rows = spark.createDataFrame([(f"r{i}", [str(x) for x in s]) for i, s in sets.items()], "id string, items array<string>")
    for t in (0.4, 0.6):
        want = {tuple(sorted((f"r{a}", f"r{b}"))): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
        got = [(r["a"], r["b"], r["similarity"]) for r in cluster.similar_pairs(rows, t).collect()]
        assert len(got) == len({g[:2] for g in got}) and {(a, b): s for a, b, s in got} == {p: s for p, s in want.items() if s >= t}


def test_sets_go_to_their_cells_by_way_of_no_other_place(spark):
    """Items are shuffled to be counted, back to their set, and with it to a cell; ids and pairs are narrow."""
    n, each = 300, 400
    rows = near_copies(spark, n, each)
    before = shuffled_bytes(spark)
    assert cluster.class_pairs(rows, 0.5)[1].count() == n * (n - 1) // 2
    assert shuffled_bytes(spark) - before < 3.15 * 8 * n * each  # 3.39 with a join by id before the cells, 2.96 without


def test_cells_of_few_items(spark, monkeypatch):
    """Sets of many items are dealt to more cells than their number asks for, and no pair is lost or met twice."""
    monkeypatch.setattr(cluster, "CELL_ITEMS", 4000)
    n, each = 60, 400
    pairs = spark.range(n).select(F.col("id").alias("a")).crossJoin(spark.range(n).select(F.col("id").alias("b"))).where("a < b")
    dealt = cluster._cells(pairs.withColumns({"na": F.lit(each), "nb": F.lit(each)})).localCheckpoint()
    assert dealt.count() == dealt.select("a", "b").distinct().count() == n * (n - 1) // 2
    sets = dealt.select("home", "_i", "_j", F.explode(F.array("a", "b")).alias("id")).distinct().groupBy("home", "_i", "_j").count()
    assert sets.agg(F.max("count")).first()[0] < n / 2  # twice the ten sets that hold 4000 items, dealt by hash
    rows = near_copies(spark, n, each)
    assert cluster.class_pairs(rows, 0.5)[1].distinct().count() == n * (n - 1) // 2


def test_sizes_of_sets_whose_first_item_is_in_no_other(spark):
    rows = spark.createDataFrame([(1, [1, 5, 6, 7]), (2, [2, 5, 6, 7]), (3, [3]), (4, [7, 4]), (5, [])], "id int, items array<int>")
    got = {r["id"]: (r["n"], r["alone"], sorted(r["held"])) for r in cluster._ranked(rows.withColumn("n", F.size("items")), 0.5).collect()}
    assert got == {1: (4, 1, [5, 6, 7]), 2: (4, 1, [5, 6, 7]), 4: (2, 1, [7])}
