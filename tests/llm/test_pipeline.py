import __spark_entry__ as entry
import corpus_pipeline as pipeline
import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rxflow.llm import catalog, common, ngram_join, packing, personal, quality, toxicity, vocab
from rxflow.llm.common import stored, table
from tests.llm.test_similarity import brute


def test_stages_match_their_operators(spark, sf):
    docs = table(spark, sf, "documents")
    n = docs.count()
    kept = []
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, before, sf))
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            scored = toxicity.score(before, toxicity.fit(before, table(spark, sf, "labels")))
            assert docs.count() == scored.where("predicted = 0").count()
        elif name == "quality_rules":
            want = {r["doc_id"] for r in before.collect() if quality.kept(quality.measure(r["text"] or ""))}
            assert {r["doc_id"] for r in docs.collect()} == want
        elif name == "ngram_join":
            rows = sorted(before.select("doc_id", "text").collect())
            got = {rows[c]["doc_id"] for _, c in brute([r["text"] for r in rows])}
            assert {r["doc_id"] for r in docs.collect()} == got
        elif name == "personal_data":
            new = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
            assert new == {r["doc_id"]: (personal.masked(r["text"]), len(personal.masked(r["text"]))) for r in before.collect()}
        else:
            ids = vocab.words_of(vocab.vocab_file("byte_bpe_50k.json"))
            want = {r["doc_id"]: len(ids.encode(r["text"])) + 1 for r in before.collect()}
            assert {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want
        kept.append(docs.select("doc_id").distinct().count())
    assert n > kept[0] > kept[1] > kept[2] == kept[3] == kept[4] > n // 2


def test_run(spark, sf):
    assert pipeline.run(spark, sf).columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_queries_return_their_contract(spark, sf, name):
    columns = {
        "op1": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op2": "query_id rank vec_id score",
        "op3": "doc_id held_out score predicted",
        "op4": "page_id url text n_chars",
        "op5": "doc_id start n_tokens ids_crc32",
        "op6": "page_id host path rule verdict",
        "op7": "doc_id n_shingles component_id",
        "op8": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op9": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op10": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
        "op11": "lang rank phrase a l r n score",
        "op12": "doc_id leaf subroot root proof_sha256 folded_root verified",
        "op13": "vec_id n_links component_id kept",
    }[name.split("_")[0]].split()
    assert entry.queries()[name](spark, sf).columns[: len(columns)] == columns


def test_packing_is_dense(spark, sf):
    rows = packing.query(spark, sf)
    used = rows.agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert used["n"] > 0.97 * packing.SIZE * used["s"]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_match_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf)
    names = sorted(df.columns)
    found = con.execute(f"SELECT {', '.join(names)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(names).collect())) == sorted(found) and found


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    """Documents with nulls, empty and long texts, copies, repeated rows and columns named like those of the stages."""
    word = lambda i, k: f"w{(i * 7919 + k * 104729) % 9973}"
    prose = [" ".join(word(i, k) for k in range(80)) for i in range(6)]
    texts = [None, "", " \n", prose[0], prose[0], prose[1] + " mail a.b@c.de now", prose[2], prose[2] + " end", " ".join(f"v{k}" for k in range(20_000)), prose[3], "short"]
    rows = [(i, t, None if i % 3 else "en", 1.0, 7, None) for i, t in enumerate(texts)] + [(3, prose[0], "en", 1.0, 7, None), (None, prose[4], None, None, None, None)]
    path = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, predicted int, `odd name` string")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, None, 0) for i in range(11)] + [(None, 1, 1), (4, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_on_odd_rows(spark, odd_folder):
    docs = table(spark, odd_folder, "documents")
    columns = docs.columns
    out = {}
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, odd_folder))
        out[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = lambda name: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out[name])
    assert len(out["toxicity"]) == 13 and {r["predicted"] for r in out["toxicity"]} == {7, None}  # labels of one class teach nothing
    assert ids("quality_rules") == [(False, i) for i in (3, 3, 4, 5, 6, 7, 8, 9)] + [(True, 0)]
    assert ids("ngram_join") == [(False, i) for i in (3, 5, 6, 8, 9)] + [(True, 0)]
    assert next(r["text"] for r in out["personal_data"] if r["doc_id"] == 5).endswith("mail [EMAIL] now")
    assert {r["doc_id"] for r in out["packing"]} == {3, 5, 6, 8, 9, None} and sum(r["doc_id"] == 8 for r in out["packing"]) > 10


def test_stages_on_empty_tables(spark, odd_folder):
    docs = table(spark, odd_folder, "documents").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, odd_folder))
        assert docs.count() == 0


@pytest.fixture(scope="module")
def clashing(spark, sf, tmp_path_factory):
    """The tables of the folder with more columns, named like those that operators make."""
    path = tmp_path_factory.mktemp("clash")
    names = "ids low host path codes frame n key part hash word node tree pos batch items bad mined score predicted held_out tied hashes root v w h verdict rule spans kept links".split()
    for name in ("documents", "embeddings", "pages", "labels"):
        df = table(spark, sf, name)
        df.withColumns({c: F.lit("clash") for c in names if c not in df.columns}).write.parquet(f"{path}/{name}.parquet")
    return str(path)


#: The others have such columns in tests of their own.
@pytest.mark.parametrize("name", ["op1_byte_bpe", "op2_neighbours", "op4_html_main_text", "op5_binary_records", "op6_url_filter"])
def test_clashing_columns_change_nothing(spark, sf, clashing, name):
    query = catalog.queries()[name]
    rows = lambda folder: sorted(map(str, query(spark, folder).collect()))
    assert rows(clashing) == rows(sf)


def test_stages_without_tables_clear_those_of_others():
    """A worker that goes on to another stage holds nothing that the one before it remembered."""
    common.hold("toxicity", toxicity._scorers.clear)
    toxicity._scorers["a model"] = object()
    quality.measure("a text")
    assert not toxicity._scorers
    ngram_join.shingles("some words of a text")
    assert ngram_join._hashes
    personal.masked("a text")
    assert not ngram_join._hashes
    ngram_join.shingles("some words of a text")
    quality.measure("a text")
    assert not ngram_join._hashes
    common.hold("toxicity", toxicity._scorers.clear)
    toxicity._scorers["a model"] = object()
    ngram_join._shared(pa.table({"batch": [0], "docs": [b"\0\0\0\0"], "hashes": [b"12345"], "about": [b"x"]}))
    assert not toxicity._scorers
