import json
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from rxflow.sources import datasources, lookups


@pytest.fixture(scope="module")
def known(spark):
    datasources.register(spark)
    return spark


def fasta(path, n, seed=1):
    rng = random.Random(seed)
    out = ["text before the first header\n"] if seed % 2 else []
    for i in range(n):
        body = "".join(rng.choice("ACDEFGHIKL") for _ in range(rng.randrange(0, 200)))
        cut = rng.randrange(10, 70)
        out.append(f">sp|P{i}|name > of it {'x' * rng.randrange(40)}\n" + "\n".join(body[k : k + cut] for k in range(0, len(body), cut)) + ("\n\n" if i % 5 == 0 else "\n"))
    path.write_text("".join(out))
    return lookups.parse_fasta("".join(out))


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 10**9])
def test_every_record_is_read_once_however_files_are_split(tmp_path, split):
    want = fasta(tmp_path / "a.fasta", 12)
    size = (tmp_path / "a.fasta").stat().st_size
    got = [(a, s) for start in range(0, size, split) for a, s, _ in datasources.fasta_range(str(tmp_path / "a.fasta"), start, min(start + split, size))]
    assert got == list(want.items())


def test_a_large_file_is_read_by_many_tasks(known, tmp_path):
    want = fasta(tmp_path / "a.fasta", 3000) | {}
    more = fasta(tmp_path / "b.fasta", 50, seed=2)
    rows = known.read.format("fasta").option("splitBytes", 16_000).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() > 10
    got = {(r["file"].rsplit("/", 1)[-1], r["accession"]): r["sequence"] for r in rows.collect()}
    assert got == {("a.fasta", k): v for k, v in want.items()} | {("b.fasta", k): v for k, v in more.items()}
    spread = rows.groupBy(F.spark_partition_id()).count().count()
    assert spread > 10
    assert known.read.format("fasta").load(f"file://{tmp_path}/b.fasta").count() == 50


class Server:
    """A search of so many pages; counts what it was asked for."""

    def __init__(self):
        self.pages, self.asked = 3, []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
                outer.asked.append(int(q["page"]))
                items = [f"{q['organism']}-{q['page']}-{i}" for i in range(int(q["size"]))] + [{"b": 1, "a": int(q["page"])}]
                body = json.dumps({"pages": outer.pages, "items": items}).encode()
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.http.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.http.server_port}/search"


@pytest.fixture()
def server():
    made = Server()
    yield made
    made.http.shutdown()


def options(reader, server):
    return reader.format("paged").options(**{"url": server.url, "size": "2", "query.organism": "mouse", "pagesPerTask": "1"})


def test_a_search_as_a_table(known, server):
    rows = options(known.read, server).load()
    got = sorted((r["page"], r["place"], r["item"]) for r in rows.collect())
    assert got == [(p, k, item) for p in range(3) for k, item in enumerate([f"mouse-{p}-0", f"mouse-{p}-1", f'{{"a": {p}, "b": 1}}'])]
    assert rows.rdd.getNumPartitions() == 3


def test_a_stream_goes_on_where_it_stopped(known, server, tmp_path):
    def go():
        stream = options(known.readStream, server).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
        return sorted(r["page"] for r in known.read.parquet(str(tmp_path / "out")).where("place = 0").collect())

    assert go() == [0, 1, 2]
    server.pages, server.asked = 5, []
    assert go() == [0, 1, 2, 3, 4]
    assert set(server.asked) == {0, 3, 4}  # page 0 tells how many there are
