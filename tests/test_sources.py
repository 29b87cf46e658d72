"""Count services, database files and pictures."""

import json
import threading
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plumbline.functions import pixels
from plumbline.operators import pictures
from plumbline.plans import source_queries
from plumbline.plans.tables import Tables
from plumbline.sources import counts, databases
from tests.conftest import SF


@pytest.fixture
def service():
    """Counts a term's letters; fails always for terms with an x, the first time for those with a y, and is no JSON for z."""
    asked = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            term = urllib.parse.unquote(self.path.removeprefix("/"))
            asked[term] += 1
            wrong = "x" in term or ("y" in term and asked[term] == 1)
            self.send_response(500 if wrong else 200)
            self.end_headers()
            self.wfile.write(b"nothing" if term == "z" else json.dumps({"result": {"count": str(len(term))}}).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/{{term}}", asked
    server.shutdown()


def test_counts_of_a_list(spark, service):
    url, asked = service
    options = {"url": url, "field": "result.count", "tries": 2, "pause": 0.01, "rate": 0}
    found = counts.counts_of(spark, ["abc", "x", "y/ y", "z", "é", "abc"], **options)
    assert found.rdd.getNumPartitions() == 5
    rows = found.collect()
    assert {(r.term, r.n, r.status) for r in rows} == {("abc", 3, "ok"), ("x", None, "http:500"), ("y/ y", 4, "ok"), ("z", None, "err:JSONDecodeError"), ("é", 1, "ok")}
    assert asked == {"abc": 1, "x": 2, "y/ y": 2, "z": 2, "é": 1}
    assert found.where("n > 3").count() == 1 and found.count() == 5 and counts.counts_of(spark, [], **options).isEmpty()
    assert counts.counts_of(spark, ["a"], url="http://127.0.0.1:9/{term}", tries=1, rate=0).first().status.startswith("err:")


def test_counts_of_a_table_of_terms(spark, service):
    url, asked = service
    words = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.explode(F.slice(F.split("text", r"\W+"), 1, 3)).alias("word")).where("word <> ''").where("doc_id < 40")
    found = counts.counted(words, "word", tasks=3, url=url, field="result.count", tries=2, pause=0.01, rate=0)
    joined = words.join(found, words.word == found.term).collect()
    assert found.count() == words.select("word").distinct().count() and len(joined) == words.count()
    assert all(r.n == len(r.word) if r.status == "ok" else r.n is None and ("x" in r.word or r.word == "z") for r in joined)
    assert all(n <= (2 if set("xyz") & set(t) else 1) for t, n in asked.items())


def test_requests_are_spaced(service):
    import time

    url, _ = service
    asker = counts.Asker(url, "result.count", rate=50)
    began = time.monotonic()
    assert [asker.count("a" * k) for k in range(1, 8)] == [(k, "ok") for k in range(1, 8)]
    assert time.monotonic() - began >= 6 / 50


def test_database_files(spark, tmp_path):
    folder = f"file://{tmp_path}/db"
    a = spark.createDataFrame([(k, f"n'{k}", k / 3 if k % 5 else None) for k in range(1000)] + [(None, "no key", 1.0)], "k long, name string, x double")
    b = spark.createDataFrame([(k % 700, k) for k in range(2000)], "k int, v int")
    databases.write_databases({"a": a, "b": b}, {"a": "k", "b": "k"}, folder, 3)
    databases.write_databases({"a": a, "b": b}, {"a": "k", "b": "k"}, folder, 3)  # a second run replaces the files
    rows = databases.database_rows(spark, folder, "SELECT * FROM a", "k", "k long, name string, x double", rows_apart=50)
    assert sorted(map(str, rows.collect())) == sorted(map(str, a.collect()))
    assert rows.rdd.getNumPartitions() >= 20  # ranges of the key, read by connections of their own
    where = [("k", ">=", 990), ("name", "in", ["n'991", "n'5", "n'999"]), ("x", ">", 0.5)]
    some = databases.database_rows(spark, folder, "SELECT * FROM a", "k", "k long, name string, x double", where)
    assert sorted(r.k for r in some.collect()) == [991, 999]
    assert rows.where("k > 900").count() == 99 and rows.count() == 1001
    joined = databases.database_rows(spark, folder, "SELECT a.k, name, v FROM a JOIN b USING (k)", "k", "k long, name string, v int", rows_apart=200)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, a.join(b, "k").select("k", "name", "v").collect()))
    with pytest.raises(ValueError, match="mounted"):
        databases.local_path("hdfs://x/y")


def test_conditions_are_the_databases():
    shape = StructType([StructField("k", LongType()), StructField("name", StringType())])
    options = {"query": "SELECT 1", "key": "k", "where": json.dumps([("name", "=", "a"), ("k", "in", [1, 2])])}
    reader = databases.DatabaseReader(options, shape)
    assert reader.statement(databases.Range("f", 5, 9)) == ('SELECT "k", "name" FROM (SELECT 1) WHERE "name" = ? AND "k" IN (?, ?) AND "k" >= ? AND "k" < ?', ["a", 1, 2, 5, 9])
    with pytest.raises(ValueError, match="condition"):
        databases.DatabaseReader(options | {"where": '[["other; --", "=", 1]]'}, shape)


def test_three_way_join_is_the_databases(spark):
    found = source_queries.s3(Tables(spark, SF))
    assert "databases" in found._jdf.queryExecution().executedPlan().toString() and found.count() > 0


# ---- pictures ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("samples", [1, 2, 3, 4])
def test_pictures_come_back_under_every_filter(samples):
    rng = np.random.default_rng(samples)
    for shape in ((1, 1), (7, 5), (16, 16)):
        picture = rng.integers(0, 256, (*shape, samples)).astype(np.uint8)
        found = pixels.decoded(pixels.encoded(picture, (0, 1, 2, 3, 4)))
        want = picture if samples > 2 else np.concatenate((np.repeat(picture[:, :, :1], 3, axis=2), picture[:, :, 1:]), axis=2)
        assert (found == want).all()


def test_statistics_of_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    pictures_ = {f"{k}.png": rng.integers(0, 256, (6 + k, 9, 3)).astype(np.uint8) for k in range(4)}
    for name, p in pictures_.items():
        (tmp_path / name).write_bytes(pixels.encoded(p, (4, 3, 1)))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    (tmp_path / "text.png").write_bytes(b"hello")
    (tmp_path / "cut.png").write_bytes(pixels.encoded(pictures_["0.png"])[:-30])
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/*.png").select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    out = {r.name: r for r in pictures.pixel_statistics(files, bins=4, grid=2).drop("content").collect()}
    assert {n: r.status for n, r in out.items() if r.status != "ok"}.keys() == {"bad.png", "text.png", "cut.png"} and out["text.png"].mean is None and out["cut.png"].width is None
    for name, p in pictures_.items():
        flat = p.reshape(-1, 3) / 255
        r = out[name]
        assert (r.height, r.width) == p.shape[:2] and r.mean == pytest.approx(flat.mean(0)) and r.deviation == pytest.approx(flat.std(0))
        assert r.quartiles == pytest.approx([np.percentile(flat[:, c], q) for c in range(3) for q in (25, 50, 75)])
        assert r.histogram == [int(((p[:, :, c] // 64) == k).sum()) for c in range(3) for k in range(4)]
        assert r.patches[:3] == pytest.approx(p[: -(-p.shape[0] // 2), :5].reshape(-1, 3).mean(0) / 255) and len(r.patches) == 12
