import base64
import datetime as dt
import hashlib
import random

import compare
from billmill.llm import queries, warc
from billmill.plans.registry import Named

TIME = dt.datetime(2020, 1, 1)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_query_against_sql(spark, sf_dir):
    name = "op3_warc_index_merge"
    problem, rows = compare.difference(Named(queries.QUERIES[name], queries.SQL[name]), spark, compare.duck(sf_dir), sf_dir)
    assert problem is None, problem
    assert rows > 0


def test_odd_rows(spark):
    long = "é\r\n\r\nWARC/1.0\r\n" * 20_000
    rows = [
        (5, "http://b.A.com:80/x?y#z", "one", TIME, "q"), (3, "http://b.a.com/x?y", "one", TIME, "q"),
        (None, None, None, TIME, "q"), (4, "a.com", "", TIME, "q"), (9, "x\r\ny", long, TIME, "q"),
        (9, "x\r\ny", long, TIME, "q"), (2, "http://b.a.com/x?y", "two", TIME + dt.timedelta(1), "q"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, captured timestamp, record_type string")
    got = sorted(warc.archive(pages, captures_per_range=2).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows)))
    keys = [(r.url_key, r.captured, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)
    assert {r.url_key for r in got} == {"", "com,a)/", "com,a,b)/x?y", "x%0d%0ay)/"}
    said = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    want = [
        (5, "one", "revisit", 3), (3, "one", "response", None), (-1, None, "revisit", 4), (4, "", "response", None),
        (9, long, "response", None), (9, long, "revisit", 9), (2, "two", "response", None),
    ]
    assert said == sorted((i, len((h or "").encode()), digest(h), kind, to) for i, h, kind, to in want)


def test_query_with_null_ids(spark, tmp_path):
    rows = [(2, "b.com/", "xy"), (None, "a.com/", "xy"), (None, None, None), (1, "b.com/", "xy")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["op3_warc_index_merge"](spark, str(tmp_path)).collect()
    said = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in got)
    assert said == [(0, 0, digest(""), "response", 0), (0, 2, digest("xy"), "revisit", 1), (1, 2, digest("xy"), "response", 0),
                    (2, 2, digest("xy"), "revisit", 1)]


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(i, "a.com/", "xy", TIME) for i in range(3)], "page_id long, url string, html string, captured timestamp")
    assert {r.record_type for r in warc.archive(pages, min_bytes=3).collect()} == {"response"}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string, captured timestamp")
    assert warc.archive(pages).collect() == []


def test_loser_tree_merges_any_runs():
    source = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted((source.randrange(50), i, n) for n in range(source.randrange(9))) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for run in runs for x in run)
