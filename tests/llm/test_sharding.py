from collections import Counter, defaultdict
import zlib

import numpy as np
import pytest

from billmill.llm import queries, sharding


def check(rows, texts, shards, equal=0.15):
    assert len(rows) == len(texts)
    slots, bytes_of = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        bytes_of[r.shard] += r.size
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    assert set(slots) <= set(range(shards))
    fair = sum(bytes_of.values()) / shards
    if equal:
        assert max(abs(bytes_of[s] - fair) for s in range(shards)) <= equal * fair + 1


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_shards_by_vector_packing"](spark, sf_dir).collect()
    check(rows, docs, 16, equal=0.25)
    homes = defaultdict(set)
    for r in rows:
        text = docs[r.doc_id]
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())
        homes[text].add(r.shard)
    assert all(len(s) == 1 for s in homes.values())


def test_many_rows_all_measures(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "repeat('ab c ', cast(1 + id * 7919 % 300 AS int)) || id AS text")
    rows = sharding.measured(docs)
    placed = sharding.assign(rows, 8).groupBy("shard").sum("size", "tokens").collect()
    assert len(placed) == 8
    for k in (1, 2):
        totals = np.array([r[k] for r in placed])
        assert totals.max() < 1.02 * totals.mean()


def test_hot_group_is_split(spark):
    rows = [(i, "copy " * 30, 1) for i in range(1000)] + [(1000 + i, f"other {i} " * 12, 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shard_documents(docs, 4).collect()
    check(got, rows, 4, equal=0.1)


def test_odd_rows(spark):
    rows = [(1, None, 5), (None, "a", 5), (2, "", 5), (2, "", 5), (3, "x" * 50_000, 5), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    got = sharding.shard_documents(docs, 4).collect()
    check(got, rows, 4, equal=0)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got)[(1, 1, 0)] == 1


@pytest.mark.parametrize("schema", ["doc_id long, text string"])
def test_empty(spark, schema):
    assert sharding.shard_documents(spark.createDataFrame([], schema)).collect() == []


def test_place_takes_the_highest_dot_product():
    capacity = np.array([[1.0, 0.2], [0.5, 1.0]])
    assert sharding.place(np.array([[0.3, 0.0], [0.0, 0.3], [0.3, 0.0]]), capacity).tolist() == [0, 1, 0]
