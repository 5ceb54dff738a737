"""Shards of near equal bytes, tokens and rows, by vector packing of groups of equal texts."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billmill.llm.common import staged

MEASURES = ("size", "tokens", "rows")
LARGE_SHARE = 1 / 64  # of a shard: from here on a group is placed before all others
PIECES_PER_SHARD = 4  # of a group that no shard can hold
GROUPS_PER_CELL = 20_000
ROWS_PER_BUCKET = 50_000
PLACED = "key string, piece int, shard int"


def place(vectors: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The shard of each vector, in the order given. A vector goes where its dot product with
    the capacity left is highest (the first of equal ones); `capacity` (shards x measures) is
    used up in place. A shard may be overfilled; its capacity left is then negative."""
    shard = np.empty(len(vectors), np.int32)
    for i, vector in enumerate(vectors):
        shard[i] = best = int(np.argmax(capacity @ vector))
        capacity[best] -= vector
    return shard


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """One slim row per document: row_id, doc_id, key (of equal texts), size, tokens, text_crc32."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("none")).alias("key"),
        (F.octet_length(whole).cast("long") + 1).alias("size"),
        F.regexp_count(whole, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("tokens"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
    )


def assign(rows: DataFrame, shards: int = 16) -> DataFrame:
    """Adds `shard` to measured rows.

    Groups (equal key) are vectors of bytes, tokens and rows, each as a share of all. The at
    most 3 * shards / LARGE_SHARE groups that hold LARGE_SHARE of a shard in some measure go
    first, largest first, on the driver; one that exceeds a whole shard is dealt out in pieces
    by row. The others are dealt by hash into cells of about GROUPS_PER_CELL groups. Each cell
    has its part of what the large groups left of every shard, and places its own groups,
    largest first, so every group is placed by the rule, cells work in parallel, and a shard's
    total is the sum of even parts.
    """
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    groups = staged(groups, "shard-groups")
    total = groups.agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES), F.count("*").alias("groups")).first()
    whole = np.maximum(np.array([total[m] for m in MEASURES], float), 1.0)
    shares = [F.col(m) / F.lit(float(w)) for m, w in zip(MEASURES, whole, strict=True)]
    largest = F.greatest(*shares) * shards
    left = np.full((shards, len(MEASURES)), 1.0 / shards)

    pieces = [
        (key, piece, n, size / n, tokens / n, count / n)
        for key, size, tokens, count, n in groups.filter(largest >= LARGE_SHARE)
        .select("key", *MEASURES, F.when(largest > 1, F.ceil(largest * PIECES_PER_SHARD)).otherwise(1).alias("n"))
        .collect()
        for piece in range(n)
    ]
    pieces.sort(key=lambda p: (-max(np.array(p[3:]) / whole), p[0], p[1]))
    large_shards = place(np.array([p[3:] for p in pieces]).reshape(-1, len(MEASURES)) / whole, left)
    large = rows.sparkSession.createDataFrame(
        [(p[0], p[1], p[2], int(s)) for p, s in zip(pieces, large_shards, strict=True)],
        "key string, piece int, pieces int, shard int",
    )

    share = np.maximum(left, 0)
    share = share / np.maximum(share.sum(axis=0), 1e-12)
    cells = max(1, -(-total["groups"] // GROUPS_PER_CELL))

    def pack(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["size", "key"], ascending=[False, True])
        vectors = cell[list(MEASURES)].to_numpy(float) / whole
        chosen = place(vectors, share * vectors.sum(axis=0))
        return pd.DataFrame({"key": cell["key"], "piece": 0, "shard": chosen})

    small = (
        groups.filter(largest < LARGE_SHARE)
        .withColumn("cell", F.pmod(F.xxhash64("key"), F.lit(cells)))
        .groupBy("cell")
        .applyInPandas(pack, PLACED)
    )
    placed = large.select("key", "piece", "pieces", "shard").unionByName(
        small.select("key", "piece", F.lit(1).alias("pieces"), "shard")
    )
    counts = large.select("key", "pieces").filter("pieces > 1").distinct()
    return (
        rows.join(F.broadcast(counts), "key", "left")  # fewer than 3 * shards keys exceed a shard
        .withColumn("piece", F.pmod(F.xxhash64("row_id"), F.coalesce("pieces", F.lit(1))).cast("int"))
        .drop("pieces")
        .join(placed.drop("pieces"), ["key", "piece"])
        .drop("key", "piece")
    )


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard. Rows are numbered in buckets of about
    ROWS_PER_BUCKET rows; a bucket starts where the buckets before it end."""
    count = rows.count()
    buckets = max(1, -(-count // ROWS_PER_BUCKET))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row_id"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").count().select(
        "shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "row_id")
    return (
        rows.withColumn("n", F.row_number().over(inside))
        .join(starts, ["shard", "bucket"])
        .withColumn("slot", F.col("start") + F.col("n") - 1)
        .drop("bucket", "n", "start")
    )


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, shard and slot of every row.

    Equal texts stay together, unless they exceed a shard. A null text has size 1 and no
    tokens and its group is that of all nulls. A repeated row is placed again, a null doc_id
    is kept. An empty table gives no rows. Other columns are not read.
    """
    rows = staged(measured(docs), "shard-rows")
    placed = staged(assign(rows, shards), "shard-placed")
    return with_slots(placed).select("doc_id", "size", "text_crc32", "shard", "slot")
