"""Helpers that keep one hot key from becoming one hot task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billmill.session import cut

HEAVY_ROWS = 1_000_000
PART_SIZE = 32 * 1024 * 1024
ROW_SIZE = 32


def with_lookup(df: DataFrame, side: DataFrame, key: str, side_key: str, how: str = "left"):
    """Attach a one-row-per-key side; no hint, so its measured size decides the strategy."""
    return df.join(side.withColumnRenamed(side_key, key), key, how)


def first_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    how_many: int = 1,
    rank: str | None = None,
) -> DataFrame:
    """The first rows of each key. The rank limit is pushed below the shuffle, so a map task
    sends at most `how_many` rows per key, however many the key has. `rank` keeps the rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= how_many)
    return ranked if rank else ranked.drop(name)


def spread(
    df: DataFrame, key: str, size: Column, of: DataFrame | None = None, part_size: int = PART_SIZE
) -> DataFrame:
    """Exchanged by key into parts of about `part_size` characters, counted first (one number; in
    `of`, if that holds the same rows and costs less). Parts are otherwise made by their bytes in
    the exchange, compressed: heavy reading after it ends in a few tasks, and rows that grow after
    it outgrow a task's memory, the more the larger the table is."""
    total = (df if of is None else of).agg(F.sum(size + ROW_SIZE)).first()[0] or 0
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-total // part_size))
    return df.repartition(parts, key)


def heavy_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys with more than `limit` rows; at most rows/limit of them, whatever the data."""
    return df.groupBy(*keys).count().filter(F.col("count") > limit).drop("count")


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """1-based position of each row in its key. `order` must be total within a key.

    Ordinary keys use a window. Rows of keys too large for one task are range-sorted over
    the cluster instead: the sorted rows are checkpointed, each partition's share of a key
    is counted, and a row's position is the rows of earlier partitions plus its own offset.
    """
    keys = list(keys)
    heavy = heavy_keys(df, keys, heavy_rows)
    found = heavy.collect()  # at most rows / heavy_rows keys
    window = Window.partitionBy(*keys).orderBy(*order)
    if not found:
        return df.withColumn(name, F.row_number().over(window))
    hot = F.broadcast(df.sparkSession.createDataFrame(found, heavy.schema))
    light = df.join(hot, keys, "left_anti").withColumn(name, F.row_number().over(window))

    parts = max(8, 2 * df.sparkSession.sparkContext.defaultParallelism)
    spread = df.join(hot, keys, "left_semi").repartitionByRange(parts, *keys, *order)
    sorted_rows = cut(
        spread.sortWithinPartitions(*keys, *order).withColumn(
            "_at", F.monotonically_increasing_id()
        )
    ).withColumn("_part", F.shiftright("_at", 33))
    shares = sorted_rows.groupBy(*keys, "_part").agg(
        F.min("_at").alias("_first"), F.count("*").alias("_rows")
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = shares.select(
        *keys, "_part", "_first", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )  # at most keys x partitions rows
    placed = sorted_rows.join(F.broadcast(starts), [*keys, "_part"])
    position = (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int")
    return light.unionByName(
        placed.withColumn(name, position).drop("_at", "_part", "_first", "_before")
    )
