"""Tables, written stages and block-wise reading shared by the operators of this folder."""

import pickle
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from billmill.session import staged  # noqa: F401

BLOCK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with new columns that are worked out once per row. The generator keeps the optimizer
    from moving them into what uses them, such as the loops of array functions."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


class Shared:
    """A value sent to all tasks with the code of its classes, so that executors need no copy of
    this package. The caller knows a bound for its size."""

    def __init__(self, spark: SparkSession, value: Any):
        self.packed, self.opened = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    @property
    def value(self) -> Any:
        if self.opened is None:
            self.opened = (pickle.loads(self.packed.value),)
        return self.opened[0]


def split_of(doc_id: Column, parts: int) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def text_blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `most` bytes, or one row where a row is
    longer, so that working arrays stay small whatever the batch holds."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


PARTS_OF_KEY = 64


def first_of_key(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key. Each key is ranked in parts first, so that however many rows
    or splits it has, no task ranks more than its part of them and then n rows of each part."""
    parted = rows.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(PARTS_OF_KEY)))
    for keys in ([key, "part"], [key]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        parted = parted.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")
    return parted.drop("part")
