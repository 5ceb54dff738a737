"""The work queue as streams: ingest, duplicates, statuses, recovery, the daily cap.

Every job runs with trigger(availableNow) over a file source and a checkpoint folder, so it
picks up each new file once and can be run again at any time. Each micro-batch is written
under its own batch number and written over when it is repeated.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from billmill.functions import dates
from billmill.model import (
    LOCAL_ZONE,
    MAX_ATTEMPTS,
    RETRY_BACKOFF_SECONDS,
    STUCK_AFTER_SECONDS,
)


def read_files(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """A stream over parquet files; new files below the path are picked up by later runs."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str):
    """Process what there is, then stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def to_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch to its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch int").parquet(path)


SNAPSHOT_EVERY = 16


def _valid_snapshot(spark: SparkSession, path: str) -> int:
    """The number of the last whole snapshot; -1 before the first."""
    return spark.read.schema("snapshot int").parquet(f"{path}/valid").agg(F.max("snapshot")).first()[0]


def to_snapshots(path: str, schema: str, keys: list[str], every: int = SNAPSHOT_EVERY):
    """Writes each micro-batch of an update-mode result to its own folder. Every so many of
    them a snapshot is written of the last snapshot and the batches after it, and only then
    named as valid: readers and later snapshots read no batch that a valid one holds."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")
        if number == 0:
            spark.createDataFrame([(-1,)], "snapshot int").write.mode("append").parquet(f"{path}/valid")
        due = (number + 1) % every == 0
        if due and _valid_snapshot(spark, path) < number:  # a repeated batch has its snapshot already
            rows = latest(spark, path, schema, keys)
            rows.write.mode("overwrite").parquet(f"{path}/snapshots/{number}")
            named = spark.createDataFrame([(number,)], "snapshot int")
            named.write.mode("append").parquet(f"{path}/valid")

    return write


def latest(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """An update-mode result written by `to_snapshots`: each key's row from its latest
    micro-batch, read from the valid snapshot and the batches after it."""
    valid = _valid_snapshot(spark, path)
    rows = batches(spark, f"{path}/batches", schema).filter(F.col("batch") > valid)
    if valid >= 0:
        before = spark.read.schema(schema).parquet(f"{path}/snapshots/{valid}")
        rows = rows.unionByName(before.withColumn("batch", F.lit(valid)))
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"))
    return picked.select(*keys, "_row.*")


# --- ingest and duplicates ---------------------------------------------------------------------


def ingest(uploads: DataFrame, path: str, checkpoint: str):
    """Append each upload (id, sha256, size_bytes) once."""
    return run(uploads, to_batches(path), checkpoint, "append")


def recent_duplicates_dropped(uploads: DataFrame, time: str, delay: str) -> DataFrame:
    """One upload per hash while the watermark remembers it; state stays bounded."""
    return uploads.withWatermark(time, delay).dropDuplicatesWithinWatermark(["sha256"])


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_uploads(uploads: DataFrame) -> DataFrame:
    """The first upload of each hash for ever, as state kept by hash: its least row of the
    first micro-batch that has the hash. A hash met again is put out by no later one. Rows are
    reduced by hash before they are exchanged, so copies of one upload gather nowhere."""
    rest = [c for c in uploads.columns if c != "sha256"]
    seen = uploads.withColumn("_at", F.current_timestamp())  # one time for a whole micro-batch
    kept = seen.groupBy("sha256").agg(
        F.min(F.struct("_at", *rest)).alias("_row"), F.max("_at").alias("_last")
    )
    return kept.filter(F.col("_row._at") == F.col("_last")).select("sha256", "_row.*").drop("_at")


def ingest_unique(uploads: DataFrame, path: str, checkpoint: str):
    """Append one upload per hash for ever. The hashes known lie in a state store on disk, of
    which a micro-batch touches its own; nothing written is read back."""
    conf = uploads.sparkSession.conf
    before = conf.get(STATE_STORE)
    conf.set(STATE_STORE, ON_DISK)
    try:
        return run(first_uploads(uploads), to_batches(path), checkpoint, "update")
    finally:
        conf.set(STATE_STORE, before)


# --- statuses ------------------------------------------------------------------------------------


def latest_status(events: DataFrame) -> DataFrame:
    """Each file's latest status (events: file_id, event_id, status, ts)."""
    last = F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("last")
    return events.groupBy("file_id").agg(last).select("file_id", "last.status", "last.ts")


def status_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("status").agg(F.count("*").alias("events"))


def snapshot(path: str) -> Callable[[DataFrame, int], None]:
    """Complete-mode results are small; each one takes the place of the last."""

    def write(batch: DataFrame, number: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(path)

    return write


def used_per_local_day(approved: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Approved second reads per local day. The local day starts at 18:30 UTC of the day
    before. Rows later than the watermark are dropped and show in numRowsDroppedByWatermark."""
    window = F.window("ts", "1 day", "1 day", "18 hours 30 minutes")
    counts = approved.withWatermark("ts", delay).groupBy(window).agg(F.count("*").alias("used"))
    return counts.select(dates.local_day(F.col("window.start"), LOCAL_ZONE).alias("day"), "used")


# --- recovery ------------------------------------------------------------------------------------

STATE = "status string, at_ms bigint, attempts int"
STUCK = "file_id bigint, since timestamp"
DUE = "file_id bigint, attempts int, due timestamp"


def _last(chunks: Iterator[pd.DataFrame]) -> tuple[str, int] | None:
    """The latest event of a key's chunks: only one row is ever kept."""
    best = None
    for chunk in chunks:
        row = chunk.loc[chunk["ts"].idxmax()]
        at = int(row["ts"].timestamp() * 1000)
        if best is None or at >= best[1]:
            best = (row["status"], at)
    return best


def stuck_files(events: DataFrame, delay: str) -> DataFrame:
    """Files still processing when no event came for too long, by event time. Events may come
    late by `delay`; later ones are not seen."""
    wait = STUCK_AFTER_SECONDS * 1000

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, at, _ = state.get
            state.remove()
            yield pd.DataFrame({"file_id": [key[0]], "since": [pd.Timestamp(at, unit="ms")]})
            return
        last = _last(chunks)
        if last is None or (state.exists and state.get[1] > last[1]):
            return
        if last[0] != "processing":
            if state.exists:
                state.remove()
            return
        state.update((last[0], last[1], 0))
        state.setTimeoutTimestamp(max(last[1] + wait, state.getCurrentWatermarkMs() + 1))

    return (
        events.withWatermark("ts", delay)
        .groupBy("file_id")
        .applyInPandasWithState(step, STUCK, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


TRIES = "status string, at_ms bigint, ok_ms bigint, failed_ms array<bigint>"


def tried(chunks: Iterator[pd.DataFrame], status: str, at: int, ok: int, failed: list[int]) -> tuple[str, int, int, list[int]]:
    """A file's latest status and its time, its last success and its latest failures after new
    events, whose order doesn't matter. No more failures are kept than there are tries."""
    for chunk in chunks:
        times = chunk["ts"].astype("datetime64[ms]").astype("int64")
        latest = times[::-1].idxmax()  # of equal times, the last row
        if times[latest] >= at:
            status, at = chunk["status"][latest], int(times[latest])
        ok = max([ok, *times[chunk["status"] == "parsed"].nlargest(1).tolist()])
        recent = times[chunk["status"] == "failed"].nlargest(MAX_ATTEMPTS).tolist()
        failed = sorted([*failed, *recent])[-MAX_ATTEMPTS:]
    return status, at, ok, failed


def retries(events: DataFrame, delay: str) -> DataFrame:
    """Failed files due another try: after attempts x the back-off, at most three tries. A
    success starts the count again. Events may come late by `delay`."""
    pause = RETRY_BACKOFF_SECONDS * 1000

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, at, ok, failed = state.get
            attempts = sum(t > ok for t in failed)
            state.update(("queued", at, ok, failed))
            due = pd.Timestamp(at + attempts * pause, unit="ms")
            yield pd.DataFrame({"file_id": [key[0]], "attempts": [attempts], "due": [due]})
            return
        known = state.get if state.exists else ("", 0, -1, [])
        status, at, ok, failed = tried(chunks, *known)
        attempts = sum(t > ok for t in failed)
        state.update((status, at, ok, failed))
        if status == "failed" and attempts < MAX_ATTEMPTS:
            state.setTimeoutTimestamp(max(at + attempts * pause, state.getCurrentWatermarkMs() + 1))

    return (
        events.withWatermark("ts", delay)
        .groupBy("file_id")
        .applyInPandasWithState(step, DUE, TRIES, "append", GroupStateTimeout.EventTimeTimeout)
    )
