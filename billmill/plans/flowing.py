"""Named queries: the streaming jobs, run over what is there and read back."""

from pyspark.sql import functions as F

from billmill.plans.registry import query
from billmill.session import scratch_path
from billmill.streaming import jobs

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
STATUSES = {"view": "pending", "click": "processing", "signup": "parsed", "purchase": "resolved",
            "error": "failed"}
STATUS_SQL = """CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'parsed'
    WHEN 'purchase' THEN 'resolved' ELSE 'failed' END"""


def source(d: str, name: str) -> str:
    """The table's file, or its files when it is a folder."""
    return f"{d}/{name}.parquet*"


def events(spark, d):
    status = F.lit(None).cast("string")
    for kind, word in STATUSES.items():
        status = F.when(F.col("event_type") == kind, word).otherwise(status)
    stream = jobs.read_files(spark, source(d, "events"), EVENTS)
    return stream.select(
        F.col("user_id").alias("file_id"), "event_id", status.alias("status"), F.col("ts").cast("timestamp").alias("ts"))


def uploads(spark, d):
    stream = jobs.read_files(spark, source(d, "documents"), DOCUMENTS)
    return stream.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"),
                         F.octet_length("text").cast("bigint").alias("size_bytes"))


def places(spark, name):
    base = scratch_path(spark, name)
    return f"{base}/out", f"{base}/state"


@query("stm1_incremental_ingest", "SELECT doc_id AS id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents")
def _(spark, d):
    out, state = places(spark, "ingest")
    jobs.ingest(uploads(spark, d), out, state)
    jobs.ingest(uploads(spark, d), out, state)  # a second run finds nothing new
    return jobs.batches(spark, out, "id bigint, sha256 string, size_bytes bigint").drop("batch")


@query("stm2_unique_uploads", "SELECT min(doc_id) AS id, sha256(text) AS sha256 FROM documents GROUP BY 2")
def _(spark, d):
    out, state = places(spark, "unique")
    jobs.ingest_unique(uploads(spark, d), out, state)
    return jobs.batches(spark, out, "sha256 string, id bigint, size_bytes bigint").select("id", "sha256")


@query("stm2_unique_within_watermark", "SELECT DISTINCT sha256(user_id || event_type) AS sha256 FROM events")
def _(spark, d):
    out, state = places(spark, "recent")
    name = F.concat(F.col("file_id").cast("string"), "event_type")
    stream = jobs.read_files(spark, source(d, "events"), EVENTS).select(
        F.col("user_id").alias("file_id"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    sent = stream.select(F.sha2(name, 256).alias("sha256"), "ts")
    jobs.run(jobs.recent_duplicates_dropped(sent, "ts", "60 days"), jobs.to_batches(out), state, "append")
    return jobs.batches(spark, out, "sha256 string, ts timestamp").select("sha256")


@query("stm3_latest_status", f"""SELECT user_id AS file_id, max_by({STATUS_SQL}, (ts, event_id)) AS status, max(ts) AS ts
    FROM events GROUP BY 1""", model=False)
def _(spark, d):
    out, state = places(spark, "status")
    kept = "file_id bigint, status string, ts timestamp"
    jobs.run(jobs.latest_status(events(spark, d)), jobs.to_snapshots(out, kept, ["file_id"]), state, "update")
    return jobs.latest(spark, out, kept, ["file_id"])


@query("stm4_stuck_files", """SELECT user_id AS file_id, date_trunc('milliseconds', max(ts)) AS since FROM events
    GROUP BY 1 HAVING max_by(event_type, ts) = 'click'
      AND date_trunc('milliseconds', max(ts)) + INTERVAL 600 SECOND
        < (SELECT date_trunc('milliseconds', max(ts)) FROM events)""", model=False)
def _(spark, d):
    out, state = places(spark, "stuck")
    jobs.run(jobs.stuck_files(events(spark, d), "0 seconds"), jobs.to_batches(out), state, "append")
    return jobs.batches(spark, out, jobs.STUCK).drop("batch")


@query("stm5_retries", """SELECT file_id, CAST(attempts AS INT) AS attempts, since + to_seconds(CAST(attempts * 60 AS INT)) AS due FROM (
    SELECT e.user_id AS file_id, date_trunc('milliseconds', max(e.ts)) AS since, max_by(e.event_type, e.ts) AS kind,
      count(*) FILTER (e.event_type = 'error' AND (s.ts IS NULL OR e.ts > s.ts)) AS attempts
    FROM events e LEFT JOIN (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'signup' GROUP BY 1) s
      ON s.user_id = e.user_id GROUP BY 1)
    WHERE kind = 'error' AND attempts < 3 AND since + to_seconds(CAST(attempts * 60 AS INT))
      < (SELECT date_trunc('milliseconds', max(ts)) FROM events)""", model=False)
def _(spark, d):
    out, state = places(spark, "retries")
    jobs.run(jobs.retries(events(spark, d), "0 seconds"), jobs.to_batches(out), state, "append")
    return jobs.batches(spark, out, jobs.DUE).drop("batch")


@query("stm6_used_per_day", """SELECT CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, count(*) AS used FROM events
    WHERE event_type = 'purchase' GROUP BY 1""")
def _(spark, d):
    out, state = places(spark, "used")
    approved = events(spark, d).filter("status = 'resolved'")
    jobs.run(jobs.used_per_local_day(approved), jobs.to_snapshots(out, "day date, used bigint", ["day"]), state, "update")
    return jobs.latest(spark, out, "day date, used bigint", ["day"])


@query("stm7_status_counts", f"SELECT {STATUS_SQL} AS status, count(*) AS events FROM events GROUP BY 1", model=False)
def _(spark, d):
    out, state = places(spark, "counts")
    jobs.run(jobs.status_counts(events(spark, d)), jobs.snapshot(out), state, "complete")
    return spark.read.schema("status string, events bigint").parquet(out)
