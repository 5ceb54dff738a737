"""Named queries: files, their counts, recovery, children, the attention report."""

from pyspark.sql import functions as F

from billmill.functions import dates
from billmill.operators import files as ops
from billmill.operators import registry as reg
from billmill.plans.registry import query
from billmill.sources import bindings as b

NOW = "TIMESTAMP '2001-08-01 00:00:00'"
OPEN = """(SELECT f.*, coalesce(o.n, 0) AS open_flags FROM files f LEFT JOIN
  (SELECT file_id, count(*) AS n FROM flags WHERE NOT resolved GROUP BY 1) o ON o.file_id = f.id)"""
ATTENTION = "(status IN ('needs_review', 'flagged') OR open_flags > 0)"


def flagged_files(spark, d):
    return ops.open_flags(b.files(spark, d), b.flags(spark, d))


@query("join6_open_flags", f"SELECT id, open_flags FROM {OPEN}")
def _(spark, d):
    return flagged_files(spark, d).select("id", "open_flags")


@query("agg8_open_flag_counts", """SELECT file_id, count(*) AS open_flags FROM flags
    WHERE NOT resolved GROUP BY 1""")
def _(spark, d):
    return b.flags(spark, d).filter("NOT resolved").groupBy("file_id").agg(
        F.count("*").alias("open_flags"))


@query("pre10_name_or_reference", """SELECT id, original_name, ref_no FROM files
    WHERE contains(lower(original_name), 'n_12') OR contains(lower(ref_no), 'n_12')""")
def _(spark, d):
    return b.files(spark, d).filter(ops.name_or_reference_contains("N_12")).select(
        "id", "original_name", "ref_no")


@query("pre11_attention", f"SELECT id, status, open_flags FROM {OPEN} WHERE {ATTENTION}")
def _(spark, d):
    return flagged_files(spark, d).filter(ops.needs_attention()).select(
        "id", "status", "open_flags")


@query("pre12_lookup_by_key", """
    WITH keys AS (SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR)
      WHEN event_id % 3 = 1 THEN 'REF-2001-' || lpad(CAST(event_id AS VARCHAR), 6, '0')
      ELSE 'file ' || event_id END AS key FROM events)
    SELECT k.key, f.id FROM keys k JOIN files f
      ON k.key = CAST(f.id AS VARCHAR) OR k.key = f.ref_no""")
def _(spark, d):
    n = F.col("event_id")
    key = (F.when(n % 3 == 0, n.cast("string"))
           .when(n % 3 == 1, F.concat(F.lit("REF-2001-"), F.lpad(n.cast("string"), 6, "0")))
           .otherwise(F.concat(F.lit("file "), n.cast("string"))))
    keys = b.table(spark, d, "events").select(key.alias("key")).distinct()
    return ops.lookup(b.files(spark, d), keys).select("key", "id")


@query("pre17_due_for_work", f"""SELECT id, status, attempts FROM files
    WHERE (status = 'pending' AND status_changed_at < {NOW} - INTERVAL 30 SECOND)
       OR (status = 'failed' AND attempts < 3
           AND status_changed_at < {NOW} - to_seconds(attempts * 60))""")
def _(spark, d):
    return ops.due(b.files(spark, d), b.now()).select("id", "status", "attempts")


@query("pre18_reset_stuck", f"""SELECT id,
    CASE WHEN stuck THEN 'pending' ELSE status END AS status,
    CASE WHEN stuck THEN {NOW} ELSE status_changed_at END AS status_changed_at
    FROM (SELECT *, status = 'processing' AND status_changed_at < {NOW} - INTERVAL 600 SECOND
          AS stuck FROM files)""")
def _(spark, d):
    return ops.reset_stuck(b.files(spark, d), b.now()).select("id", "status", "status_changed_at")


@query("pre19_unfinished_second_reads", f"""SELECT id, file_id FROM runs
    WHERE parser = 'ai' AND finished_at IS NULL AND created_at < {NOW} - INTERVAL 600 SECOND""")
def _(spark, d):
    return ops.unfinished_second_reads(b.runs(spark, d), b.now()).select("id", "file_id")


@query("pre20_second_read_eligible",
       "SELECT id FROM files WHERE status IN ('needs_review', 'flagged', 'parsed')")
def _(spark, d):
    return ops.second_read_eligible(b.files(spark, d)).select("id")


@query("sort4_newest_files", """SELECT id, ref_no, (SELECT count(*) FROM files
      WHERE status = 'parsed') AS matches FROM files
    WHERE status = 'parsed' ORDER BY id DESC LIMIT 40 OFFSET 40""")
def _(spark, d):
    found = b.files(spark, d).filter("status = 'parsed'")
    matches = F.lit(found.count()).cast("bigint").alias("matches")
    return ops.newest_page(found, 2, 40).select("id", "ref_no", matches)


@query("join8_copies_with_originals", """SELECT f.id, f.duplicate_of_id, o.ref_no AS copy_of
    FROM files f LEFT JOIN files o ON o.id = f.duplicate_of_id""")
def _(spark, d):
    f = b.files(spark, d)
    return ops.with_originals(f, f).select("id", "duplicate_of_id", "copy_of")


@query("agg2_status_counts", """SELECT s.status, count(f.id) AS files FROM
    (SELECT unnest(['pending','processing','parsed','needs_review','ai_processing','flagged',
      'resolved','rejected','failed']) AS status) s LEFT JOIN files f USING (status) GROUP BY 1""")
def _(spark, d):
    return ops.status_counts(b.files(spark, d))


@query("agg3_summary_counts", f"""SELECT count(*) AS total,
    count(*) FILTER (status = 'parsed' AND open_flags > 0) AS with_warnings,
    count(*) FILTER ({ATTENTION}) AS needs_attention FROM {OPEN}""")
def _(spark, d):
    return ops.summary(flagged_files(spark, d))


@query("agg4_card_count", """SELECT count(*) AS files FROM files
    WHERE status IN ('pending', 'processing', 'ai_processing')""")
def _(spark, d):
    return ops.count_of(b.files(spark, d), "pending", "processing", "ai_processing")


@query("job16_file_list", f"""SELECT id, ref_no, original_name, status, open_flags FROM {OPEN}
    WHERE {ATTENTION} AND contains(lower(original_name), '.pdf')
    ORDER BY id DESC LIMIT 50""")
def _(spark, d):
    found = ops.find(flagged_files(spark, d), None, ".pdf", True)
    return ops.newest_page(found, 1, 50).select(
        "id", "ref_no", "original_name", "status", "open_flags")


def details(spark, d):
    return ops.detail(b.files(spark, d), b.receipts(spark, d), b.vendors(spark, d),
                      b.line_items(spark, d), b.flags(spark, d), b.runs(spark, d))


DETAIL = """SELECT f.id, r.receipts, r.first_vendor, r.items, g.flags, n.newest_run FROM files f
  LEFT JOIN (SELECT file_id, count(*) AS receipts, min_by(raw_name, seq) AS first_vendor,
      CAST(coalesce(sum(items), 0) AS BIGINT) AS items
    FROM receipts x LEFT JOIN vendors v ON v.id = x.vendor_id
    LEFT JOIN (SELECT receipt_id, count(*) AS items FROM line_items GROUP BY 1) i
      ON i.receipt_id = x.id GROUP BY 1) r ON r.file_id = f.id
  LEFT JOIN (SELECT file_id, string_agg(id, ',' ORDER BY resolved, id) AS flags
    FROM flags GROUP BY 1) g ON g.file_id = f.id
  LEFT JOIN (SELECT file_id, max(id) AS newest_run FROM runs GROUP BY 1) n ON n.file_id = f.id"""


def flat(detail):
    items = F.aggregate("receipts", F.lit(0).cast("bigint"),
                        lambda n, r: n + F.coalesce(F.size(r["line_items"]), F.lit(0)))
    return detail.select(
        "id",
        F.size("receipts").cast("bigint").alias("receipts"),
        F.element_at("receipts", 1)["vendor"].alias("first_vendor"),
        items.alias("items"),
        F.when(F.col("flags").isNotNull(), F.concat_ws(",", F.transform(
            "flags", lambda x: x["id"].cast("string")))).alias("flags"),
        F.element_at("runs", 1)["id"].alias("newest_run"),
    )


@query("join12_file_with_children", DETAIL)
def _(spark, d):
    return flat(details(spark, d))


@query("sort6_children_in_order", """SELECT file_id AS id,
      string_agg(id, ',' ORDER BY resolved, id) AS flags FROM flags GROUP BY 1""")
def _(spark, d):
    packed = ops.children(b.flags(spark, d), "file_id",
                          [F.col("resolved").cast("int"), F.col("id")], "flags", ["id"])
    return packed.select(F.col("file_id").alias("id"), F.concat_ws(
        ",", F.transform("flags", lambda x: x["id"].cast("string"))).alias("flags"))


@query("src16_attention_report", f"""SELECT * FROM ({DETAIL}) WHERE id IN (
    SELECT id FROM {OPEN} WHERE {ATTENTION} ORDER BY id LIMIT 200)""")
def _(spark, d):
    report = ops.attention_report(
        b.files(spark, d), b.receipts(spark, d), b.vendors(spark, d), b.line_items(spark, d),
        b.flags(spark, d), b.runs(spark, d))
    return flat(report)


@query("agg20_files_per_batch", """SELECT batch_id, count(*) AS files,
    string_agg(id, ',' ORDER BY id) AS ids FROM files GROUP BY 1""")
def _(spark, d):
    packed = ops.children(b.files(spark, d), "batch_id", [F.col("id")], "files", ["id"])
    return packed.select(
        "batch_id", F.size("files").cast("bigint").alias("files"),
        F.concat_ws(",", F.transform("files", lambda x: x["id"].cast("string"))).alias("ids"))


@query("agg11_batch_fill", """SELECT batch_id, count(*) AS files, count(*) >= 50 AS "full"
    FROM files GROUP BY 1""")
def _(spark, d):
    return reg.batch_fill(b.files(spark, d))


@query("job11_reject_files", f"""
    WITH asked AS (SELECT id FROM files WHERE id % 6 = 0
      AND status NOT IN ('processing', 'ai_processing'))
    SELECT f.id, CASE WHEN a.id IS NULL THEN f.status ELSE 'rejected' END AS status,
      CASE WHEN a.id IS NULL THEN f.error ELSE 'Rejected: a bad scan' END AS error,
      CASE WHEN a.id IS NULL THEN f.status_changed_at ELSE {NOW} END AS status_changed_at,
      coalesce(o.open_flags, 0) AS open_flags
    FROM files f LEFT JOIN asked a ON a.id = f.id
    LEFT JOIN (SELECT file_id, count(*) AS open_flags FROM flags WHERE NOT resolved
      AND file_id NOT IN (SELECT id FROM asked) GROUP BY 1) o ON o.file_id = f.id""")
def _(spark, d):
    f = b.files(spark, d)
    asked = f.filter("id % 6 = 0").select(
        "id", F.lit("a  bad scan ").alias("reason"), F.lit("ravi").alias("person"))
    updated, flags = ops.reject(f, b.flags(spark, d), asked, b.now())
    return ops.open_flags(updated, flags).select(
        "id", "status", "error", "status_changed_at", "open_flags")


@query("job11_resolve_flags", f"""SELECT id, resolved OR id % 5 = 0 AS resolved,
    CASE WHEN NOT resolved AND id % 5 = 0 THEN 'ravi' ELSE resolved_by END AS resolved_by,
    CASE WHEN NOT resolved AND id % 5 = 0 THEN {NOW} ELSE resolved_at END AS resolved_at
    FROM flags""")
def _(spark, d):
    flags = b.flags(spark, d)
    asked = flags.filter("id % 5 = 0").select("id", F.lit("ravi").alias("person"))
    return ops.resolve(flags, asked, "id", b.now()).select(
        "id", "resolved", "resolved_by", "resolved_at")


@query("dat10_local_days", """SELECT event_id,
    CAST(ts + INTERVAL 330 MINUTE AS DATE) AS local_day,
    CAST(CAST(ts + INTERVAL 330 MINUTE AS DATE) AS TIMESTAMP) - INTERVAL 330 MINUTE
      AS day_starts_at FROM events""")
def _(spark, d):
    moment = F.col("ts").cast("timestamp")
    day = dates.local_day(moment, "Asia/Kolkata")
    return b.table(spark, d, "events").select(
        "event_id", day.alias("local_day"),
        dates.local_day_start(day, "Asia/Kolkata").alias("day_starts_at"))
