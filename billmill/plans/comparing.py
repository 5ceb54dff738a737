"""Named queries: readers compared, second reads, corrections, learned labels, kept results."""

from pyspark.sql import functions as F

from billmill.functions import labels, money, text
from billmill.operators import checks, compare, learning
from billmill.operators import registry as reg
from billmill.plans.registry import query
from billmill.sources import bindings as b
from billmill.sources import results, sinks

NOW = "TIMESTAMP '2001-08-01 00:00:00'"


def sides(spark, d):
    rows = b.run_receipts(spark, d)
    library = rows.filter("parser = 'pdf_text'").drop("parser")
    # Some files have one receipt less in the second read.
    second = rows.filter("parser = 'ai' AND id % 40 <> 21").drop("parser")
    return library, second


SECOND = "(SELECT * FROM second_receipts WHERE id % 40 <> 21)"
PAIRS = f"""(SELECT l.file_id, l.seq, l.vendor, l.receipt_date, l.total, s.vendor AS vendor2,
    s.receipt_date AS receipt_date2, s.total AS total2, n.n AS of FROM library_receipts l
  JOIN (SELECT file_id, count(*) AS n FROM library_receipts GROUP BY 1) m ON m.file_id = l.file_id
  JOIN (SELECT file_id, count(*) AS n FROM {SECOND} GROUP BY 1) n ON n.file_id = l.file_id AND n.n = m.n
  JOIN {SECOND} s ON s.file_id = l.file_id AND s.seq = l.seq)"""
DIFFS = f"""(SELECT file_id, seq, pos, field, library, second, of FROM (
    SELECT file_id, seq, 0 AS pos, 'vendor' AS field, vendor AS library, vendor2 AS second, of FROM {PAIRS}
      WHERE lower(vendor) <> lower(vendor2)
    UNION ALL SELECT file_id, seq, 1, 'date', CAST(receipt_date AS VARCHAR), CAST(receipt_date2 AS VARCHAR), of
      FROM {PAIRS} WHERE receipt_date <> receipt_date2
    UNION ALL SELECT file_id, seq, 2, 'total', CAST(total AS VARCHAR), CAST(total2 AS VARCHAR), of
      FROM {PAIRS} WHERE total <> total2
    UNION ALL SELECT m.file_id, 0, -1, 'receipts', CAST(m.n AS VARCHAR), CAST(coalesce(n.n, 0) AS VARCHAR),
      coalesce(n.n, 0) FROM (SELECT file_id, count(*) AS n FROM library_receipts GROUP BY 1) m
      LEFT JOIN (SELECT file_id, count(*) AS n FROM {SECOND} GROUP BY 1) n ON n.file_id = m.file_id
      WHERE m.n <> coalesce(n.n, 0)))"""
DIFF_TEXT = f"""(SELECT file_id, string_agg(CASE WHEN of > 1 AND pos >= 0 THEN 'receipt ' || seq || ': '
    ELSE '' END || CASE WHEN pos < 0 THEN 'the number of receipts' ELSE field END || ' (library '
    || library || ', AI ' || second || ')', '; ' ORDER BY seq, pos) AS differences
  FROM {DIFFS} GROUP BY 1)"""


@query("job13_disagreements", f"SELECT file_id, seq, field, library, second FROM {DIFFS}")
def _(spark, d):
    return compare.disagreements(*sides(spark, d)).select("file_id", "seq", "field", "library", "second")


@query("job13_disagreements_as_text", f"SELECT * FROM {DIFF_TEXT}")
def _(spark, d):
    return compare.as_text(compare.disagreements(*sides(spark, d)))


@query("job13_screen_differences", f"""SELECT l.file_id, l.seq, f.field,
      CASE f.field WHEN 'vendor' THEN l.vendor ELSE CAST(l.total AS VARCHAR) END AS library,
      CASE f.field WHEN 'vendor' THEN s.vendor ELSE CAST(s.total AS VARCHAR) END AS second
    FROM library_receipts l JOIN {SECOND} s ON s.id = l.id, (VALUES ('vendor'), ('total')) AS f(field)
    WHERE CASE f.field WHEN 'vendor' THEN l.vendor <> s.vendor ELSE l.total <> s.total END""")
def _(spark, d):
    return compare.form_differences(*sides(spark, d))


@query("join10_zip_by_position", f"""SELECT coalesce(l.file_id, s.file_id) AS file_id,
      coalesce(l.seq, s.seq) AS seq, l.total AS library_total, s.total AS second_total
    FROM (SELECT * FROM library_receipts WHERE id % 50 <> 3) l
    FULL JOIN {SECOND} s ON s.file_id = l.file_id AND s.seq = l.seq""")
def _(spark, d):
    library, second = sides(spark, d)
    pairs = compare.zipped(library.filter("id % 50 <> 3"), second, ["total"])
    return pairs.select("file_id", "seq", F.col("library.total").alias("library_total"),
                        F.col("second.total").alias("second_total"))


@query("str16_same_text", """SELECT l.id, lower(l.vendor) = lower(s.vendor) AS same
    FROM library_receipts l JOIN second_receipts s ON s.id = l.id""")
def _(spark, d):
    rows = b.run_receipts(spark, d)
    one = rows.filter("parser = 'pdf_text'").select("id", F.concat(F.lit(" "), "vendor").alias("a"))
    two = rows.filter("parser = 'ai'").select("id", F.replace("vendor", F.lit(" "), F.lit("  ")).alias("c"))
    return one.join(two, "id").select("id", text.same_text(F.col("a"), F.col("c")).alias("same"))


@query("con3_second_read_decision", f"""
    SELECT r.file_id, r.id AS run_id,
      CASE WHEN r.error IS NOT NULL OR p.problem IS NOT NULL THEN 'failed'
        WHEN t.differences IS NOT NULL THEN 'conflict' ELSE 'parsed' END AS outcome,
      CASE WHEN r.error IS NOT NULL OR p.problem IS NOT NULL OR t.differences IS NOT NULL THEN 'flagged'
        ELSE 'parsed' END AS status,
      CASE WHEN r.error IS NOT NULL THEN 'Reader could not read this file: ' || r.error
        WHEN p.problem IS NOT NULL THEN 'Reader''s result also failed the checks: ' || p.problem
        WHEN t.differences IS NOT NULL THEN 'The library and Reader disagree on ' || t.differences || '.'
        END AS detail
    FROM (SELECT * FROM runs WHERE parser = 'ai') r
    LEFT JOIN (SELECT f.id AS file_id, CASE WHEN count(s.id) = 0 THEN 'No receipt could be found in this file.'
        ELSE string_agg(CASE WHEN s.receipt_date IS NULL THEN CASE WHEN n > 1 THEN 'Receipt ' || rn ELSE 'The receipt' END
          || ' is missing its date.' END, ' ' ORDER BY s.seq) END AS problem
      FROM files f LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY file_id) AS n,
          row_number() OVER (PARTITION BY file_id ORDER BY seq) AS rn FROM {SECOND}) s ON s.file_id = f.id
      GROUP BY 1) p ON p.file_id = r.file_id
    LEFT JOIN {DIFF_TEXT} t ON t.file_id = r.file_id""")
def _(spark, d):
    library, second = sides(spark, d)
    reads = b.runs(spark, d).filter("parser = 'ai'").select(
        "file_id", F.col("id").alias("run_id"), F.lit("Reader").alias("label"), "error")
    passed = checks.acceptance(b.files(spark, d).select("id", "kind"),
                               second.withColumn("confidence", F.lit(0.9)), F.lit(0.0))
    differences = compare.as_text(compare.disagreements(library, second))
    return compare.decide_second_read(reads, passed, differences).select(
        "file_id", "run_id", "outcome", "status", "detail")


GOOD = "parser = 'ai' AND error IS NULL AND has_result AND finished_at IS NOT NULL"


@query("join9_cached_reads", f"""SELECT r.id, r.file_id, max(c.id) AS cached_id
    FROM runs r JOIN (SELECT * FROM runs WHERE {GOOD}) c ON c.sha256 = r.sha256
      AND c.provider = r.provider AND c.model = r.model AND c.id <> r.id
    WHERE r.parser = 'ai' GROUP BY 1, 2""")
def _(spark, d):
    # Reads of copies have other providers; count by file number alone to have hits.
    runs = b.runs(spark, d)
    return compare.cached_reads(runs)


@query("win12_latest_read", f"""SELECT sha256, model, max(id) AS id FROM runs WHERE {GOOD}
    GROUP BY 1, 2""")
def _(spark, d):
    good = b.runs(spark, d).filter(GOOD)
    from billmill.operators.skew import first_per_key

    return first_per_key(good.select("sha256", "model", "id"), ["sha256", "model"], [F.col("id").desc()])


@query("join20_latest_library_run", """SELECT file_id, max(id) AS run_id FROM runs
    WHERE parser NOT IN ('ai', 'manual') AND has_result GROUP BY 1""")
def _(spark, d):
    return compare.latest_library_run(b.runs(spark, d))


@query("win15_accepted_run", """SELECT id, file_id, accepted AND id = max(id) FILTER (accepted)
    OVER (PARTITION BY file_id) AS accepted FROM (SELECT id, file_id, id % 5 <> 0 AS accepted FROM runs)""")
def _(spark, d):
    runs = b.runs(spark, d).select("id", "file_id", (F.col("id") % 5 != 0).alias("accepted"))
    return compare.accepted_runs(runs).select("id", "file_id", "accepted")


@query("pre22_unapproved_reads", """SELECT id FROM runs WHERE NOT (parser = 'ai' AND provider IS NOT NULL
    AND coalesce(model, '') <> '' AND coalesce(ai_approved_by, '') <> '' AND ai_approved_at IS NOT NULL)""")
def _(spark, d):
    return compare.unapproved(b.runs(spark, d)).select("id")


USED = """(SELECT CAST(ai_approved_at + INTERVAL 330 MINUTE AS DATE) AS day, count(*) AS used FROM runs
    WHERE parser = 'ai' AND cached_from_id IS NULL AND ai_approved_at IS NOT NULL GROUP BY 1)"""


@query("agg9_used_per_day", f"SELECT day, used FROM {USED}")
def _(spark, d):
    return compare.used_per_day(b.runs(spark, d))


@query("agg10_admitted_batches", f"""WITH RECURSIVE asked AS (SELECT CAST(uploaded_at AS DATE) AS day, id % 4 AS batch_id,
      count(*) AS asked, min(uploaded_at) AS asked_at FROM files GROUP BY 1, 2),
    turns AS (SELECT a.*, row_number() OVER (PARTITION BY a.day ORDER BY asked_at, batch_id) AS turn,
      CAST(greatest(5 - coalesce(u.used, 0), 0) AS BIGINT) AS start FROM asked a LEFT JOIN {USED} u ON u.day = a.day),
    said AS (SELECT day, batch_id, asked, turn, start AS remaining FROM turns WHERE turn = 1
      UNION ALL SELECT t.day, t.batch_id, t.asked, t.turn, CASE WHEN s.asked <= s.remaining THEN s.remaining - s.asked
        ELSE s.remaining END FROM said s JOIN turns t ON t.day = s.day AND t.turn = s.turn + 1)
    SELECT day, batch_id, asked, remaining, asked <= remaining AS admitted FROM said""")
def _(spark, d):
    asked = b.files(spark, d).select(
        F.to_date("uploaded_at").alias("day"), (F.col("id") % 4).alias("batch_id"), F.col("id").alias("file_id"),
        F.col("uploaded_at").alias("at"))
    return compare.admit_batches(asked, compare.used_per_day(b.runs(spark, d)), 5)


@query("agg12_least_confidence", "SELECT run_id, min(confidence) AS confidence FROM receipts GROUP BY 1")
def _(spark, d):
    return compare.least_confidence(b.receipts(spark, d)).select(
        "run_id", F.col("confidence").alias("confidence"))


@query("join21_best_values", """
    WITH stored AS (SELECT file_id, seq, total FROM receipts WHERE file_id % 3 = 0),
    read AS (SELECT file_id, seq, total, file_id * 2 AS run_id FROM library_receipts WHERE file_id % 3 = 1
      UNION ALL SELECT file_id, seq, total, file_id * 2 + 1 FROM second_receipts WHERE file_id % 6 = 1)
    SELECT file_id, seq, total, 'stored' AS origin FROM stored UNION ALL
    SELECT file_id, seq, total, 'read' FROM read r WHERE run_id = (SELECT max(run_id) FROM read x WHERE x.file_id = r.file_id)
    UNION ALL SELECT id, 1, NULL, 'blank' FROM files WHERE id % 3 = 2""")
def _(spark, d):
    stored = b.receipts(spark, d).filter("file_id % 3 = 0").select("file_id", "seq", "total")
    rows = b.run_receipts(spark, d).filter(
        "(parser = 'pdf_text' AND file_id % 3 = 1) OR (parser = 'ai' AND file_id % 6 = 1)")
    run = F.col("file_id") * 2 + F.when(F.col("parser") == "ai", 1).otherwise(0)
    read = rows.select("file_id", "seq", "total", run.alias("run_id"))
    return compare.best_values(b.files(spark, d), stored, read)


def corrections(spark, d):
    fixed = b.receipts(spark, d).filter("file_id % 9 = 4")
    return fixed.withColumns({
        "total": (F.col("total") + 1).cast("decimal(12,2)"), "confidence": F.lit(None).cast("double"),
        "run_id": F.col("file_id") * 2 + 1_000_000_000})


@query("job10_corrected_receipts", """SELECT id, file_id, run_id, total, confidence FROM receipts WHERE file_id % 9 <> 4
    UNION ALL SELECT id, file_id, file_id * 2 + 1000000000, CAST(total + 1 AS DECIMAL(12,2)), NULL FROM receipts
    WHERE file_id % 9 = 4""")
def _(spark, d):
    return compare.overlay(b.receipts(spark, d), corrections(spark, d)).select(
        "id", "file_id", "run_id", "total", "confidence")


@query("job10_corrected_runs", f"""SELECT id, file_id, parser, accepted AND file_id % 9 <> 4 AS accepted FROM runs
    UNION ALL SELECT id * 2 + 1000000000, id, 'manual', true FROM files WHERE id % 9 = 4""")
def _(spark, d):
    return compare.overlay_runs(b.runs(spark, d), corrections(spark, d), b.now()).select(
        "id", "file_id", "parser", "accepted")


# A person's corrections of one change: every ninth file, some of them busy, some with a receipt in
# an unknown category.
EDITS = """(SELECT * REPLACE (CAST(total + CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END AS DECIMAL(12,2)) AS total,
    CASE WHEN id % 29 = 0 THEN 99 ELSE category_override_id END AS category_override_id)
    FROM receipts_with_copies WHERE file_id % 9 = 4)"""
REFUSED = f"""(SELECT e.file_id, CASE WHEN any_value(f.status) IS NULL THEN 'unknown_file'
      WHEN any_value(f.status) IN ('processing', 'ai_processing') THEN 'busy'
      WHEN count(*) FILTER (e.category_override_id = 99) > 0 THEN 'unknown_category' END AS reason
    FROM {EDITS} e LEFT JOIN files f ON f.id = e.file_id GROUP BY 1)"""
TAKEN = f"(SELECT * FROM {EDITS} WHERE file_id IN (SELECT file_id FROM {REFUSED} WHERE reason IS NULL))"
AFTER = f"""(SELECT * FROM receipts_with_copies WHERE file_id NOT IN (SELECT file_id FROM {TAKEN})
    UNION ALL SELECT * FROM {TAKEN})"""


def edits(spark, d):
    rows = b.receipts_with_copies(spark, d).filter("file_id % 9 = 4")
    raised = F.col("total") + F.when(F.col("id") % 2 == 0, 2).otherwise(0)
    category = F.when(F.col("id") % 29 == 0, 99).otherwise(F.col("category_override_id"))
    return rows.withColumns({
        "total": raised.cast("decimal(12,2)"), "category_override_id": category.cast("bigint"),
        "run_id": F.col("file_id") * 2 + 1_000_000_000})


def corrected(spark, d):
    vendors = b.vendors(spark, d).select(
        F.col("id").alias("vendor_id"), F.col("raw_name").alias("vendor"), "normalized_name")

    def named(receipts, files):
        status = files.select(F.col("id").alias("file_id"), "status")
        no_items = {"items_total": F.lit(None).cast("decimal(14,2)"), "items": F.lit(0).cast("bigint")}
        return receipts.withColumns(no_items).join(vendors, "vendor_id").join(status, "file_id")

    tables = {
        "receipts": b.receipts_with_copies(spark, d), "runs": b.runs(spark, d), "flags": b.flags(spark, d),
        "files": b.files(spark, d), "categories": b.categories(spark, d)}
    return compare.correct(edits(spark, d), tables, named, user="asha", now=b.now(), today=b.today())


@query("job10_refused_corrections", f"SELECT file_id, reason FROM {REFUSED} WHERE reason IS NOT NULL")
def _(spark, d):
    return corrected(spark, d)["refused"]


@query("job10_receipts_after_corrections", f"SELECT id, file_id, total, category_override_id FROM {AFTER}")
def _(spark, d):
    return corrected(spark, d)["receipts"].select("id", "file_id", "total", "category_override_id")


@query("job10_runs_after_corrections", f"""SELECT id, file_id, parser, accepted
      AND file_id NOT IN (SELECT file_id FROM {TAKEN}) AS accepted FROM runs
    UNION ALL SELECT DISTINCT file_id * 2 + 1000000000, file_id, 'manual', true FROM {TAKEN}""")
def _(spark, d):
    return corrected(spark, d)["runs"].select("id", "file_id", "parser", "accepted")


@query("job10_files_after_corrections", f"""SELECT id, CASE WHEN id IN (SELECT file_id FROM {TAKEN}) THEN 'resolved'
      ELSE status END AS status, CASE WHEN id NOT IN (SELECT file_id FROM {TAKEN}) THEN error END AS error,
    CASE WHEN id IN (SELECT file_id FROM {TAKEN}) THEN {NOW} ELSE status_changed_at END AS status_changed_at
    FROM files""")
def _(spark, d):
    return corrected(spark, d)["files"].select("id", "status", "error", "status_changed_at")


@query("job10_flags_after_corrections", f"""
    WITH named AS (SELECT r.*, v.raw_name, lower(v.normalized_name) AS known,
        CASE WHEN r.file_id IN (SELECT file_id FROM {TAKEN}) THEN 'resolved' ELSE f.status END AS status
      FROM {AFTER} r JOIN vendors v ON v.id = r.vendor_id JOIN files f ON f.id = r.file_id),
    mine AS (SELECT * FROM named WHERE file_id IN (SELECT file_id FROM {TAKEN})),
    found AS (SELECT file_id, seq, 'arithmetic_mismatch' AS type, 'subtotal+tax' AS key FROM mine
        WHERE abs(subtotal + tax - total) > 1
      UNION ALL SELECT file_id, seq, 'validation_failed', 'date' FROM mine
        WHERE receipt_date > DATE '2001-08-01' OR receipt_date < DATE '2000-04-01'
      UNION ALL SELECT a.file_id, a.seq, 'duplicate_receipt', 'duplicate-of:' || min_by(b.ref_no, b.id)
        FROM mine a JOIN named b ON b.known = lower(a.raw_name) AND b.total = a.total AND b.file_id <> a.file_id
          AND b.status IN ('parsed', 'resolved') AND CASE WHEN a.receipt_number IS NOT NULL
            THEN b.receipt_number = a.receipt_number ELSE b.receipt_date = a.receipt_date END
        GROUP BY a.file_id, a.seq, a.id)
    SELECT id, file_id, type, dedupe_key, resolved OR file_id IN (SELECT file_id FROM {TAKEN}) AS resolved,
      CASE WHEN NOT resolved AND file_id IN (SELECT file_id FROM {TAKEN}) THEN 'asha' ELSE resolved_by END AS resolved_by
    FROM flags UNION ALL
    SELECT NULL, file_id, type, file_id || ':' || seq || ':' || key, true, 'asha' FROM found""")
def _(spark, d):
    return corrected(spark, d)["flags"].select("id", "file_id", "type", "dedupe_key", "resolved", "resolved_by")


EXPECTED = "(SELECT * FROM library_receipts WHERE file_id % 5 < 3)"
SCORES = f"""(SELECT file_id, field, 1 AS compared, CASE WHEN same THEN 1 ELSE 0 END AS matched FROM (
    SELECT e.file_id, f.field, CASE f.field WHEN 'vendor' THEN lower(e.vendor) = lower(s.vendor)
        WHEN 'receipt_number' THEN e.receipt_number = s.receipt_number
        WHEN 'receipt_date' THEN e.receipt_date = s.receipt_date WHEN 'subtotal' THEN e.subtotal = s.subtotal
        WHEN 'tax' THEN e.tax = s.tax ELSE e.total = s.total END AS same
    FROM {EXPECTED} e LEFT JOIN {SECOND} s ON s.file_id = e.file_id AND s.seq = e.seq,
      (VALUES ('vendor'), ('receipt_number'), ('receipt_date'), ('subtotal'), ('tax'), ('total')) AS f(field)
    WHERE CASE f.field WHEN 'receipt_number' THEN e.receipt_number IS NOT NULL
      WHEN 'subtotal' THEN e.subtotal IS NOT NULL WHEN 'tax' THEN e.tax IS NOT NULL ELSE true END))"""


def scores(spark, d):
    library, second = sides(spark, d)
    return compare.scored(library.filter("file_id % 5 < 3"), second)


@query("join11_expected_and_read", f"SELECT file_id, field, CAST(sum(compared) AS BIGINT) AS compared, CAST(sum(matched) AS BIGINT) AS matched FROM {SCORES} GROUP BY 1, 2")
def _(spark, d):
    return compare.accuracy(scores(spark, d), "file_id", "field").drop("accuracy")


@query("agg16_field_accuracy", f"""SELECT field, CAST(sum(compared) AS BIGINT) AS compared, CAST(sum(matched) AS BIGINT) AS matched,
    round(sum(matched) / sum(compared), 4) AS accuracy FROM {SCORES} GROUP BY 1""")
def _(spark, d):
    return compare.accuracy(scores(spark, d), "field")


@query("job14_reader_benchmark", f"""SELECT file_id, CAST(sum(compared) AS BIGINT) AS compared, CAST(sum(matched) AS BIGINT) AS matched,
    round(sum(matched) / sum(compared), 4) AS accuracy FROM {SCORES} GROUP BY 1""")
def _(spark, d):
    return compare.accuracy(scores(spark, d), "file_id")


@query("agg16_status_accuracy", """SELECT count(*) AS files, count(*) FILTER (status = CASE WHEN id % 10 = 0
    THEN 'flagged' ELSE 'parsed' END) AS as_expected FROM files""")
def _(spark, d):
    rows = b.files(spark, d).select("status", F.when(F.col("id") % 10 == 0, "flagged").otherwise("parsed").alias("expected"))
    return compare.status_accuracy(rows)


REGRESSED = f"""(SELECT e.file_id, e.seq, f.field, CASE f.field WHEN 'receipt_date' THEN CAST(e.receipt_date AS VARCHAR)
      ELSE CAST(e.total AS VARCHAR) END AS expected, CASE f.field WHEN 'receipt_date' THEN CAST(s.receipt_date AS VARCHAR)
      ELSE CAST(s.total AS VARCHAR) END AS read
    FROM {EXPECTED} e JOIN {SECOND} s ON s.file_id = e.file_id AND s.seq = e.seq, (VALUES ('receipt_date'), ('total')) AS f(field)
    WHERE CASE f.field WHEN 'receipt_date' THEN s.receipt_date IS NULL ELSE s.total <> e.total END
    UNION ALL SELECT e.file_id, 0, 'receipts', CAST(e.n AS VARCHAR), CAST(coalesce(s.n, 0) AS VARCHAR) FROM
      (SELECT file_id, count(*) AS n FROM {EXPECTED} GROUP BY 1) e LEFT JOIN
      (SELECT file_id, count(*) AS n FROM {SECOND} GROUP BY 1) s ON s.file_id = e.file_id WHERE e.n <> coalesce(s.n, 0))"""


def regressed(spark, d):
    library, second = sides(spark, d)
    expected = library.filter("file_id % 5 < 3").withColumn("receipt_number", F.concat(F.lit(" "), "receipt_number"))
    return expected, compare.regressions(expected, second)


@query("job15_regressions", f"SELECT * FROM {REGRESSED}")
def _(spark, d):
    return regressed(spark, d)[1]


@query("agg17_files_right_and_wrong", f"""SELECT count(*) FILTER (b.file_id IS NULL) AS "right", count(b.file_id) AS wrong
    FROM (SELECT DISTINCT file_id FROM {EXPECTED}) e LEFT JOIN (SELECT DISTINCT file_id FROM {REGRESSED}) b ON b.file_id = e.file_id""")
def _(spark, d):
    return compare.right_and_wrong(*regressed(spark, d))


# --- kept results ------------------------------------------------------------------------------


def packed(spark, d):
    """Receipts of a file as an array, as a run keeps them."""
    rows = b.run_receipts(spark, d).filter("parser = 'pdf_text'").withColumns({
        "line_items": F.array(F.struct(
            F.lit("Goods").alias("description"), F.lit(2).cast("decimal(12,3)").alias("quantity"),
            F.lit(None).cast("decimal(14,4)").alias("unit_price"), F.col("total").alias("amount"))),
        "confidence": F.lit(0.85), "source": F.lit("page 1")})
    one = F.struct("seq", "vendor", "receipt_number", "receipt_date", "subtotal", "tax", "total",
                   "line_items", "confidence", "source")
    return rows.groupBy("file_id").agg(F.array_sort(F.collect_list(one)).alias("receipts"))


def kept_json(spark, d):
    return packed(spark, d).select("file_id", sinks.result_json(F.col("receipts")).alias("result_json"))


@query("src8_result_json", """SELECT file_id, json_array_length(j) AS receipts, j->0->>'total' AS first_total,
    j->0->>'receipt_date' AS first_date, j->0->'line_items'->0->>'amount' AS first_amount FROM (
    SELECT file_id, to_json(list({'total': CAST(total AS VARCHAR), 'receipt_date': CAST(receipt_date AS VARCHAR),
      'line_items': [{'amount': CAST(total AS VARCHAR)}]} ORDER BY seq)) AS j FROM library_receipts GROUP BY 1)""")
def _(spark, d):
    j = F.col("result_json")
    return kept_json(spark, d).select(
        "file_id", F.json_array_length(j).cast("bigint").alias("receipts"),
        F.get_json_object(j, "$[0].total").alias("first_total"),
        F.get_json_object(j, "$[0].receipt_date").alias("first_date"),
        F.get_json_object(j, "$[0].line_items[0].amount").alias("first_amount"))


@query("src9_tolerant_result_read", """SELECT file_id, CASE WHEN file_id % 7 = 0 THEN NULL ELSE count(*) END AS receipts,
    CASE WHEN file_id % 7 <> 0 THEN CAST(sum(total) AS DECIMAL(18,2)) END AS total FROM library_receipts GROUP BY 1""")
def _(spark, d):
    spoiled = F.when(F.col("file_id") % 14 == 0, F.lit('{"old": 1}')).when(
        F.col("file_id") % 7 == 0, F.replace("result_json", F.lit('"receipt_date":"'), F.lit('"receipt_date":"x')))
    rows = kept_json(spark, d).withColumn("result_json", F.coalesce(spoiled, "result_json"))
    read = results.read_results(rows)
    total = F.aggregate("result", F.lit(0).cast("decimal(18,2)"), lambda a, r: (a + r["total"]).cast("decimal(18,2)"))
    size = F.when(F.col("result").isNotNull(), F.size("result").cast("bigint"))
    return read.select("file_id", size.alias("receipts"), total.alias("total"))


@query("src10_answers_to_receipts", """SELECT r.id, v.raw_name AS vendor, 'A-' || r.id AS receipt_number, r.receipt_date, r.total,
    1 AS items, r.total AS amount FROM receipts r JOIN vendors v ON v.id = r.vendor_id""")
def _(spark, d):
    v = b.printed_vendors(spark, d).select(F.col("id").alias("vendor_id"), "printed")
    rows = b.receipts(spark, d).join(v, "vendor_id")
    item = lambda name, amount: F.struct(name.alias("description"), F.lit("2 kg").alias("quantity"),
                                         F.lit(None).cast("string").alias("unit_price"), amount.alias("amount"))
    total = F.concat(F.lit("Rs. "), F.format_number("total", 2))
    answer = F.to_json(F.struct(F.array(F.struct(
        F.col("printed").alias("vendor"), F.concat(F.lit("#A-"), F.col("id").cast("string")).alias("receipt_number"),
        F.date_format("receipt_date", "d MMM yyyy").alias("receipt_date"), total.alias("total"),
        F.array(item(F.lit("Goods"), total), item(F.lit(" "), total), item(F.lit("Bag"), F.lit("free"))).alias("line_items"),
    )).alias("receipts")))
    read = results.to_receipts(rows.select("id", answer.alias("answer")))
    return read.select("id", F.explode("receipts").alias("r")).select(
        "id", "r.vendor", "r.receipt_number", "r.receipt_date", "r.total",
        F.size("r.line_items").alias("items"), F.get("r.line_items", F.lit(0))["amount"].alias("amount"))


@query("src11_confirmed_answers", """SELECT 'REF-2001-' || lpad(CAST(file_id AS VARCHAR), 6, '0') || '__Scan_' || file_id || '.pdf' AS name,
    row_number() OVER (PARTITION BY file_id ORDER BY seq) AS seq, vendor, receipt_number, receipt_date, subtotal, tax, total
    FROM library_receipts""")
def _(spark, d):
    kept = sinks.confirmed_answers(named_answers(spark, d))
    as_map = kept.select(F.to_json(F.create_map("name", "answers"), {"ignoreNullFields": "false"}).alias("value"))
    return results.read_answers(as_map).withColumn("seq", F.col("seq").cast("bigint"))


def named_answers(spark, d):
    rows = b.run_receipts(spark, d).filter("parser = 'pdf_text'")
    return rows.withColumns({
        "ref_no": b.file_ref(F.col("file_id")),
        "original_name": F.concat(F.lit("in/Scan_"), F.col("file_id").cast("string"), F.lit(".pdf"))})


@query("src12_answers_written", """SELECT 'REF-2001-' || lpad(CAST(file_id AS VARCHAR), 6, '0') || '__Scan_' || file_id || '.pdf' AS name,
    count(*) AS answers, min_by(CAST(total AS VARCHAR), seq) AS first_total,
    min_by(CAST(receipt_date AS VARCHAR), seq) AS first_date FROM library_receipts GROUP BY file_id""")
def _(spark, d):
    first = F.get("answers", F.lit(0))
    return sinks.confirmed_answers(named_answers(spark, d)).select(
        "name", F.size("answers").cast("bigint").alias("answers"), first["total"].alias("first_total"),
        first["receipt_date"].alias("first_date"))


# --- learned labels -----------------------------------------------------------------------------

LABELS = """(SELECT *, CAST(length(label) AS INT) AS times_used FROM vendor_labels)"""


def known_labels(spark, d):
    return b.vendor_labels(spark, d).withColumn("times_used", F.length("label"))


@query("agg7_shared_labels", """SELECT field, label, count(DISTINCT vendor_key) AS vendors FROM vendor_labels
    GROUP BY 1, 2 HAVING count(DISTINCT vendor_key) >= 3""")
def _(spark, d):
    return learning.shared_labels(known_labels(spark, d))


@query("join16_vendor_keys", """SELECT p.id, coalesce(lower(k.name), lower(trim(p.printed, ' :,-|*'))) AS vendor_key
    FROM printed_vendors p LEFT JOIN (SELECT lower(raw_name) AS folded, min_by(normalized_name, id) AS name
      FROM vendors WHERE id % 100 < 60 GROUP BY 1) k ON k.folded = lower(trim(p.printed, ' :,-|*'))""")
def _(spark, d):
    some = b.vendors(spark, d).filter("id % 100 < 60")
    return reg.vendor_key(b.printed_vendors(spark, d), "printed", some).select("id", "vendor_key")


@query("join15_labels_of_vendors", """SELECT r.id, l.field, l.label FROM receipts r JOIN vendors v ON v.id = r.vendor_id
    JOIN vendor_labels l ON l.vendor_key = lower(v.normalized_name)""")
def _(spark, d):
    v = b.printed_vendors(spark, d).select(F.col("id").alias("vendor_id"), "printed")
    keyed = reg.vendor_key(b.receipts(spark, d).select("id", "vendor_id").join(v, "vendor_id"), "printed",
                           b.vendors(spark, d))
    return keyed.join(known_labels(spark, d), "vendor_key").select("id", "field", "label")


@query("set1_own_and_shared_labels", """SELECT field, label, length(label) AS size FROM (
    SELECT field, label FROM vendor_labels WHERE vendor_key LIKE '%1' UNION
    SELECT field, label FROM vendor_labels GROUP BY 1, 2 HAVING count(DISTINCT vendor_key) >= 3)""")
def _(spark, d):
    known = known_labels(spark, d)
    own = known.filter("vendor_key LIKE '%1'").select("field", "label")
    both = own.union(learning.shared_labels(known).select("field", "label")).distinct()
    return both.withColumn("size", F.length("label").cast("bigint")).orderBy(F.col("size").desc(), "label")


def bills(spark, d):
    """Receipts with gaps and the text they were read from."""
    v = b.printed_vendors(spark, d).select(F.col("id").alias("vendor_id"), text.clean_vendor(F.col("printed")).alias("vendor"))
    n = F.col("vendor_id")
    word = F.element_at(F.array(F.lit("Before GST"), F.lit("Levy"), F.lit("To settle")), (n % 3 + 1).cast("int"))
    rows = b.receipts(spark, d).join(v, "vendor_id")
    line = F.concat(F.lit("Hello\n"), word, F.lit(" "), b.label_number(n).cast("string"), F.lit(": Rs. "), F.col("total").cast("string"),
                    F.lit("\nTotally 9.00"))
    return rows.select(
        "id", "file_id", "vendor_id", "vendor", "receipt_date", "receipt_number",
        F.lit(None).cast("decimal(12,2)").alias("subtotal"),
        F.when(F.col("id") % 2 == 0, F.lit("1.00").cast("decimal(12,2)")).alias("tax"),
        F.when(F.col("id") % 5 == 0, F.lit("2.00").cast("decimal(12,2)")).alias("total"),
        F.lit(0).alias("items"), F.lit(0.5).alias("confidence"), line.alias("text"), F.col("total").alias("printed"))


USABLE = """(SELECT r.id, r.total AS printed, r.vendor_id, lower(v.normalized_name) AS vendor_key,
    ['subtotal','tax','total'][CAST(r.vendor_id % 3 + 1 AS INT)] AS field,
    ['before gst','levy','to settle'][CAST(r.vendor_id % 3 + 1 AS INT)] || ' '
      || (CASE WHEN r.vendor_id % 3 = 0 THEN r.vendor_id % 20 ELSE r.vendor_id % 10 END) AS label
  FROM receipts r JOIN vendors v ON v.id = r.vendor_id)"""
FILLED = f"""(SELECT * FROM {USABLE} u WHERE (field = 'subtotal' OR (field = 'tax' AND id % 2 <> 0) OR (field = 'total' AND id % 5 <> 0))
    AND (EXISTS (SELECT 1 FROM vendor_labels l WHERE l.vendor_key = u.vendor_key AND l.field = u.field AND l.label = u.label)
      OR (u.field, u.label) IN (SELECT (field, label) FROM vendor_labels GROUP BY field, label HAVING count(DISTINCT vendor_key) >= 3)))"""


@query("pre21_receipts_with_gaps", """SELECT id FROM receipts WHERE id % 3 <> 0""")
def _(spark, d):
    rows = bills(spark, d).withColumn("text", F.when(F.col("id") % 3 != 0, F.col("text")))
    return learning.wanting(rows).select("id")


@query("job9_learned_amounts", f"SELECT id, vendor_key, field, label, printed AS amount FROM {FILLED}")
def _(spark, d):
    return learning.matches(bills(spark, d), known_labels(spark, d), b.vendors(spark, d))


@query("job9_apply_learned", f"""SELECT r.id, CASE WHEN f.field = 'subtotal' THEN f.printed END AS subtotal,
    CASE WHEN r.id % 2 = 0 THEN 1.00 WHEN f.field = 'tax' THEN f.printed END AS tax,
    CASE WHEN r.id % 5 = 0 THEN 2.00 WHEN f.field = 'total' THEN f.printed END AS total
    FROM receipts r LEFT JOIN {FILLED} f ON f.id = r.id""")
def _(spark, d):
    done = learning.apply_learned(bills(spark, d), known_labels(spark, d), b.vendors(spark, d))
    return done.select("id", "subtotal", "tax", "total")


@query("num7_rescaled_confidence", f"""SELECT r.id, CAST(round(least(CASE WHEN f.id IS NULL THEN 0.5 ELSE
      (base + CASE WHEN f.field = 'total' THEN 0.3 ELSE 0 END) * 0.5 / base END, 1.0), 3) AS DECIMAL(4,3)) AS confidence
    FROM (SELECT id, CAST(0.4 + CASE WHEN receipt_number IS NULL THEN 0 ELSE 0.15 END
      + CASE WHEN id % 5 = 0 THEN 0.3 ELSE 0 END AS DOUBLE) AS base FROM receipts) r LEFT JOIN {FILLED} f ON f.id = r.id""")
def _(spark, d):
    done = learning.apply_learned(bills(spark, d), known_labels(spark, d), b.vendors(spark, d))
    return done.select("id", F.col("confidence").cast("decimal(4,3)").alias("confidence"))


@query("agg18_label_uses", f"""SELECT l.vendor_key, l.field, l.label, CAST(length(l.label) + coalesce(u.n, 0) AS INT) AS times_used
    FROM vendor_labels l LEFT JOIN (SELECT vendor_key, label, count(DISTINCT id) AS n FROM {FILLED} GROUP BY 1, 2) u
    ON u.vendor_key = l.vendor_key AND u.label = l.label""")
def _(spark, d):
    known = known_labels(spark, d)
    found = learning.matches(bills(spark, d), known, b.vendors(spark, d))
    return learning.count_uses(known, found).select("vendor_key", "field", "label", "times_used")


def taught(spark, d):
    """Texts, what was read of them, and corrections of the total."""
    rows = bills(spark, d).filter("file_id % 2 = 0 AND id % 2 = 0")
    twice = F.when(F.col("id") % 8 == 0, F.concat("text", F.lit("\nOther words "), F.col("printed").cast("string"))).otherwise(
        F.when(F.col("id") % 12 == 4, F.concat(F.lit("Net "), F.col("printed").cast("string"))).otherwise(F.col("text")))
    texts = rows.select("file_id", twice.alias("text"))
    right = F.when(F.col("id") % 20 == 0, F.col("printed"))
    one = F.lit(1).alias("seq")
    nothing = F.lit(None).cast("decimal(12,2)")
    read = rows.select("file_id", one, nothing.alias("subtotal"), nothing.alias("tax"), right.alias("total"))
    fixed = rows.select("file_id", one, "vendor", nothing.alias("subtotal"), nothing.alias("tax"), F.col("printed").alias("total"))
    return texts, read, fixed


LESSONS = f"""(SELECT DISTINCT vendor_key, 'total' AS field, label FROM {USABLE}
    WHERE (id // 2) % 2 = 0 AND id % 2 = 0 AND id % 20 <> 0 AND id % 8 <> 0 AND id % 12 <> 4)"""
BEFORE = """['before gst','levy','to settle']"""


@query("agg15_one_label_lessons", f"""SELECT DISTINCT vendor_key, 'total' AS field,
      {BEFORE}[CAST(vendor_id % 3 + 1 AS INT)] AS label FROM {USABLE}
    WHERE id % 4 = 0 AND id % 20 <> 0 AND id % 8 <> 0 AND id % 12 <> 4""")
def _(spark, d):
    return learning.lessons(*taught(spark, d), b.vendors(spark, d))


@query("job8_learned_labels", f"""SELECT DISTINCT vendor_key, 'total' AS field,
      {BEFORE}[CAST(vendor_id % 3 + 1 AS INT)] AS label FROM {USABLE}
    WHERE id % 4 = 0 AND id % 20 <> 0 AND id % 8 <> 0 AND id % 12 <> 4 AND vendor_key NOT LIKE '%7'""")
def _(spark, d):
    words = F.explode(F.array(F.lit("before gst"), F.lit("levy"), F.lit("to settle"))).alias("label")
    there = b.vendors(spark, d).select(F.lower("normalized_name").alias("vendor_key")).filter(
        "vendor_key LIKE '%7'").distinct().select("vendor_key", F.lit("total").alias("field"), words)
    return learning.learn(*taught(spark, d), b.vendors(spark, d), there)


@query("str8_label_before_amount", f"""SELECT id, {BEFORE}[CAST(vendor_id % 3 + 1 AS INT)] AS label FROM {USABLE}""")
def _(spark, d):
    line = F.element_at(F.split("text", "\n"), 2)
    return bills(spark, d).select("id", labels.label_before(line).alias("label"))


@query("str9_builtin_fields", f"""SELECT id, CASE vendor_id % 3 WHEN 0 THEN 'subtotal' WHEN 1 THEN 'tax' END AS field FROM {USABLE}""")
def _(spark, d):
    words = F.array(F.lit("net"), F.lit("gst amount"), F.lit("net worth"))
    label = F.element_at(words, (F.col("vendor_id") % 3 + 1).cast("int"))
    return b.receipts(spark, d).select("id", labels.builtin_field(label).alias("field"))


@query("num_last_amount", f"SELECT id, printed AS amount FROM {USABLE}")
def _(spark, d):
    line = F.element_at(F.split("text", "\n"), 2)
    return bills(spark, d).select("id", money.last_amount(line).alias("amount"))
