"""Named queries: expectations, the checks on receipts, flags, the acceptance gate."""

from pyspark.sql import functions as F

from billmill.functions import dates, money, text
from billmill.operators import checks, quality
from billmill.plans.registry import query
from billmill.session import staged
from billmill.sources import bindings as b


def files(spark, d):
    """Files with some rows spoiled, one rule each."""
    n = F.col("id") % 40
    return b.files(spark, d).withColumns({
        "ref_no": F.when(n == 1, F.lower("ref_no")).when(n == 2, F.lit("REF-2001-000001"))
        .otherwise(F.col("ref_no")),
        "sha256": F.when(n == 4, F.upper("sha256")).otherwise(F.col("sha256")),
        "size_bytes": F.when(n == 5, F.lit(-1)).otherwise(F.col("size_bytes")),
        "original_name": F.when(n == 6, F.lit("a/b.pdf")).when(n == 7, F.lit("a\tb.pdf"))
        .when(n == 8, F.lit("")).otherwise(F.col("original_name")),
        "storage_path": F.when(n == 9, F.lit("/etc/x")).when(n == 10, F.lit("a/../b"))
        .otherwise(F.col("storage_path")),
        "duplicate_of_id": F.when(n == 11, F.col("id")).when(n == 12, F.lit(-5))
        .otherwise(F.col("duplicate_of_id")),
        "status": F.when(n == 13, F.lit("lost")).otherwise(F.col("status")),
        "kind": F.when(n == 14, F.lit("word")).when(n == 15, F.lit(None))
        .otherwise(F.col("kind")),
        "batch_id": F.when(n == 16, F.lit(-1)).otherwise(F.col("batch_id")),
    })


FILES = """(SELECT * REPLACE (
  CASE id % 40 WHEN 1 THEN lower(ref_no) WHEN 2 THEN 'REF-2001-000001' ELSE ref_no END AS ref_no,
  CASE id % 40 WHEN 4 THEN upper(sha256) ELSE sha256 END AS sha256,
  CASE id % 40 WHEN 5 THEN -1 ELSE size_bytes END AS size_bytes,
  CASE id % 40 WHEN 6 THEN 'a/b.pdf' WHEN 7 THEN 'a' || chr(9) || 'b.pdf' WHEN 8 THEN ''
    ELSE original_name END AS original_name,
  CASE id % 40 WHEN 9 THEN '/etc/x' WHEN 10 THEN 'a/../b' ELSE storage_path END AS storage_path,
  CASE id % 40 WHEN 11 THEN id WHEN 12 THEN -5 ELSE duplicate_of_id END AS duplicate_of_id,
  CASE id % 40 WHEN 13 THEN 'lost' ELSE status END AS status,
  CASE id % 40 WHEN 14 THEN 'word' WHEN 15 THEN NULL ELSE kind END AS kind,
  CASE id % 40 WHEN 16 THEN -1 ELSE batch_id END AS batch_id) FROM files)"""


def receipts(spark, d):
    n = F.col("id") % 50
    return b.receipts_with_copies(spark, d).withColumns({
        "ref_no": F.when(n == 1, F.lit("REF-1")).when(n == 2, F.concat("ref_no", F.lit("9")))
        .otherwise(F.col("ref_no")),
        "seq": F.when(n == 3, F.lit(0)).otherwise(F.col("seq")),
        "confidence": F.when(n == 4, F.lit(1.5)).otherwise(F.col("confidence")),
        "vendor_id": F.when(n == 6, F.lit(None)).when(n == 7, F.lit(-1))
        .otherwise(F.col("vendor_id")),
        "receipt_date": F.when(n == 8, F.lit(None)).otherwise(F.col("receipt_date")),
        "total": F.when(n == 9, F.lit(None)).otherwise(F.col("total")),
        "run_id": F.when(n == 10, F.col("run_id") + 2).otherwise(F.col("run_id")),
        "category_override_id": F.when(n == 11, F.lit(99))
        .otherwise(F.col("category_override_id")),
    })


RECEIPTS = """(SELECT * REPLACE (
  CASE id % 50 WHEN 1 THEN 'REF-1' WHEN 2 THEN ref_no || '9' ELSE ref_no END AS ref_no,
  CASE id % 50 WHEN 3 THEN 0 ELSE seq END AS seq,
  CASE id % 50 WHEN 4 THEN 1.5 ELSE confidence END AS confidence,
  CASE id % 50 WHEN 6 THEN NULL WHEN 7 THEN -1 ELSE vendor_id END AS vendor_id,
  CASE id % 50 WHEN 8 THEN NULL ELSE receipt_date END AS receipt_date,
  CASE id % 50 WHEN 9 THEN NULL ELSE total END AS total,
  CASE id % 50 WHEN 10 THEN run_id + 2 ELSE run_id END AS run_id,
  CASE id % 50 WHEN 11 THEN 99 ELSE category_override_id END AS category_override_id)
  FROM receipts_with_copies)"""


def runs(spark, d):
    n = F.col("id") % 60
    return b.runs(spark, d).withColumns({
        "parser": F.when(n == 0, F.lit("oracle")).otherwise(F.col("parser")),
        "provider": F.when(n == 1, F.lit(None)).when(n == 3, F.lit("nobody"))
        .when(n == 4, F.lit("openai")).otherwise(F.col("provider")),
        "confidence": (F.col("id") % 121) / 100.0,
        "duration_ms": (F.col("id") % 200 - 3).cast("int"),
    })


RUNS = """(SELECT * REPLACE (
    CASE id % 60 WHEN 0 THEN 'oracle' ELSE parser END AS parser,
    CASE id % 60 WHEN 1 THEN NULL WHEN 3 THEN 'nobody' WHEN 4 THEN 'openai' ELSE provider END
      AS provider), (id % 121) / 100.0 AS confidence, CAST(id % 200 - 3 AS INT) AS duration_ms
  FROM runs)"""


def flags(spark, d):
    n = F.col("id") % 28
    return b.flags(spark, d).withColumns({
        "type": F.when(n == 0, F.lit("odd")).otherwise(F.col("type")),
        "severity": F.when(n == 4, F.lit("fatal")).otherwise(F.col("severity")),
        "resolved_by": F.when(n == 8, F.lit(None)).when(n == 12, F.lit("ravi"))
        .otherwise(F.col("resolved_by")),
        "dedupe_key": F.when(n == 16, F.lit("")).otherwise(F.col("dedupe_key")),
    })


FLAGS = """(SELECT * REPLACE (
  CASE id % 28 WHEN 0 THEN 'odd' ELSE type END AS type,
  CASE id % 28 WHEN 4 THEN 'fatal' ELSE severity END AS severity,
  CASE id % 28 WHEN 8 THEN NULL WHEN 12 THEN 'ravi' ELSE resolved_by END AS resolved_by,
  CASE id % 28 WHEN 16 THEN '' ELSE dedupe_key END AS dedupe_key) FROM flags)"""


def users(spark, d):
    n = F.col("c_custkey")
    roles = F.array(F.lit("viewer"), F.lit("reviewer"), F.lit("admin"), F.lit("owner"))
    name = (F.when(n % 10 == 0, F.concat(F.lit(" "), "c_name")).when(n % 10 == 1, F.lit(""))
            .when(n % 10 == 2, F.concat("c_name", F.lit("\x07"))).otherwise(F.col("c_name")))
    return b.table(spark, d, "customer").select(
        n.alias("id"), name.alias("display_name"),
        F.element_at(roles, (n % 4 + 1).cast("int")).alias("role"))


USERS = """(SELECT c_custkey AS id, CASE c_custkey % 10 WHEN 0 THEN ' ' || c_name WHEN 1 THEN ''
    WHEN 2 THEN c_name || chr(7) ELSE c_name END AS display_name,
  ['viewer','reviewer','admin','owner'][CAST(c_custkey % 4 + 1 AS INT)] AS role FROM customer)"""


def labels(spark, d):
    n = F.length("vendor_key") + F.length("label")
    return b.vendor_labels(spark, d).withColumns({
        "label": F.when(n % 7 == 0, F.upper("label")).otherwise(F.col("label")),
        "vendor_key": F.when(n % 5 == 0, F.lit("")).otherwise(F.col("vendor_key")),
        "field": F.when(n % 11 == 0, F.lit("vendor")).otherwise(F.col("field")),
        "times_used": n - 22,
    })


LABELS = """(SELECT * EXCLUDE (n) REPLACE (
    CASE WHEN n % 7 = 0 THEN upper(label) ELSE label END AS label,
    CASE WHEN n % 5 = 0 THEN '' ELSE vendor_key END AS vendor_key,
    CASE WHEN n % 11 = 0 THEN 'vendor' ELSE field END AS field), n - 22 AS times_used
  FROM (SELECT *, length(vendor_key) + length(label) AS n FROM vendor_labels))"""

TABLES = {
    "files": files, "receipts": receipts, "runs": runs, "flags": flags, "users": users,
    "vendor_labels": labels, "line_items": b.line_items,
    "vendors": b.vendors, "categories": b.categories,
    "upload_batches": lambda s, d: b.files(s, d).select(F.col("batch_id").alias("id")).distinct(),
}
SQL = {"files": FILES, "receipts": RECEIPTS, "runs": RUNS, "flags": FLAGS, "users": USERS,
       "vendor_labels": LABELS, "line_items": "line_items", "vendors": "vendors",
       "categories": "categories",
       "upload_batches": "(SELECT DISTINCT batch_id AS id FROM files)"}
KEYS = {"vendor_labels": "vendor_key || '|' || field || '|' || label", "categories": "name",
        "line_items": "receipt_id || '|' || position"}


def key_of(table: str) -> str:
    return KEYS.get(table, "CAST(id AS VARCHAR)")


def row_rules(name: str, conditions: dict[str, tuple[str, str]]) -> None:
    """Registers a query over several row rules; conditions: rule -> (table, what holds)."""
    sql = " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, {key_of(table)} AS key FROM {SQL[table]} WHERE NOT ({holds})"
        for rule, (table, holds) in conditions.items())

    @query(name, sql)
    def _(spark, d):
        parts = []
        for rule, (table, _holds) in conditions.items():
            broken = quality.expect({table: TABLES[table](spark, d)}, rule)
            key = F.expr(key_of(table).replace("VARCHAR", "STRING"))
            parts.append(broken.select(F.lit(rule).alias("rule"), key.alias("key")))
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result


CTRL = r"'[\x00-\x1f\x7f]'"
row_rules("exp1_names_clean", {
    "user_name_clean": ("users", f"display_name <> '' AND display_name = trim(display_name) AND NOT regexp_matches(display_name, {CTRL})"),
    "name_clean": ("categories", f"name <> '' AND name = trim(name) AND NOT regexp_matches(name, {CTRL})")})
row_rules("exp2_reference_formats", {
    "file_ref_format": ("files", "regexp_matches(ref_no, '^REF-[0-9]{4}-[0-9]{6,}$')"),
    "receipt_ref_format": ("receipts", "regexp_matches(ref_no, '^REF-[0-9]{4}-[0-9]{6,}-[0-9]{2,}$')")})
row_rules("exp3_reference_matches_seq", {"ref_matches_seq": ("receipts", """ref_no =
    regexp_replace(ref_no, '-[0-9]+$', '') || '-' ||
    lpad(CAST(seq AS VARCHAR), CAST(greatest(2, length(CAST(seq AS VARCHAR))) AS INT), '0')""")})
row_rules("exp4_hash_format", {"sha256_format": ("files", "regexp_matches(sha256, '^[0-9a-f]{64}$')")})
row_rules("exp5_counts_in_range", {
    "size_not_negative": ("files", "size_bytes >= 0"),
    "attempts_not_negative": ("files", "attempts >= 0"),
    "seq_positive": ("receipts", "seq >= 1"),
    "position_positive": ("line_items", "position >= 1"),
    "duration_not_negative": ("runs", "duration_ms >= 0"),
    "times_used_not_negative": ("vendor_labels", "times_used >= 0")})
row_rules("exp6_original_name_safe", {"original_name_safe": ("files",
    rf"original_name <> '' AND NOT regexp_matches(original_name, '[/\\\x00-\x1f\x7f]')")})
row_rules("exp7_storage_path_relative", {"storage_path_relative": ("files",
    r"storage_path <> '' AND substr(storage_path, 1, 1) NOT IN ('/', '\') AND instr(storage_path, '..') = 0")})
row_rules("exp8_not_copy_of_itself", {"not_copy_of_itself": ("files", "duplicate_of_id <> id")})
row_rules("exp9_confidence_range", {
    "receipt_confidence_range": ("receipts", "confidence BETWEEN 0 AND 1"),
    "run_confidence_range": ("runs", "confidence BETWEEN 0 AND 1")})
row_rules("exp10_approval_recorded", {
    "second_read_approved": ("runs", "parser <> 'ai' OR (provider IS NOT NULL AND ai_approved_by IS NOT NULL AND ai_approved_at IS NOT NULL)"),
    "library_read_unapproved": ("runs", "parser = 'ai' OR (provider IS NULL AND model IS NULL AND ai_approved_by IS NULL AND ai_approved_at IS NULL)")})
row_rules("exp11_accepted_run_succeeded", {"accepted_run_succeeded": ("runs",
    "NOT accepted OR (error IS NULL AND has_result AND finished_at IS NOT NULL)")})
row_rules("exp12_resolution_consistent", {
    "resolution_consistent": ("flags", """(resolved AND resolved_by IS NOT NULL AND resolved_at IS NOT NULL)
      OR (NOT resolved AND resolved_by IS NULL AND resolved_at IS NULL)"""),
    "dedupe_key_not_empty": ("flags", "dedupe_key <> ''")})
row_rules("exp13_known_values", {
    "file_status_known": ("files", "status IN ('pending','processing','parsed','needs_review','ai_processing','flagged','resolved','rejected','failed')"),
    "file_kind_known": ("files", "kind IN ('excel','csv','pdf_text','pdf_scan','image')"),
    "run_parser_known": ("runs", "parser IN ('excel','csv','pdf_text','pdf_scan','image','ai','manual')"),
    "run_provider_known": ("runs", "provider IN ('anthropic','openai','gemini')"),
    "flag_type_known": ("flags", "type IN ('unreadable','validation_failed','parser_conflict','duplicate_receipt','arithmetic_mismatch')"),
    "flag_severity_known": ("flags", "severity IN ('info','warning','error')"),
    "user_role_known": ("users", "role IN ('viewer','reviewer','admin')")})
row_rules("exp14_labels_clean", {
    "label_clean": ("vendor_labels", "label <> '' AND label = lower(label)"),
    "vendor_key_clean": ("vendor_labels", "vendor_key <> '' AND vendor_key = lower(vendor_key)"),
    "label_field_known": ("vendor_labels", "field IN ('subtotal','tax','total')")})
row_rules("exp18_required_given", {
    "receipt_vendor_id_given": ("receipts", "vendor_id IS NOT NULL"),
    "receipt_receipt_date_given": ("receipts", "receipt_date IS NOT NULL"),
    "receipt_total_given": ("receipts", "total IS NOT NULL")})


def unique_rules(name: str, rules: dict[str, tuple[str, str, str]]) -> None:
    """rules: rule -> (table, key text, where)."""
    sql = " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, {key} AS key, count(*) AS rows FROM {SQL[table]} "
        f"WHERE {where} AND ({key}) IS NOT NULL GROUP BY {key} HAVING count(*) > 1"
        for rule, (table, key, where) in rules.items())

    @query(name, sql)
    def _(spark, d):
        parts = [quality.expect({table: TABLES[table](spark, d)}, rule)
                 .select(F.lit(rule).alias("rule"), "key", "rows")
                 for rule, (table, _k, _w) in rules.items()]
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result


unique_rules("exp15_unique_keys", {
    "vendor_raw_name": ("vendors", "raw_name", "true"),
    "file_ref_no": ("files", "ref_no", "true"),
    "receipt_ref_no": ("receipts", "ref_no", "true"),
    "receipt_seq": ("receipts", "file_id || '|' || seq", "true"),
    "item_position": ("line_items", "receipt_id || '|' || position", "true"),
    "vendor_label": ("vendor_labels", "vendor_key || '|' || field || '|' || label", "true"),
    "category_name": ("categories", "lower(name)", "true")})
unique_rules("exp16_partly_unique_keys", {
    "one_accepted_run": ("runs", "CAST(file_id AS VARCHAR)", "accepted"),
    "one_library_run": ("runs", "CAST(file_id AS VARCHAR)",
                        "parser IN ('excel','csv','pdf_text','pdf_scan','image')"),
    "one_open_flag": ("flags", "type || '|' || dedupe_key", "NOT resolved")})

REFERENCES = {
    "file_batch": ("files", ["batch_id"], "upload_batches", ["id"]),
    "file_original": ("files", ["duplicate_of_id"], "files", ["id"]),
    "run_file": ("runs", ["file_id"], "files", ["id"]),
    "run_cached_from": ("runs", ["cached_from_id"], "runs", ["id"]),
    "receipt_run": ("receipts", ["run_id", "file_id"], "runs", ["id", "file_id"]),
    "receipt_file": ("receipts", ["file_id"], "files", ["id"]),
    "receipt_vendor": ("receipts", ["vendor_id"], "vendors", ["id"]),
    "receipt_override": ("receipts", ["category_override_id"], "categories", ["id"]),
    "vendor_category": ("vendors", ["default_category_id"], "categories", ["id"]),
    "item_receipt": ("line_items", ["receipt_id"], "receipts", ["id"]),
    "flag_file": ("flags", ["file_id"], "files", ["id"]),
    "flag_receipt": ("flags", ["receipt_id"], "receipts", ["id"]),
}


def _reference_sql(rule: str) -> str:
    table, keys, other, others = REFERENCES[rule]
    given = " AND ".join(f"a.{k} IS NOT NULL" for k in keys)
    same = " AND ".join(f"b.{o} = a.{k}" for k, o in zip(keys, others))
    return (f"SELECT '{rule}' AS rule, count(*) AS rows FROM {SQL[table]} a WHERE {given} "
            f"AND NOT EXISTS (SELECT 1 FROM {SQL[other]} b WHERE {same})")


@query("exp17_references", " UNION ALL ".join(_reference_sql(r) for r in REFERENCES))
def _(spark, d):
    tables = {name: build(spark, d) for name, build in TABLES.items()}
    parts = [quality.expect(tables, rule).agg(F.count("*").alias("rows"))
             .select(F.lit(rule).alias("rule"), "rows") for rule in REFERENCES]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("exp_file_rule_counts", f"""SELECT unnest(['sha256_format', 'size_not_negative',
      'not_copy_of_itself']) AS rule, unnest([
      count(*) FILTER (NOT regexp_matches(sha256, '^[0-9a-f]{{64}}$')),
      count(*) FILTER (NOT size_bytes >= 0), count(*) FILTER (NOT duplicate_of_id <> id)])
    AS violations FROM {FILES}""")
def _(spark, d):
    rules = [quality.rule(n) for n in ("sha256_format", "size_not_negative", "not_copy_of_itself")]
    return quality.row_rule_counts(files(spark, d), rules)


# --- checks on receipts ------------------------------------------------------------------


def read_receipts(spark, d):
    """Receipts as a reader returns them: some lack a required field."""
    n = F.col("id") % 30
    v = b.printed_vendors(spark, d).select(F.col("id").alias("vendor_id"),
                                           text.clean_vendor(F.col("printed")).alias("vendor"))
    own = b.receipts(spark, d).join(v, "vendor_id", "left")
    return own.select(
        "id", "file_id", "seq",
        F.when(n == 0, F.lit("")).when(n == 1, F.lit(None)).otherwise(F.col("vendor")).alias("vendor"),
        F.when(n.isin(1, 2), F.lit(None)).otherwise(F.col("receipt_date")).alias("receipt_date"),
        F.when(n.isin(1, 2, 3), F.lit(None)).otherwise(F.col("total")).alias("total"),
        "confidence", "receipt_number", "subtotal", "tax")


READ = """(SELECT r.id, r.file_id, r.seq,
    CASE WHEN r.id % 30 = 0 THEN '' WHEN r.id % 30 = 1 THEN NULL ELSE v.raw_name END AS vendor,
    CASE WHEN r.id % 30 IN (1, 2) THEN NULL ELSE r.receipt_date END AS receipt_date,
    CASE WHEN r.id % 30 IN (1, 2, 3) THEN NULL ELSE r.total END AS total, r.confidence,
    r.receipt_number, r.subtotal, r.tax
  FROM receipts r LEFT JOIN vendors v ON v.id = r.vendor_id)"""
MISSING = """list_filter([CASE WHEN coalesce(vendor, '') = '' THEN 'vendor' END,
  CASE WHEN receipt_date IS NULL THEN 'receipt_date' END,
  CASE WHEN total IS NULL THEN 'total' END], lambda x: x IS NOT NULL)"""


@query("pre14_missing_required", f"""SELECT id, array_to_string({MISSING}, ',') AS missing
    FROM {READ} WHERE len({MISSING}) > 0""")
def _(spark, d):
    rows = read_receipts(spark, d).withColumn("missing", checks.missing_required())
    return rows.filter(F.size("missing") > 0).select("id", F.concat_ws(",", "missing").alias("missing"))


ACCEPT = f"""(SELECT f.id, count(r.id) AS receipts,
    list(CASE WHEN r.words IS NOT NULL THEN r.which || ' is missing its ' || r.words || '.'
      WHEN r.confidence < f.least THEN r.which || ' was read with low confidence ('
        || CAST(round_even(r.confidence * 100, 0) AS INT) || '%).' END ORDER BY r.seq)
      FILTER (r.words IS NOT NULL OR r.confidence < f.least) AS problems
  FROM (SELECT id, CASE WHEN kind IN ('pdf_scan', 'image') THEN 0.7 ELSE 0.6 END AS least
        FROM files) f
  LEFT JOIN (SELECT *, CASE WHEN count(*) OVER (PARTITION BY file_id) > 1
      THEN 'Receipt ' || row_number() OVER (PARTITION BY file_id ORDER BY seq)
      ELSE 'The receipt' END AS which,
      CASE len(m) WHEN 0 THEN NULL WHEN 1 THEN m[1] WHEN 2 THEN m[1] || ' and ' || m[2]
        ELSE m[1] || ', ' || m[2] || ' and ' || m[3] END AS words
    FROM (SELECT *, list_transform({MISSING},
        lambda x: CASE WHEN x = 'receipt_date' THEN 'date' ELSE x END) AS m
      FROM {READ} WHERE file_id % 10 <> 4)) r ON r.file_id = f.id
  GROUP BY f.id)"""


def accepted(spark, d):
    some = read_receipts(spark, d).filter("file_id % 10 <> 4")
    return checks.acceptance(b.files(spark, d).select("id", "kind"), some)


@query("pre15_acceptance_gate", f"""SELECT id, receipts,
    CASE WHEN receipts = 0 THEN 'No receipt could be found in this file.'
      ELSE coalesce(array_to_string(problems, ' '), '') END AS problems,
    receipts > 0 AND problems IS NULL AS accepted FROM {ACCEPT}""")
def _(spark, d):
    return accepted(spark, d).select("id", "receipts", F.concat_ws(" ", "problems").alias("problems"),
                                     "accepted")


@query("con2_status_decision", f"""SELECT id,
    CASE WHEN id % 23 = 0 THEN 'flagged' WHEN id % 19 = 0 THEN 'needs_review'
      WHEN receipts > 0 AND problems IS NULL THEN 'parsed' ELSE 'needs_review' END AS status,
    CASE WHEN id % 23 = 0 THEN 'The file is damaged.'
      WHEN id % 19 = 0 THEN 'No reader is available for this kind of file.'
      WHEN receipts = 0 THEN 'No receipt could be found in this file.'
      WHEN problems IS NOT NULL THEN array_to_string(problems[1:3], ' ') END AS error
    FROM {ACCEPT}""")
def _(spark, d):
    rows = accepted(spark, d).withColumns({
        "unreadable": F.col("id") % 23 == 0, "has_reader": F.col("id") % 19 != 0,
        "read_error": F.lit("The file is damaged.")})
    return checks.decide_status(rows).select(
        "id", F.col("new_status").alias("status"), F.col("new_error").alias("error"))


@query("pre16_receipt_candidates", f"""SELECT id FROM (SELECT r.id,
      CASE WHEN r.id % 4 = 0 THEN 0 WHEN r.id % 4 = 1 THEN r.total END AS total,
      coalesce(i.n, 0) AS items, r.receipt_number
    FROM {READ} r LEFT JOIN item_sums i ON i.id = r.id)
    WHERE coalesce(total, 0) <> 0 OR items > 0 OR receipt_number IS NOT NULL""")
def _(spark, d):
    sums = checks.item_sums(b.item_amounts(spark, d)).select(F.col("receipt_id").alias("id"), "items")
    n = F.col("id") % 4
    rows = read_receipts(spark, d).join(sums, "id", "left")
    total = F.when(n == 0, F.lit(0)).when(n == 1, F.col("total"))
    return checks.keep_candidates(rows.withColumn("total", total)).select("id")


@query("join17_threshold_lookup", """SELECT id, kind,
    CASE WHEN kind IN ('pdf_scan', 'image') THEN 0.7 ELSE 0.6 END AS least FROM files""")
def _(spark, d):
    from billmill.functions.labels import lookup
    from billmill.model import MIN_CONFIDENCE

    return b.files(spark, d).select(
        "id", "kind", lookup(MIN_CONFIDENCE, F.col("kind")).cast("decimal(2,1)").alias("least"))


@query("agg5_item_sums", """SELECT id AS receipt_id, items_total, n AS items FROM item_sums""")
def _(spark, d):
    return checks.item_sums(b.item_amounts(spark, d))


CHECKED = ["id", "file_id", "seq", "ref_no", "vendor", "normalized_name", "status", "receipt_number",
           "receipt_date", "subtotal", "tax", "total", "items_total", "items"]


def named_receipts(spark, d):
    """Receipts as the checks read them. Each check reads them, and duplicates twice, so their
    sums and joins are worked out once and written: a task of a check holds none of them."""
    v = b.vendors(spark, d).select(F.col("id").alias("vendor_id"),
                                   F.col("raw_name").alias("vendor"), "normalized_name")
    f = b.files(spark, d).select(F.col("id").alias("file_id"), "status")
    named = b.priced_receipts(spark, d).join(v, "vendor_id").join(f, "file_id")
    return staged(named.select(*CHECKED), "checked-receipts")


# Amounts below and above a thousand, printed as the messages print them.
def western(amount: str) -> str:
    return f"""'₹' || format('{{:,}}', CAST(floor({amount}) AS BIGINT)) || '.'
      || lpad(CAST(CAST(({amount}) * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0')"""


ARITHMETIC = f"""
  SELECT file_id, id AS receipt_id, seq, 'arithmetic_mismatch' AS type,
    'Subtotal ' || {western('subtotal')} || ' + tax ' || {western('tax')} || ' = '
      || {western('subtotal + tax')} || ', but the total is ' || {western('total')} || '.' AS detail,
    'subtotal+tax' AS key
  FROM priced_receipts WHERE abs(subtotal + tax - total) > 1
  UNION ALL
  SELECT file_id, id, seq, 'arithmetic_mismatch', 'Line items add up to '
      || {western('items_total')} || ', which does not match '
      || CASE WHEN subtotal IS NOT NULL THEN 'the subtotal ' || {western('subtotal')} || ' or '
         ELSE '' END || 'the total ' || {western('total')} || '.', 'items'
  FROM priced_receipts WHERE items > 0 AND NOT coalesce(abs(items_total - subtotal) <= 1, false)
    AND NOT coalesce(abs(items_total - total) <= 1, false)"""
DATES = """
  SELECT file_id, id AS receipt_id, seq, 'validation_failed' AS type,
    'The date ' || strftime(receipt_date, '%d %b %Y') || CASE
      WHEN receipt_date > DATE '2001-08-01' THEN ' is in the future.'
      ELSE ' is before 01 Apr 2000, the start of last financial year.' END AS detail, 'date' AS key
  FROM priced_receipts
  WHERE receipt_date > DATE '2001-08-01' OR receipt_date < DATE '2000-04-01'"""
STORED = """(SELECT r.*, v.raw_name, lower(v.normalized_name) AS known, f.status
  FROM priced_receipts r JOIN vendors v ON v.id = r.vendor_id JOIN files f ON f.id = r.file_id)"""


def duplicate_sql(condition: str) -> str:
    return f"""
  SELECT file_id, id AS receipt_id, seq, 'duplicate_receipt' AS type,
    'The same receipt (vendor, number and total) is already stored as ' || other || '.' AS detail,
    'duplicate-of:' || other AS key
  FROM (SELECT a.file_id, a.id, a.seq, min_by(b.ref_no, b.id) AS other, min(b.id) AS other_id
    FROM {STORED} a JOIN {STORED} b ON b.known = lower(a.raw_name) AND b.total = a.total
      AND b.file_id <> a.file_id AND b.status IN ('parsed', 'resolved')
      AND CASE WHEN a.receipt_number IS NOT NULL THEN b.receipt_number = a.receipt_number
          ELSE b.receipt_date = a.receipt_date END
    GROUP BY ALL) WHERE {condition}"""


@query("join5_duplicate_receipts", duplicate_sql("other_id < id"))
def _(spark, d):
    r = named_receipts(spark, d)
    return checks.duplicate_problems(r, stored=r)


@query("join5_duplicates_both_ways", duplicate_sql("true"))
def _(spark, d):
    r = named_receipts(spark, d)
    return checks.duplicate_problems(r, stored=r, symmetric=True)


@query("job2_arithmetic", ARITHMETIC)
def _(spark, d):
    return checks.arithmetic_problems(b.priced_receipts(spark, d))


@query("dat9_plausible_dates", DATES)
def _(spark, d):
    return checks.date_problems(b.priced_receipts(spark, d), today=b.today())


ALL = f"{ARITHMETIC} UNION ALL {DATES} UNION ALL {duplicate_sql('other_id < id')}"


def all_problems(spark, d):
    r = named_receipts(spark, d)
    return checks.check_receipts(r, today=b.today(), stored=r)


@query("job2_all_checks", ALL)
def _(spark, d):
    return all_problems(spark, d)


@query("set4_union_of_problems", f"SELECT type, key = 'items' AS items, count(*) AS problems FROM ({ALL}) GROUP BY 1, 2")
def _(spark, d):
    return all_problems(spark, d).groupBy("type", (F.col("key") == "items").alias("items")).agg(
        F.count("*").alias("problems"))


@query("udf4_own_check_function", """
    SELECT type, count(*) AS problems FROM (SELECT 'validation_failed' AS type FROM priced_receipts
      WHERE receipt_number IS NULL UNION ALL SELECT type FROM (""" + DATES + """)) GROUP BY 1""")
def _(spark, d):
    def no_number(receipts, **_):
        bare = receipts.filter(F.col("receipt_number").isNull())
        return bare.select("file_id", F.col("id").alias("receipt_id"), "seq",
                           F.lit("validation_failed").alias("type"),
                           F.lit("The receipt has no number.").alias("detail"),
                           F.lit("number").alias("key"))

    found = checks.check_receipts(b.priced_receipts(spark, d), today=b.today(),
                                  checks=[no_number, checks.date_problems])
    return found.groupBy("type").agg(F.count("*").alias("problems"))


OPEN_KEYS = """(SELECT type, file_id || ':' || seq || ':' || key AS dedupe_key FROM
    (SELECT id, file_id, seq, 'validation_failed' AS type, 'date' AS key FROM priced_receipts
     WHERE id % 3 = 0))"""


@query("job3_flags_from_problems", f"""
    SELECT type, dedupe_key, min(file_id) AS file_id, 'warning' AS severity
    FROM (SELECT *, file_id || ':' || seq || ':' || key AS dedupe_key FROM ({ALL})) p
    WHERE NOT EXISTS (SELECT 1 FROM {OPEN_KEYS} o
      WHERE o.type = p.type AND o.dedupe_key = p.dedupe_key) GROUP BY 1, 2""")
def _(spark, d):
    key = F.concat_ws(":", F.col("file_id").cast("string"), F.col("seq").cast("string"), F.lit("date"))
    there = b.receipts_with_copies(spark, d).filter("id % 3 = 0").select(
        F.lit("validation_failed").alias("type"), key.alias("dedupe_key"), F.lit(False).alias("resolved"))
    return checks.new_flags(all_problems(spark, d), there).select(
        "type", "dedupe_key", "file_id", "severity")


@query("job18_items_add_up", """SELECT id, CASE WHEN items > 0 THEN
      coalesce(subtotal <> 0 AND abs(items_total - subtotal) <= 1, false)
      OR coalesce(total <> 0 AND abs(items_total - total) <= 1, false) END AS items_add_up
    FROM priced_receipts""")
def _(spark, d):
    return checks.items_add_up(b.priced_receipts(spark, d)).select("id", "items_add_up")


@query("num5_within_a_rupee", """SELECT id, abs(subtotal + tax - total) <= 1 AS close FROM receipts""")
def _(spark, d):
    return b.receipts(spark, d).select("id", money.close(F.col("subtotal") + F.col("tax"), F.col("total")).alias("close"))


@query("dat3_financial_year_start", """SELECT id, make_date(CAST(year(receipt_date)
    - CASE WHEN month(receipt_date) < 4 THEN 1 ELSE 0 END AS BIGINT), 4, 1) AS starts FROM receipts""")
def _(spark, d):
    return b.receipts(spark, d).select(
        "id", dates.financial_year_start(F.col("receipt_date")).alias("starts"))


@query("str21_dedupe_keys", f"""SELECT file_id || ':' || seq || ':' || key AS dedupe_key
    FROM ({DATES})""")
def _(spark, d):
    problems = checks.date_problems(b.priced_receipts(spark, d), today=b.today())
    return checks.to_flags(problems).select("dedupe_key")


@query("win13_first_problems", f"""SELECT id, CASE WHEN receipts = 0
      THEN 'No receipt could be found in this file.'
      ELSE array_to_string(problems[1:1], ' ') || CASE WHEN len(problems) > 1
        THEN ' And ' || (len(problems) - 1) || ' more.' ELSE '' END END AS summary
    FROM {ACCEPT} WHERE receipts = 0 OR problems IS NOT NULL""")
def _(spark, d):
    rows = accepted(spark, d).filter("NOT accepted")
    return rows.select("id", text.summarize(F.col("problems"), 1).alias("summary"))
