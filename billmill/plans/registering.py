"""Named queries: uploads, duplicates, vendors, stored receipts, deletion, categories."""

from pyspark.sql import functions as F

from billmill.functions import text
from billmill.operators import categories as cats
from billmill.operators import registry as reg
from billmill.operators.skew import numbered
from billmill.plans.registry import query
from billmill.sources import bindings as b
from billmill.sources import landing, sinks


def uploads(spark, d):
    """Documents as uploads: their text is what was sent."""
    n = F.col("doc_id")
    exts = F.array(*(F.lit(e) for e in ("pdf", "CSV", "exe", "Xlsx")))
    return b.table(spark, d, "documents").select(
        n.alias("id"), (F.floor(n / 20)).cast("bigint").alias("batch_id"),
        F.concat("source", F.lit("."), F.element_at(exts, (n % 4 + 1).cast("int"))).alias("name"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.sha2("text", 256).alias("sha256"), (n % 5 == 0).alias("confirmed"))


UPLOADS = """(SELECT doc_id AS id, doc_id // 20 AS batch_id, source || '.' ||
    ['pdf','CSV','exe','Xlsx'][CAST(doc_id % 4 + 1 AS INT)] AS name,
    CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256, doc_id % 5 = 0 AS confirmed
  FROM documents)"""


@query("src1_landing_hash", f"SELECT id, sha256, size_bytes FROM {UPLOADS} WHERE size_bytes <= 9000")
def _(spark, d):
    return uploads(spark, d).filter("size_bytes <= 9000").select("id", "sha256", "size_bytes")


@query("src1_landing_refused", f"SELECT id, size_bytes FROM {UPLOADS} WHERE size_bytes > 9000")
def _(spark, d):
    return uploads(spark, d).filter("size_bytes > 9000").select("id", "size_bytes")


@query("src2_storage_path",
       f"SELECT id, substr(sha256, 1, 2) || '/' || sha256 || '.pdf' AS path FROM {UPLOADS}")
def _(spark, d):
    return uploads(spark, d).select(
        "id", landing.storage_path(F.col("sha256"), F.lit("pdf")).alias("path"))


@query("win1_earliest_with_hash", f"""SELECT id, CASE WHEN id > min(id) OVER (PARTITION BY sha256)
    THEN min(id) OVER (PARTITION BY sha256) END AS duplicate_of_id FROM {UPLOADS}""")
def _(spark, d):
    return reg.mark_duplicates(uploads(spark, d)).select("id", "duplicate_of_id")


@query("win1_duplicate_files", """SELECT id, CASE WHEN id > first THEN first END AS duplicate_of_id
    FROM (SELECT id, min(id) OVER (PARTITION BY sha256) AS first FROM files)""")
def _(spark, d):
    return reg.mark_duplicates(b.files(spark, d).select("id", "sha256")).select(
        "id", "duplicate_of_id")


@query("str10_reference_numbers", """SELECT id, 'REF-' || year(uploaded_at) || '-'
      || lpad(CAST(id AS VARCHAR), 6, '0') AS ref_no,
      'REF-' || year(uploaded_at) || '-' || lpad(CAST(id AS VARCHAR), 6, '0') || '-02'
      AS second_receipt FROM files""")
def _(spark, d):
    ref = text.ref_no(F.col("id"), F.year("uploaded_at"))
    return b.files(spark, d).select(
        "id", ref.alias("ref_no"), text.receipt_ref_no(ref, F.lit(2)).alias("second_receipt"))


# The first stored file of each hash, and what that makes of the uploads, settled by rounds.
def _round(n):
    return f"""seen{n} AS (SELECT s.*, coalesce(stored, CASE WHEN s.id > f.first THEN f.first END) AS original,
        coalesce(stored, CASE WHEN s.id > f.first THEN f.first END) IS NOT NULL AND NOT confirmed AS is_copy
      FROM sound s LEFT JOIN first{n} f ON f.sha256 = s.sha256),
    last{n} AS (SELECT batch_id, id AS last FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY id) AS place
      FROM seen{n} WHERE NOT is_copy AND taken < 12) WHERE place = 12 - taken),
    out{n} AS (SELECT s.*, CASE WHEN taken >= 12 OR coalesce(s.id > last, false) THEN 'batch_full' WHEN is_copy THEN 'duplicate'
      ELSE 'registered' END AS outcome FROM seen{n} s LEFT JOIN last{n} l ON l.batch_id = s.batch_id),
    first{n + 1} AS (SELECT sha256, min(id) AS first FROM out{n} WHERE outcome = 'registered' GROUP BY 1)"""


ROUNDS = 6


@query("job4_register_uploads", f"""
    WITH u AS (SELECT * FROM {UPLOADS}), existing AS (SELECT id + 100000 AS id, sha256,
        batch_id + 1 AS batch_id FROM u WHERE id % 30 = 7),
    sound AS (SELECT u.*, lower(regexp_extract(name, '[^.]*$')) AS ext, e.stored, coalesce(t.taken, 0) AS taken
      FROM u LEFT JOIN (SELECT sha256, min(id) AS stored FROM existing GROUP BY 1) e ON e.sha256 = u.sha256
        LEFT JOIN (SELECT batch_id, count(*) AS taken FROM existing GROUP BY 1) t ON t.batch_id = u.batch_id
      WHERE size_bytes <= 9000 AND name NOT LIKE '%.exe'),
    first0 AS (SELECT sha256, min(id) AS first FROM sound GROUP BY 1), {', '.join(map(_round, range(ROUNDS)))}
    SELECT id, batch_id, outcome, CASE WHEN outcome <> 'batch_full' THEN original END AS duplicate_of_id,
      CASE WHEN outcome = 'registered' THEN 'REF-2001-' || lpad(CAST(id + 1000 AS VARCHAR), 6, '0') END AS ref_no,
      CASE WHEN outcome = 'registered' THEN substr(sha256, 1, 2) || '/' || sha256 || '.' || ext END AS storage_path
    FROM out{ROUNDS - 1}
    UNION ALL SELECT id, batch_id, CASE WHEN size_bytes > 9000 THEN 'too_large' ELSE 'bad_type' END,
      NULL, NULL, NULL FROM u WHERE size_bytes > 9000 OR name LIKE '%.exe'""")
def _(spark, d):
    u = uploads(spark, d)
    existing = u.filter("id % 30 = 7").select(
        (F.col("id") + 100000).alias("id"), "sha256", (F.col("batch_id") + 1).alias("batch_id"))
    return reg.register(u, existing, year=2001, first_number=1000, max_bytes=9000, max_files=12)


@query("win2_item_positions", "SELECT receipt_id, position, description, amount FROM line_items")
def _(spark, d):
    return b.line_items(spark, d).select("receipt_id", "position", "description", "amount")


@query("win2_receipt_seq", """SELECT id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY id)
    AS INT) AS seq FROM receipts_with_copies""")
def _(spark, d):
    rows = b.receipts_with_copies(spark, d).select("id", "file_id")
    return numbered(rows, ["file_id"], ["id"], "seq").select("id", "seq")


@query("win10_normalized_vendors", "SELECT id, raw_name, normalized_name FROM vendors")
def _(spark, d):
    return b.vendors(spark, d).select("id", "raw_name", "normalized_name")


VENDORS_BEFORE = "(SELECT * FROM vendors WHERE id % 100 < 60 AND id < 300)"


def vendors_before(spark, d):
    return b.vendors(spark, d).filter("id % 100 < 60 AND id < 300")


@query("src14_insert_if_absent", f"""SELECT DISTINCT raw_name FROM named_vendors
    WHERE raw_name NOT IN (SELECT raw_name FROM {VENDORS_BEFORE})""")
def _(spark, d):
    new = b.printed_vendors(spark, d).select(text.clean_vendor(F.col("printed")).alias("raw_name"))
    return reg.insert_if_absent(new, vendors_before(spark, d), ["raw_name"])


@query("job7_new_vendors", f"""
    WITH fresh AS (SELECT raw_name, min(id) AS at FROM named_vendors WHERE raw_name NOT IN
        (SELECT raw_name FROM {VENDORS_BEFORE}) GROUP BY 1),
    known AS (SELECT lower(normalized_name) AS folded, min_by(normalized_name, id) AS name
      FROM {VENDORS_BEFORE} GROUP BY 1)
    SELECT f.raw_name, coalesce(k.name, first_value(f.raw_name)
        OVER (PARTITION BY lower(f.raw_name) ORDER BY f.at)) AS normalized_name
    FROM fresh f LEFT JOIN known k ON k.folded = lower(f.raw_name)""")
def _(spark, d):
    printed = b.printed_vendors(spark, d).select(F.col("printed").alias("vendor"), F.col("id").alias("at"))
    return reg.new_vendors(printed, vendors_before(spark, d))


@query("job7_store_receipts", """
    SELECT r.file_id, r.run_id, row_number() OVER (PARTITION BY r.file_id ORDER BY r.id) AS seq,
      'REF-2001-' || lpad(CAST(r.file_id AS VARCHAR), 6, '0') || '-'
        || lpad(CAST(row_number() OVER (PARTITION BY r.file_id ORDER BY r.id) AS VARCHAR), 2, '0') AS ref_no,
      w.vendor_id, r.receipt_number, r.total, w.default_category_id AS category_auto_id,
      r.confidence
    FROM receipts r JOIN vendors v ON v.id = r.vendor_id
    JOIN (SELECT raw_name, min(id) AS vendor_id, min_by(coalesce(default_category_id, -1), id) AS c,
        CASE WHEN min_by(coalesce(default_category_id, -1), id) >= 0
          THEN min_by(coalesce(default_category_id, -1), id) END AS default_category_id
      FROM vendors GROUP BY 1) w ON w.raw_name = v.raw_name WHERE r.id % 12 <> 5""")
def _(spark, d):
    v = b.printed_vendors(spark, d).select(F.col("id").alias("vendor_id"), F.col("printed").alias("vendor"))
    read = b.receipts(spark, d).join(v, "vendor_id")
    total = F.when(F.col("id") % 12 != 5, F.col("total"))
    read = read.select("file_id", b.file_ref(F.col("file_id")).alias("file_ref_no"), "run_id",
                       F.col("id").alias("at"), "vendor", "receipt_number", "receipt_date",
                       "subtotal", "tax", total.alias("total"), "confidence")
    return reg.store_receipts(read, b.vendors(spark, d)).select(
        "file_id", "run_id", "seq", "ref_no", "vendor_id", "receipt_number", "total",
        "category_auto_id", "confidence")


@query("join4_paths_in_use", """SELECT id, EXISTS (SELECT 1 FROM files o
      WHERE o.storage_path = f.storage_path AND o.id <> f.id) AS shared
    FROM files f WHERE id % 20 IN (0, 3, 7)""")
def _(spark, d):
    f = b.files(spark, d).select("id", "storage_path")
    used = f.groupBy("storage_path").agg(F.count("*").alias("n"))
    asked = f.filter("id % 20 IN (0, 3, 7)")
    return asked.join(used, "storage_path").select("id", (F.col("n") > 1).alias("shared"))


GONE = "(SELECT id, storage_path FROM files WHERE id % 20 IN (0, 9) AND status NOT IN ('processing', 'ai_processing'))"
KEPT = f"""(SELECT f.* REPLACE (CASE WHEN h.heir IS NULL THEN f.duplicate_of_id
      WHEN h.heir = f.id THEN NULL ELSE h.heir END AS duplicate_of_id)
  FROM files f LEFT JOIN (SELECT duplicate_of_id AS original, min(id) AS heir FROM files
      WHERE duplicate_of_id IN (SELECT id FROM {GONE}) AND id NOT IN (SELECT id FROM {GONE})
      GROUP BY 1) h ON h.original = f.duplicate_of_id
  WHERE f.id NOT IN (SELECT id FROM {GONE}))"""


def deleted(spark, d):
    f = b.files(spark, d)
    tables = {"files": f, "receipts": b.receipts(spark, d), "flags": b.flags(spark, d),
              "runs": b.runs(spark, d), "line_items": b.line_items(spark, d)}
    return reg.delete_files(tables, f.filter("id % 20 IN (0, 9)"))


@query("win11_promoted_copies", f"SELECT id, duplicate_of_id FROM {KEPT}")
def _(spark, d):
    f = b.files(spark, d)
    gone = reg.removable(f, f.filter("id % 20 IN (0, 9)"))
    return reg.promote_copies(f, gone).select("id", "duplicate_of_id")


@query("job12_cascade_delete", f"""
    WITH gone AS (SELECT id FROM {GONE})
    SELECT 'files' AS name, count(*) AS rows FROM {KEPT} UNION ALL
    SELECT 'receipts', count(*) FROM receipts WHERE file_id NOT IN (SELECT id FROM gone) UNION ALL
    SELECT 'flags', count(*) FROM flags WHERE file_id NOT IN (SELECT id FROM gone) UNION ALL
    SELECT 'runs', count(*) FROM runs WHERE file_id NOT IN (SELECT id FROM gone) UNION ALL
    SELECT 'line_items', count(*) FROM line_items WHERE receipt_id NOT IN (SELECT id FROM receipts
      WHERE file_id IN (SELECT id FROM gone)) UNION ALL
    SELECT 'unused_paths', count(DISTINCT storage_path) FROM {GONE}
      WHERE storage_path NOT IN (SELECT storage_path FROM {KEPT})""")
def _(spark, d):
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
             for name, df in deleted(spark, d).items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- categories -------------------------------------------------------------------------


def receipts_with_auto(spark, d):
    v = b.printed_vendors(spark, d).select(
        F.col("id").alias("vendor_id"), F.col("default_category_id").alias("category_auto_id"))
    return b.receipts(spark, d).join(v, "vendor_id")


def used(spark, d):
    return cats.uses(b.categories(spark, d), receipts_with_auto(spark, d), b.printed_vendors(spark, d))


USES = """(SELECT c.id, c.name, c.builtin,
    (SELECT count(*) FROM receipts r JOIN vendors v ON v.id = r.vendor_id
     WHERE v.default_category_id = c.id OR r.category_override_id = c.id) AS receipts_using,
    (SELECT count(*) FROM vendors v WHERE v.default_category_id = c.id) AS vendors_using
  FROM categories c)"""


@query("join7_category_uses",
       f"SELECT id, name, receipts_using, vendors_using, receipts_using + vendors_using AS in_use FROM {USES}")
def _(spark, d):
    return used(spark, d).select(
        "id", "name", "receipts_using", "vendors_using",
        (F.col("receipts_using") + F.col("vendors_using")).alias("in_use"))


@query("sort5_categories_in_order", "SELECT id, name, builtin FROM categories")
def _(spark, d):
    return cats.in_order(b.categories(spark, d))


@query("join18_unknown_categories", """SELECT DISTINCT l_linenumber AS category_id FROM lineitem
    WHERE l_linenumber NOT IN (SELECT id FROM categories)""")
def _(spark, d):
    asked = b.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("category_id"))
    return cats.unknown(asked, b.categories(spark, d))


@query("set2_asked_minus_existing", """SELECT DISTINCT lower(event_type) AS name FROM events
    EXCEPT SELECT lower(name) FROM categories""")
def _(spark, d):
    asked = b.table(spark, d, "events").select(F.lower("event_type").alias("name"))
    return asked.subtract(b.categories(spark, d).select(F.lower("name").alias("name")))


@query("join19_category_text_to_id", """SELECT c.c_custkey AS id, k.id AS category_id
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment)
      WHEN c_custkey % 3 = 1 THEN 'nothing' ELSE c_mktsegment END AS word FROM customer) c
    LEFT JOIN categories k ON lower(k.name) = lower(c.word)""")
def _(spark, d):
    n = F.col("c_custkey")
    word = (F.when(n % 3 == 0, F.lower("c_mktsegment")).when(n % 3 == 1, F.lit("nothing"))
            .otherwise(F.col("c_mktsegment")))
    rows = b.table(spark, d, "customer").select(n.alias("id"), word.alias("word"))
    return cats.by_name(rows, "word", b.categories(spark, d), "category_id").select("id", "category_id")


@query("con4_fold_custom", """SELECT c.c_custkey AS id,
    CASE WHEN k.builtin THEN lower(k.name) ELSE 'other' END AS old_value
    FROM customer c JOIN categories k ON k.name = c.c_mktsegment""")
def _(spark, d):
    folded = cats.fold_custom(b.categories(spark, d)).select(
        F.col("name").alias("c_mktsegment"), "old_value")
    return b.table(spark, d, "customer").join(folded, "c_mktsegment").select(
        F.col("c_custkey").alias("id"), "old_value")


@query("src15_seed_categories", """SELECT name FROM (SELECT unnest(['Fuel','Travel','Food','Office',
      'Utilities','Maintenance','Services','Other']) AS name) s
    WHERE lower(name) NOT IN (SELECT lower(CASE WHEN id = 2 THEN 'FUEL' ELSE name END) FROM categories)
    UNION ALL SELECT CASE WHEN id = 2 THEN 'FUEL' ELSE name END FROM categories""")
def _(spark, d):
    there = b.categories(spark, d).withColumn(
        "name", F.when(F.col("id") == 2, F.lit("FUEL")).otherwise(F.col("name")))
    return sinks.seed_categories(there).select("name").unionByName(there.select("name"))


@query("job19_category_changes", f"""
    WITH asked AS (SELECT p_partkey AS turn, p_partkey % 8 AS id, CASE WHEN p_partkey % 2 = 0 THEN 'rename'
        ELSE 'delete' END AS action, CASE WHEN p_partkey % 6 = 0 THEN 'furniture' ELSE p_brand END AS name
      FROM part),
    alone AS (SELECT a.*, CASE
      WHEN u.id IS NULL THEN 'Category not found.'
      WHEN action = 'rename' AND u.builtin THEN 'Built-in categories cannot be renamed.'
      WHEN action = 'rename' AND t.id <> a.id THEN 'A category called "' || a.name || '" already exists.'
      WHEN action = 'delete' AND u.builtin THEN 'Built-in categories cannot be deleted.'
      WHEN action = 'delete' AND (receipts_using > 0 OR vendors_using > 0)
        THEN 'This category is used by ' || receipts_using || ' receipt(s) and ' || vendors_using
          || ' vendor(s). Move them to another category first.' END AS refused
    FROM asked a LEFT JOIN {USES} u ON u.id = a.id
    LEFT JOIN categories t ON lower(t.name) = lower(a.name)),
    firsts AS (SELECT lower(name) AS folded, arg_min(id, turn) AS first FROM alone
      WHERE action = 'rename' AND refused IS NULL GROUP BY 1)
    SELECT id, action, name AS new_name, CASE WHEN action = 'rename' AND refused IS NULL AND first <> id
      THEN 'A category called "' || name || '" already exists.' ELSE refused END AS refused, count(*) AS times
    FROM alone LEFT JOIN firsts ON folded = lower(name) GROUP BY ALL""")
def _(spark, d):
    n = F.col("p_partkey")
    asked = b.table(spark, d, "part").select(
        n.alias("at"), (n % 8).alias("id"), F.when(n % 2 == 0, "rename").otherwise("delete").alias("action"),
        F.when(n % 6 == 0, F.lit("furniture")).otherwise(F.col("p_brand")).alias("name"))
    decided = cats.change(b.categories(spark, d), used(spark, d), asked)
    return decided.groupBy("id", "action", "new_name", "refused").agg(F.count("*").alias("times"))


@query("str17_category_names", r"""SELECT doc_id, CASE WHEN length(name) <= 50
      AND NOT regexp_matches(name, '\p{C}') AND name <> '' THEN name END AS name
    FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')) AS name FROM documents)""")
def _(spark, d):
    return b.table(spark, d, "documents").select("doc_id", text.category_name(F.col("text")).alias("name"))
