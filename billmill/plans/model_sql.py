"""The model tables of sources/bindings.py in the other engine's SQL."""

import re

FINISH = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

TABLES = {
    "categories": """
        SELECT row_number() OVER (ORDER BY name) AS id, name,
               row_number() OVER (ORDER BY name) <= 3 AS builtin
        FROM (SELECT DISTINCT c_mktsegment AS name FROM customer)""",
    "printed_vendors": """
        SELECT c.c_custkey AS id, CASE (c.c_custkey // 100) % 3
                 WHEN 0 THEN 'Trader ' || lpad(CAST(c.c_custkey % 100 AS VARCHAR), 3, '0')
                 WHEN 1 THEN 'TRADER ' || lpad(CAST(c.c_custkey % 100 AS VARCHAR), 3, '0')
                 ELSE '  Trader ' || lpad(CAST(c.c_custkey % 100 AS VARCHAR), 3, '0') || ' ,' END
                 AS printed,
               k.id AS default_category_id
        FROM customer c LEFT JOIN categories k
          ON k.name = c.c_mktsegment AND c.c_custkey % 10 <> 0""",
    "named_vendors": """
        SELECT id, trim(printed, ' :,-|*') AS raw_name, default_category_id FROM printed_vendors""",
    "vendors": """
        SELECT v.id, v.raw_name, n.normalized_name, v.default_category_id
        FROM named_vendors v JOIN (
          SELECT lower(raw_name) AS folded, min_by(raw_name, id) AS normalized_name
          FROM named_vendors GROUP BY 1) n ON n.folded = lower(v.raw_name)""",
    "file_base": """
        SELECT o_orderkey // 2 AS id, min(o_orderstatus) AS letter,
               CAST(min(o_orderdate) AS TIMESTAMP) AS uploaded_at,
               sha256('file ' || CAST(CASE WHEN (o_orderkey // 2) % 20 = 3
                 THEN o_orderkey // 2 - 3 ELSE o_orderkey // 2 END AS VARCHAR)) AS sha256
        FROM orders GROUP BY o_orderkey // 2""",
    "files": """
        SELECT id, 'REF-2001-' || CASE WHEN id < 1000000 THEN lpad(CAST(id AS VARCHAR), 6, '0')
                 ELSE CAST(id AS VARCHAR) END AS ref_no,
               id // 50 AS batch_id,
               'Scan_' || id || '.' || ['xlsx','csv','pdf','pdf','jpg'][CAST(id % 5 + 1 AS INT)]
                 AS original_name,
               sha256, id % 4096 * 1024 AS size_bytes,
               substr(sha256, 1, 2) || '/' || sha256 || '.pdf' AS storage_path,
               ['excel','csv','pdf_text','pdf_scan','image'][CAST(id % 5 + 1 AS INT)] AS kind,
               CASE letter WHEN 'F' THEN 'parsed' WHEN 'O' THEN 'resolved' ELSE
                 ['needs_review','flagged','ai_processing','pending','processing','failed',
                  'rejected'][CAST(id % 7 + 1 AS INT)] END AS status,
               TIMESTAMP '2001-08-01 00:00:00' - to_seconds(CAST(id % 1000 AS INT))
                 AS status_changed_at,
               CAST(id % 4 AS INT) AS attempts,
               CASE WHEN id % 20 = 3 THEN id - 3 END AS duplicate_of_id,
               CASE WHEN letter NOT IN ('F', 'O') AND id % 7 = 5 THEN 'The reader failed.' END
                 AS error,
               uploaded_at
        FROM file_base""",
    "receipt_cents": """
        SELECT *, CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 100 AS BIGINT) AS cents FROM orders""",
    "receipts": """
        SELECT o_orderkey AS id, o_orderkey // 2 AS file_id, o_orderkey // 2 * 2 AS run_id,
               CAST(o_orderkey % 2 + 1 AS INT) AS seq,
               'REF-2001-' || CASE WHEN o_orderkey // 2 < 1000000
                 THEN lpad(CAST(o_orderkey // 2 AS VARCHAR), 6, '0')
                 ELSE CAST(o_orderkey // 2 AS VARCHAR) END
                 || '-' || lpad(CAST(o_orderkey % 2 + 1 AS VARCHAR), 2, '0') AS ref_no,
               o_custkey AS vendor_id,
               CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS receipt_number,
               CAST(o_orderdate AS DATE) AS receipt_date,
               CASE WHEN o_orderkey % 6 <> 0 THEN CAST(CAST(cents - cents * 18 // 118
                 AS DECIMAL(14,0)) * 0.01 AS DECIMAL(12,2)) END AS subtotal,
               CASE WHEN o_orderkey % 6 <> 0 THEN CAST(CAST(cents * 18 // 118
                 + CASE WHEN o_orderkey % 13 = 0 THEN 500 ELSE 0 END
                 AS DECIMAL(14,0)) * 0.01 AS DECIMAL(12,2)) END AS tax,
               CAST(o_totalprice AS DECIMAL(12,2)) AS total,
               CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey % 5 + 1 END AS category_override_id,
               round((o_orderkey % 100) / 100.0, 2) AS confidence
        FROM receipt_cents""",
    "receipts_with_copies": """
        SELECT * FROM receipts UNION ALL
        SELECT id + 1000000000000, file_id + 1, run_id, 3,
               'REF-2001-' || CASE WHEN file_id + 1 < 1000000
                 THEN lpad(CAST(file_id + 1 AS VARCHAR), 6, '0')
                 ELSE CAST(file_id + 1 AS VARCHAR) END || '-03',
               vendor_id, receipt_number, receipt_date, subtotal, tax, total,
               category_override_id, confidence
        FROM receipts WHERE id % 20 = 5""",
    "line_items": """
        SELECT l_orderkey AS receipt_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
                 l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate) AS INT) AS position,
               'Part ' || l_partkey AS description,
               CAST(l_quantity AS DECIMAL(12,3)) AS quantity,
               CAST(l_extendedprice AS DECIMAL(14,4)) AS unit_price,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS amount
        FROM lineitem""",
    "item_sums": """
        SELECT l_orderkey AS id, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)))
                 AS DECIMAL(14,2)) AS items_total, count(*) AS n
        FROM lineitem GROUP BY 1""",
    "priced_base": """
        SELECT r.* EXCLUDE (subtotal, tax, total), s.items_total, coalesce(s.n, 0) AS items,
               CAST(coalesce(s.items_total, 100) * 100 AS BIGINT)
                 + CASE WHEN r.src % 5 = 0 THEN 75 WHEN r.src % 9 = 0 THEN 175 ELSE 0 END AS sub
        FROM (SELECT *, id % 1000000000000 AS src FROM receipts_with_copies) r
        LEFT JOIN item_sums s ON s.id = r.src""",
    "priced_receipts": """
        SELECT * EXCLUDE (sub, src),
               CASE WHEN src % 6 <> 0 THEN CAST(CAST(sub AS DECIMAL(14,0)) * 0.01
                 AS DECIMAL(12,2)) END AS subtotal,
               CASE WHEN src % 6 <> 0 THEN CAST(CAST(sub * 18 // 100 AS DECIMAL(14,0)) * 0.01
                 AS DECIMAL(12,2)) END AS tax,
               CAST(CAST(sub + sub * 18 // 100 + CASE WHEN src % 11 = 0 THEN 500 ELSE 0 END
                 AS DECIMAL(14,0)) * 0.01 AS DECIMAL(12,2)) AS total
        FROM priced_base""",
    "receipt_view": """
        SELECT r.id, r.ref_no, f.ref_no AS file_ref_no, f.status, r.receipt_date,
               v.normalized_name AS vendor, r.receipt_number,
               coalesce(r.category_override_id, v.default_category_id) AS category_id,
               c.name AS category, r.subtotal, r.tax, r.total
        FROM receipts r JOIN files f ON f.id = r.file_id JOIN vendors v ON v.id = r.vendor_id
        LEFT JOIN categories c
          ON c.id = coalesce(r.category_override_id, v.default_category_id)""",
    "flags": """
        SELECT o_orderkey * 2 AS id, o_orderkey // 2 AS file_id, o_orderkey AS receipt_id,
               ['validation_failed','duplicate_receipt','arithmetic_mismatch']
                 [CAST(o_orderkey % 3 + 1 AS INT)] AS type,
               CASE WHEN o_orderkey % 4 = 0 THEN 'error' ELSE 'warning' END AS severity,
               'Look at receipt ' || o_orderkey AS detail,
               (o_orderkey // 2) || ':' || (o_orderkey % 2 + 1) || ':check' AS dedupe_key,
               o_orderkey % 3 = 0 AS resolved,
               CASE WHEN o_orderkey % 3 = 0 THEN 'asha' END AS resolved_by,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS resolved_at
        FROM orders WHERE o_orderkey % 9 = 0 OR o_orderkey % 10 = 0""",
    "library_receipts": """
        SELECT r.id, r.file_id, r.seq, v.raw_name AS vendor, r.receipt_number, r.receipt_date,
               r.subtotal, r.tax, r.total
        FROM receipts r LEFT JOIN vendors v ON v.id = r.vendor_id""",
    "second_receipts": """
        SELECT id, file_id, seq, CASE WHEN id % 3 = 0 THEN upper(vendor)
                 WHEN id % 19 = 0 THEN 'Somebody Else' ELSE vendor END AS vendor,
               receipt_number, CASE WHEN id % 13 <> 0 THEN receipt_date END AS receipt_date,
               subtotal, tax,
               CAST(total + CASE WHEN id % 11 = 0 THEN 5 ELSE 0 END AS DECIMAL(12,2)) AS total
        FROM library_receipts""",
    "runs": """
        SELECT id * 2 AS id, id AS file_id, sha256, 'pdf_text' AS parser,
               CAST(NULL AS VARCHAR) AS provider, CAST(NULL AS VARCHAR) AS model,
               CAST(NULL AS VARCHAR) AS ai_approved_by, CAST(NULL AS TIMESTAMP) AS ai_approved_at,
               id % 3 <> 0 AS accepted, CAST(NULL AS VARCHAR) AS error,
               uploaded_at AS finished_at, uploaded_at AS created_at, true AS has_result,
               CAST(NULL AS BIGINT) AS cached_from_id
        FROM files UNION ALL
        SELECT id * 2 + 1, id, sha256, 'ai', CASE WHEN (id // 20) % 2 = 0 THEN 'openai' ELSE 'gemini' END,
               CASE WHEN id % 25 <> 0 THEN 'reader-1' END, CASE WHEN id % 30 <> 0 THEN 'asha' END,
               uploaded_at + to_hours(CAST(id % 24 AS INT)), id % 3 = 0,
               CASE WHEN id % 8 = 1 THEN 'The call failed.' END,
               CASE WHEN id % 9 <> 0 THEN uploaded_at END,
               TIMESTAMP '2001-08-01 00:00:00' - to_seconds(CAST(id % 1000 AS INT)),
               id % 8 <> 1 AND id % 9 <> 0, CASE WHEN id % 12 = 0 THEN id * 2 - 1 END
        FROM files WHERE id % 4 <> 2""",
    "vendor_labels": """
        SELECT DISTINCT 'trader ' || lpad(CAST(c_custkey % 100 AS VARCHAR), 3, '0') AS vendor_key,
               ['subtotal','tax','total'][CAST(c_custkey % 3 + 1 AS INT)] AS field,
               ['before gst','levy','to settle'][CAST(c_custkey % 3 + 1 AS INT)] || ' '
                 || (CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 20 ELSE c_custkey % 10 END) AS label
        FROM customer WHERE c_custkey % 100 < 40""",
}


def _needed(sql: str) -> list[str]:
    """The model tables a text names, and those they name in turn, in order of definition."""
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"[a-z_]+", todo.pop()))
        for name in words & TABLES.keys() - wanted:
            wanted.add(name)
            todo.append(TABLES[name])
    return [name for name in TABLES if name in wanted]


def with_model(sql: str) -> str:
    """The text with the model tables it names in front of it."""
    parts = [f"{name} AS ({TABLES[name]})" for name in _needed(sql)]
    body = sql.strip()
    if not parts:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body
