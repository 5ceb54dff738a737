"""Named queries: the receipt view, its filters, totals, orders, pages and export."""

from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from billmill.operators import search
from billmill.operators.search import ReceiptQuery
from billmill.plans.registry import query
from billmill.sources import bindings as b
from billmill.sources import sinks

COLUMNS = "receipt_date, vendor, receipt_number, category, subtotal, tax, total, ref_no, file_ref_no"
COUNTED = "status IN ('parsed', 'resolved')"
TOTALS = """count(*) AS receipts, CAST(coalesce(sum(total), 0) AS DECIMAL(18,2)) AS sum_total,
  CAST(round_even(CAST(sum(total) AS DOUBLE) / count(total), 2) AS DECIMAL(18,2)) AS average_total"""


def found(spark, d, **filters):
    return search.matching(b.receipt_view(spark, d), ReceiptQuery.of(**filters)).select(
        *search.ROW_COLUMNS
    )


def where(condition: str) -> str:
    return f"SELECT {COLUMNS} FROM receipt_view WHERE {COUNTED} AND {condition}"


@query("join1_receipt_files_vendors", """
    SELECT r.id, f.ref_no AS file_ref_no, f.status, v.normalized_name AS vendor, r.total
    FROM receipts r JOIN files f ON f.id = r.file_id JOIN vendors v ON v.id = r.vendor_id""")
def _(spark, d):
    f = b.files(spark, d).select(F.col("id").alias("file_id"), F.col("ref_no").alias("file_ref_no"),
                                 "status")
    v = b.vendors(spark, d).select(F.col("id").alias("vendor_id"),
                                   F.col("normalized_name").alias("vendor"))
    r = b.receipts(spark, d).select("id", "file_id", "vendor_id", "total")
    return r.join(f, "file_id").join(v, "vendor_id").select(
        "id", "file_ref_no", "status", "vendor", "total")


@query("join2_receipt_view", "SELECT * FROM receipt_view")
def _(spark, d):
    return b.receipt_view(spark, d)


@query("con1_effective_category", """
    SELECT r.id, coalesce(r.category_override_id, v.default_category_id) AS category_id
    FROM receipts r JOIN vendors v ON v.id = r.vendor_id""")
def _(spark, d):
    v = b.printed_vendors(spark, d).select(F.col("id").alias("vendor_id"), "default_category_id")
    r = b.receipts(spark, d).select("id", "vendor_id", "category_override_id")
    return r.join(v, "vendor_id").select(
        "id", F.coalesce("category_override_id", "default_category_id").alias("category_id"))


@query("pre1_output_columns", f"SELECT {COLUMNS} FROM receipt_view")
def _(spark, d):
    return b.receipt_view(spark, d).select(*search.ROW_COLUMNS)


@query("pre2_counted_statuses", where("true"))
def _(spark, d):
    return found(spark, d)


@query("pre3_date_range", where("receipt_date BETWEEN DATE '2000-04-01' AND DATE '2000-09-30'"))
def _(spark, d):
    return found(spark, d, date_from=date(2000, 4, 1), date_to=date(2000, 9, 30))


@query("pre3_open_range", where("receipt_date >= DATE '2001-01-01'"))
def _(spark, d):
    return found(spark, d, date_from=date(2001, 1, 1))


@query("pre4_default_dates",
       where("receipt_date BETWEEN DATE '2001-04-01' AND DATE '2001-08-01'"))
def _(spark, d):
    q = search.with_default_dates(ReceiptQuery(), b.TODAY)
    return search.matching(b.receipt_view(spark, d), q).select(*search.ROW_COLUMNS)


@query("pre5_exact_vendor", where("vendor = 'Trader 012'"))
def _(spark, d):
    return found(spark, d, vendor="Trader 012")


@query("pre6_exact_category", where("category_id = 2"))
def _(spark, d):
    return found(spark, d, category_id=2)


@query("pre7_total_range", where("total BETWEEN 1000.00 AND 90000.50"))
def _(spark, d):
    return found(spark, d, min_total=Decimal("1000.00"), max_total=Decimal("90000.50"))


@query("pre8_all_filters", where("""receipt_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'
    AND vendor = 'Trader 007' AND category_id = 3 AND total >= 500 AND total <= 400000"""))
def _(spark, d):
    return found(spark, d, date_from=date(1998, 1, 1), date_to=date(2000, 12, 31),
                 vendor="Trader 007", category_id=3, min_total=Decimal(500),
                 max_total=Decimal(400000))


@query("join3_vendors_with_receipts", """
    SELECT DISTINCT normalized_name AS vendor FROM vendors v
    WHERE EXISTS (SELECT 1 FROM receipts r WHERE r.vendor_id = v.id)""")
def _(spark, d):
    return search.vendor_names(b.receipts(spark, d), b.vendors(spark, d))


@query("sort7_vendor_names", """
    SELECT DISTINCT normalized_name AS vendor FROM vendors v
    WHERE EXISTS (SELECT 1 FROM receipts r WHERE r.vendor_id = v.id) ORDER BY vendor""")
def _(spark, d):
    return search.vendor_names(b.receipts(spark, d), b.vendors(spark, d)).orderBy("vendor")


@query("sort1_oldest_first",
       where("category_id = 1") + " ORDER BY receipt_date, ref_no LIMIT 500")
def _(spark, d):
    q = ReceiptQuery(category_id=1, limit=500)
    return search.limited(b.receipt_view(spark, d), q).select(*search.ROW_COLUMNS)


@query("sort2_largest_first",
       where("receipt_date >= DATE '2000-04-01'")
       + " ORDER BY total DESC, receipt_date, ref_no LIMIT 25")
def _(spark, d):
    q = ReceiptQuery(date_from=date(2000, 4, 1), sort="amount", limit=25)
    return search.limited(b.receipt_view(spark, d), q).select(*search.ROW_COLUMNS)


@query("sort3_third_page",
       where("category_id = 2") + " ORDER BY receipt_date, ref_no LIMIT 50 OFFSET 100")
def _(spark, d):
    return search.page(b.receipt_view(spark, d), ReceiptQuery(category_id=2, page=3))


@query("sort3_page_after_a_row",
       where("category_id = 2 AND (receipt_date, ref_no) > (DATE '1996-02-10', 'REF-2001-000100-01')")
       + " ORDER BY receipt_date, ref_no LIMIT 50")
def _(spark, d):
    return search.page_after(
        b.receipt_view(spark, d), ReceiptQuery(category_id=2), (date(1996, 2, 10), "REF-2001-000100-01"))


@query("sort3_page_after_an_amount",
       where("total < 150000 OR total = 150000 AND (receipt_date, ref_no) > (DATE '1996-02-10', 'REF-2001-000100-01')")
       + " ORDER BY total DESC, receipt_date, ref_no LIMIT 30")
def _(spark, d):
    last = (150_000, date(1996, 2, 10), "REF-2001-000100-01")
    return search.page_after(b.receipt_view(spark, d), ReceiptQuery(sort="amount", limit=70), last, shown=40)


@query("sort3_last_page_of_a_top",
       where("true") + " ORDER BY total DESC, receipt_date, ref_no LIMIT 20 OFFSET 50")
def _(spark, d):
    return search.page(b.receipt_view(spark, d), ReceiptQuery(sort="amount", limit=70, page=2))


@query("agg1_totals", f"""SELECT {TOTALS} FROM receipt_view
    WHERE {COUNTED} AND category_id = 2 AND receipt_date >= DATE '2000-04-01'""")
def _(spark, d):
    q = ReceiptQuery(category_id=2, date_from=date(2000, 4, 1))
    return search.totals(search.limited(b.receipt_view(spark, d), q))


@query("agg1_totals_of_a_top", f"""SELECT {TOTALS} FROM (SELECT total FROM receipt_view
    WHERE {COUNTED} ORDER BY total DESC, receipt_date, ref_no LIMIT 5)""")
def _(spark, d):
    q = ReceiptQuery(sort="amount", limit=5)
    return search.totals(search.limited(b.receipt_view(spark, d), q))


@query("agg1_totals_of_nothing", f"""SELECT {TOTALS} FROM receipt_view
    WHERE {COUNTED} AND vendor = 'Nobody'""")
def _(spark, d):
    return search.totals(search.limited(b.receipt_view(spark, d), ReceiptQuery(vendor="Nobody")))


@query("pre13_waiting_files", """SELECT count(*) AS waiting_for_review FROM files
    WHERE status IN ('needs_review', 'flagged', 'ai_processing')""")
def _(spark, d):
    return search.waiting_for_review(b.files(spark, d))


@query("job1_search_page", f"""
    SELECT t.*, w.waiting_for_review, r.* FROM
    (SELECT {TOTALS} FROM receipt_view WHERE {COUNTED} AND category_id = 2) t,
    (SELECT count(*) AS waiting_for_review FROM files
     WHERE status IN ('needs_review', 'flagged', 'ai_processing')) w,
    (SELECT ref_no, receipt_date, vendor, total FROM receipt_view
     WHERE {COUNTED} AND category_id = 2
     ORDER BY receipt_date, ref_no LIMIT 50) r""")
def _(spark, d):
    page = search.search(b.receipt_view(spark, d), b.files(spark, d), ReceiptQuery(category_id=2))
    row = F.explode("rows").alias("r")
    return page.select("receipts", "sum_total", "average_total", "waiting_for_review", row).select(
        "receipts", "sum_total", "average_total", "waiting_for_review",
        "r.ref_no", "r.receipt_date", "r.vendor", "r.total")


@query("src13_csv_export", f"""
    SELECT CAST(receipt_date AS VARCHAR) AS "Date", vendor AS "Vendor",
      coalesce(receipt_number, '') AS "Receipt no.", coalesce(category, '') AS "Category",
      coalesce(CAST(subtotal AS VARCHAR), '') AS "Subtotal", coalesce(CAST(tax AS VARCHAR), '') AS "Tax",
      CAST(total AS VARCHAR) AS "Total", ref_no AS "Reference", file_ref_no AS "File"
    FROM receipt_view WHERE {COUNTED} AND receipt_date >= DATE '2000-04-01'""")
def _(spark, d):
    return sinks.csv_rows(b.receipt_view(spark, d), ReceiptQuery(date_from=date(2000, 4, 1)))
