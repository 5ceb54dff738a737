"""Named queries: the column functions over the test tables."""

from pyspark.sql import functions as F

from billmill.functions import dates, labels, money, sqlnames, text
from billmill.plans.registry import query
from billmill.sources import bindings as b
from billmill.sources import printed

SPACES = r"'[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'"


def docs(spark, d):
    return b.table(spark, d, "documents").select("doc_id", "text")


def orders(spark, d, *columns):
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), *columns)


@query("str1_clean_text", f"SELECT doc_id, nullif(trim(regexp_replace(text, {SPACES}, ' ', 'g')), '') AS text FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query("str1_clean_pages", f"SELECT page_id, nullif(trim(regexp_replace(html, {SPACES}, ' ', 'g')), '') AS html FROM pages")
def _(spark, d):
    return b.table(spark, d, "pages").select("page_id", text.clean_text(F.col("html")).alias("html"))


@query("str2_clean_vendor", f"""SELECT doc_id, nullif(substr(trim(trim(regexp_replace(text, {SPACES}, ' ', 'g')), ' :,-|*'), 1, 255), '') AS vendor
    FROM documents""")
def _(spark, d):
    return docs(spark, d).select("doc_id", text.clean_vendor(F.col("text")).alias("vendor"))


@query("str3_receipt_numbers", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ST/' || o_orderkey
    WHEN 2 THEN CAST(o_orderkey AS VARCHAR) ELSE 'No ' || o_orderkey END AS number FROM orders""")
def _(spark, d):
    n, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    raw = (F.when(n % 4 == 0, F.lit("Amount :")).when(n % 4 == 1, F.concat(F.lit(" # ST/"), key, F.lit(". ")))
           .when(n % 4 == 2, F.concat(key, F.lit(".0"))).otherwise(F.concat(F.lit("No   "), key, F.lit("-"))))
    return orders(spark, d, text.clean_receipt_number(raw, n % 4 == 2).alias("number"))


@query("str4_normalize_label", r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[.:]+', ' ', 'g'),
    '[\s\x0b]+', ' ', 'g'), ' -#()[]*') AS label FROM conversations""")
def _(spark, d):
    return b.table(spark, d, "conversations").select(
        "conv_id", "turn", text.normalize_label(F.col("text")).alias("label"))


@query("str5_document_titles", "SELECT o_orderkey AS id, o_orderkey % 4 < 2 AS title FROM orders")
def _(spark, d):
    words = F.array(F.lit("TAX INVOICE"), F.lit(" Cash  Memo:"), F.lit("Invoice No"), F.lit("Bills"))
    return orders(spark, d, text.is_document_title(
        F.element_at(words, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("title"))


@query("str7_tidy_ocr", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Grand Total INR ' || o_orderkey || '.00'
    WHEN 1 THEN strftime(o_orderdate, '%d %b %Y') || ' 18:42' ELSE 'Invoice No INV' || o_orderkey END AS line FROM orders""")
def _(spark, d):
    n, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    raw = (F.when(n % 3 == 0, F.concat(F.lit("Grand TotalINR "), key, F.lit(".00")))
           .when(n % 3 == 1, F.concat(F.date_format("o_orderdate", "dd MMM yyyy"), F.lit("18:42")))
           .otherwise(F.concat(F.lit("Invoice No INV"), key)))
    return orders(spark, d, text.tidy_ocr(raw).alias("line"))


@query("str11_display_names", r"""SELECT doc_id, CASE WHEN problem IS NULL THEN CASE WHEN length(name) > 255
      THEN substr(name, 1, 251) || '.pdf' ELSE name END END AS name, problem FROM (SELECT doc_id, name,
      CASE WHEN regexp_matches(name, '[/\\\\]') THEN 'File names cannot contain / or \.'
        WHEN regexp_matches(name, '[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]') THEN 'File names cannot contain control characters.' END AS problem
    FROM (SELECT doc_id, regexp_replace(nfc_normalize(text || '.pdf'), '^[\s\x0b\x{a0}]+', '') AS name FROM documents))""")
def _(spark, d):
    raw = F.concat("text", F.lit(".pdf"))
    rows = docs(spark, d).select("doc_id", text.composed(raw).alias("name"))
    problem = text.name_problem(F.col("name"))
    return rows.select("doc_id", F.when(problem.isNull(), text.cut_name(F.col("name"))).alias("name"),
                       problem.alias("problem"))


@query("str12_extensions", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'xlsx' END AS ext FROM orders""")
def _(spark, d):
    names = F.array(F.lit("a.b.PDF"), F.lit("scan.Xlsx"), F.lit("virus.exe"), F.lit("no extension"))
    return orders(spark, d, text.extension_of(F.element_at(names, (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("ext"))


INDIAN = """CASE WHEN length(w) <= 3 THEN w WHEN length(w) <= 5 THEN left(w, length(w) - 3) || ',' || right(w, 3)
    WHEN length(w) <= 7 THEN left(w, length(w) - 5) || ',' || substr(w, length(w) - 4, 2) || ',' || right(w, 3)
    ELSE left(w, length(w) - 7) || ',' || substr(w, length(w) - 6, 2) || ',' || substr(w, length(w) - 4, 2) || ',' || right(w, 3) END"""


@query("str13_indian_grouping", f"""SELECT id, '₹' || {INDIAN} || '.' || lpad(CAST(c AS VARCHAR), 2, '0') AS amount FROM (
    SELECT o_orderkey AS id, CAST(CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 100 AS BIGINT) * (o_orderkey % 50) // 100 AS VARCHAR) AS w,
      CAST(CAST(o_totalprice AS DECIMAL(14,2)) * 100 AS BIGINT) * (o_orderkey % 50) % 100 AS c FROM orders)""")
def _(spark, d):
    amount = F.col("o_totalprice").cast("decimal(14,2)") * (F.col("o_orderkey") % 50).cast("decimal(4,0)")
    return orders(spark, d, money.rupees(amount).alias("amount"))


@query("str14_western_grouping", """SELECT o_orderkey AS id, '₹' || format('{:,}', CAST(floor(CAST(o_totalprice AS DECIMAL(12,2))) AS BIGINT)) || '.'
    || lpad(CAST(CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0') AS amount FROM orders""")
def _(spark, d):
    return orders(spark, d, money.rupees_western(F.col("o_totalprice").cast("decimal(12,2)")).alias("amount"))


@query("str15_safe_cells", r"""SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+\-@\t\r]') THEN '''' || t ELSE t END AS cell FROM (
    SELECT doc_id, ['=', '+', '-', '@', '', 'x'][CAST(doc_id % 6 + 1 AS INT)] || text AS t FROM documents)""")
def _(spark, d):
    head = F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "", "x")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs(spark, d).select("doc_id", text.safe_cell(F.concat(head, "text")).alias("cell"))


@query("num1_parse_amounts", """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 4 THEN -CAST(o_totalprice AS DECIMAL(12,2))
    WHEN 5 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS amount FROM orders""")
def _(spark, d):
    total = F.col("o_totalprice").cast("decimal(12,2)")
    n = F.col("o_orderkey") % 6
    raw = (F.when(n == 0, money.rupees(total)).when(n == 1, F.concat(F.lit("Rs. "), F.format_number(total, 2), F.lit("/-")))
           .when(n == 2, F.concat(total.cast("string"), F.lit(" INR"))).when(n == 3, total.cast("string"))
           .when(n == 4, F.concat(F.lit("("), F.format_number(total, 2), F.lit(")")))
           .otherwise(F.concat(F.lit("about "), total.cast("string"))))
    return orders(spark, d, money.parse_amount(raw).alias("amount"))


@query("num2_quantities", """SELECT l_orderkey AS id, l_linenumber, l_partkey, CAST(l_quantity AS DECIMAL(12,3)) AS quantity FROM lineitem""")
def _(spark, d):
    raw = F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit(" L"))
    return b.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), "l_linenumber", "l_partkey", money.parse_quantity(raw).alias("quantity"))


@query("dat1_printed_dates", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def _(spark, d):
    n = F.col("o_orderkey") % 6
    form = lambda f: F.date_format("o_orderdate", f)
    raw = (F.when(n == 0, F.concat(F.lit("Dt "), form("dd/MM/yyyy"), F.lit(" or 2099-01-01")))
           .when(n == 1, F.concat(F.lit("99/99/1999 "), form("yyyy-MM-dd"))).when(n == 2, form("d MMM yyyy"))
           .when(n == 3, form("MMMM d, yyyy")).when(n == 4, form("dd-MMM-yyyy HH:mm")).otherwise(F.lit("31/02/2001")))
    return orders(spark, d, dates.find_date(raw).alias("day"))


@query("dat2_cell_dates", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders")
def _(spark, d):
    cell = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return orders(spark, d, dates.parse_date(cell).alias("day"))


@query("arr3_joined_words", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'date and total' ELSE 'vendor, date and total' END AS words FROM orders""")
def _(spark, d):
    n = F.col("o_orderkey") % 3
    words = (F.when(n == 0, F.array(F.lit("date"))).when(n == 1, F.array(F.lit("date"), F.lit("total")))
             .otherwise(F.array(F.lit("vendor"), F.lit("date"), F.lit("total"))))
    return orders(spark, d, text.join_words(words).alias("words"))


@query("udf1_functions_in_sql", """SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(12,2)) AS amount, CAST(o_orderdate AS DATE) AS day,
    'B-' || o_orderkey AS number FROM orders""")
def _(spark, d):
    n = F.col("o_orderkey").cast("string")
    raw = orders(spark, d, money.rupees(F.col("o_totalprice").cast("decimal(12,2)")).alias("a"),
                 F.date_format("o_orderdate", "d MMM yyyy").alias("b"), F.concat(F.lit(" B-"), n).alias("c"))
    return sqlnames.with_parsers(raw, {"amount": ("total", "a"), "day": ("receipt_date", "b"), "number": ("receipt_number", "c")}).select(
        "id", "amount", "day", "number")


@query("udf1_parsers_in_sql_text", """SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
    CAST(o_orderdate AS DATE) AS day, 'B-' || o_orderkey AS number, o_clerk AS vendor,
    make_date(CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS BIGINT), 4, 1) AS starts
    FROM (SELECT *, 'Clerk ' || o_custkey AS o_clerk FROM orders)""")
def _(spark, d):
    sqlnames.register_sql_functions(spark)
    n = F.col("o_orderkey").cast("string")
    form = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "d MMM yyyy")).otherwise(
        F.date_format("o_orderdate", "'Dated' dd/MM/yyyy"))
    raw = orders(spark, d, money.rupees(F.col("o_totalprice").cast("decimal(12,2)")).alias("a"),
                 form.alias("b"), F.concat(F.lit(" B-"), n).alias("c"),
                 F.concat(F.lit(" Clerk  "), F.col("o_custkey").cast("string"), F.lit(" ,")).alias("e"))
    return raw.selectExpr("id", "parse_amount(a) AS amount", "parse_date(b) AS day", "clean_receipt_number(c) AS number",
                          "clean_vendor(e) AS vendor", "fy_start(parse_date(b)) AS starts")


@query("udf5_weighted_mean", """SELECT o_custkey AS custkey, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(12,2)) * (o_orderkey % 7 + 1))
    / sum(o_orderkey % 7 + 1)) AS BIGINT) AS mean FROM orders GROUP BY 1""")
def _(spark, d):
    weight = (F.col("o_orderkey") % 7 + 1).cast("decimal(3,0)")
    mean = F.sum(F.col("o_totalprice").cast("decimal(12,2)") * weight) / F.sum(weight)
    return b.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.floor(mean).cast("bigint").alias("mean"))


@query("labels_of_all_lines", """SELECT field, count(*) AS lines FROM (SELECT unnest(CASE WHEN id % 6 <> 0
      THEN ['receipt_number', 'subtotal', 'tax_part', 'total', 'total', '', '', '', '']
      ELSE ['receipt_number', 'total', 'total', '', '', '', ''] END) AS f, id FROM receipts
    UNION ALL SELECT 'tax', id FROM receipts WHERE id % 3 = 0
    UNION ALL SELECT '', id FROM receipts WHERE id % 3 = 1), LATERAL (SELECT nullif(f, '') AS field) GROUP BY 1""")
def _(spark, d):
    return printed.lines(spark, d).groupBy(labels.label_field(F.col("text")).alias("field")).agg(F.count("*").alias("lines"))
