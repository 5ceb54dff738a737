"""Named queries: printed lines and cells read back, against the values they were made of."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from billmill.functions import dates, labels, money, text
from billmill.operators import grid, pages, words
from billmill.plans.registry import query
from billmill.sources import bindings as b
from billmill.sources import landing, printed

FIELDS = "vendor, receipt_number, receipt_date, subtotal, tax, total"
KNOWN = """(SELECT r.id, r.file_id, r.seq, v.raw_name AS vendor, r.receipt_date, r.subtotal, r.tax,
    r.total, CAST(CAST(CAST(r.tax * 100 AS BIGINT) // 2 AS DECIMAL(14,0)) * 0.01 AS DECIMAL(12,2))
      AS cgst FROM receipts r LEFT JOIN named_vendors v ON v.id = r.vendor_id)"""

# A total as printed: groups of two digits above the thousands.
WHOLE = "CAST(floor(total) AS BIGINT)"
RUPEES = f"""(CASE WHEN total < 100000 THEN format('{{:,}}', {WHOLE}) ELSE ({WHOLE} // 100000) || ','
      || lpad(CAST(({WHOLE} // 1000) % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST({WHOLE} % 1000 AS VARCHAR), 3, '0') END
    || '.' || lpad(CAST(CAST(total * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0'))"""
SGST = "CAST(tax - cgst AS DECIMAL(12,2))"
WITH_NAMES = f"""(SELECT k.*, p.printed FROM {KNOWN} k JOIN receipts r ON r.id = k.id
      LEFT JOIN printed_vendors p ON p.id = r.vendor_id)"""
# Every line that is printed.
PRINTED = f"""(SELECT * FROM (SELECT CAST(file_id AS VARCHAR) AS file_id, seq AS page, line_no, cgst, {SGST} AS sgst, subtotal, total, printed,
      CASE line_no WHEN 0 THEN CASE id % 3 WHEN 0 THEN 'TAX INVOICE' WHEN 1 THEN 'Cash Memo' END WHEN 1 THEN printed
        WHEN 2 THEN 'GSTIN: 27ABCDE1234F1Z5' WHEN 3 THEN 'Invoice No: INV/' || id
        WHEN 4 THEN 'Order Date 01/01/1990 Invoice Date: ' || strftime(receipt_date, '%d/%m/%Y')
        WHEN 5 THEN 'Sub Total  ' || subtotal WHEN 6 THEN 'CGST @ 9% ' || cgst || ' SGST @ 9 %: ' || {SGST}
        WHEN 7 THEN 'Thank you! Visit again.' WHEN 8 THEN 'Grand Total Rs. ' || {RUPEES} ELSE 'Total 2 items 1.00' END AS text
    FROM {WITH_NAMES}, (SELECT CAST(unnest(range(10)) AS INT) AS line_no)) WHERE text IS NOT NULL)"""


@query("job6_page_receipts", f"""SELECT CAST(file_id AS VARCHAR) AS file_id, seq AS first_page,
      seq AS last_page, 'page ' || seq AS source, vendor, 'INV/' || id AS receipt_number,
      receipt_date, subtotal, tax, total, 0.85 AS confidence FROM {KNOWN}""")
def _(spark, d):
    return pages.read_receipts(printed.lines(spark, d)).select(
        "file_id", F.col("first_page").cast("int").alias("first_page"),
        F.col("last_page").cast("int").alias("last_page"), "source", "vendor", "receipt_number",
        "receipt_date", "subtotal", "tax", "total",
        F.col("confidence").cast("decimal(3,2)").alias("confidence"))


@query("job5_sheet_receipts", f"""SELECT CAST(id AS VARCHAR) AS file_id, vendor,
      'B-' || id AS receipt_number, receipt_date, subtotal, tax, total, 2 AS items,
      total AS first_amount, 1.0 AS confidence, 'sheet: Bill' AS source FROM {KNOWN}""")
def _(spark, d):
    return grid.read_receipts(printed.cells(spark, d)).select(
        "file_id", "vendor", "receipt_number", "receipt_date", "subtotal", "tax", "total", "items",
        F.get("line_items", F.lit(0))["amount"].alias("first_amount"),
        F.col("confidence").cast("decimal(2,1)").alias("confidence"), "source")


@query("win4_page_groups", """SELECT CAST(file_id AS VARCHAR) AS file_id, seq AS page,
      row_number() OVER (PARTITION BY file_id ORDER BY seq) AS group_no FROM receipts""")
def _(spark, d):
    return pages.group_pages(pages.pages_of(pages.read_lines(printed.lines(spark, d)))).select(
        "file_id", F.col("page").cast("int").alias("page"), "group_no")


@query("win5_sheet_items", f"""SELECT CAST(id AS VARCHAR) AS file_id, 6 AS header_row, 9 AS last_row,
      2 AS items, total AS first_amount, 0.50 AS second_amount FROM {KNOWN}""")
def _(spark, d):
    found = grid.find_items(grid.read_cells(printed.cells(spark, d)))
    amount = lambda i: F.get("line_items", F.lit(i))["amount"]
    return found.select("file_id", "header_row", "last_row", F.size("line_items").alias("items"),
                        amount(0).alias("first_amount"), amount(1).alias("second_amount"))


@query("win6_text_tables", """
    SELECT CAST(receipt_id AS VARCHAR) AS file_id, 'B-' || receipt_id AS receipt_number,
      count(*) AS items, CAST(sum(amount) AS DECIMAL(12,2)) AS subtotal, 1.50 AS tax,
      CAST(sum(amount) AS DECIMAL(12,2)) AS total,
      min_by(description, position) AS first_item, min_by(CAST(floor(quantity) AS INT), position) AS quantity
    FROM line_items GROUP BY receipt_id""")
def _(spark, d):
    read = pages.read_receipts(printed.item_lines(spark, d))
    first = F.get("line_items", F.lit(0))
    return read.select("file_id", "receipt_number", F.col("items").cast("bigint").alias("items"),
                       "subtotal", "tax", "total", first["description"].alias("first_item"),
                       first["quantity"].cast("int").alias("quantity"))


@query("arr1_trailing_numbers", """SELECT CAST(receipt_id AS VARCHAR) AS file_id, position,
      description AS before, amount AS last_amount, 4 AS numbers
    FROM line_items""")
def _(spark, d):
    columns = F.array(*[F.lit(x) for x in ("quantity", "taxable", "tax", "amount")])
    rows = printed.item_lines(spark, d).filter("line_no > 10 AND NOT startswith(text, 'Total ')")
    row = pages._row_values(F.col("text"), columns)
    return rows.withColumn("row", row).select(
        "file_id", (F.col("line_no") - 10).alias("position"), F.col("row.before").alias("before"),
        money.parse_amount(F.element_at("row.cells", -1)["token"]).alias("last_amount"),
        F.size("row.cells").alias("numbers"))


@query("arr2_sum_of_tokens", f"""SELECT id, CASE WHEN id % 4 <> 0 THEN CAST(tax + total AS DECIMAL(12,2)) END AS total
    FROM {KNOWN}""")
def _(spark, d):
    odd = F.when(F.col("id") % 4 == 0, F.lit("n/a")).otherwise(F.col("total").cast("string"))
    tokens = F.array(F.col("cgst").cast("string"), F.col("sgst").cast("string"), odd)
    return printed.known(spark, d).select("id", money.sum_tokens(tokens).alias("total"))


@query("join13_line_labels", f"""
    SELECT CAST(file_id AS VARCHAR) AS file_id, seq AS page, x.line_no, x.field, x.label FROM {KNOWN},
    (VALUES (3, 'receipt_number', 'invoice no', true), (5, 'subtotal', 'sub total', false),
      (6, 'tax_part', 'cgst', false), (8, 'total', 'grand total', true), (9, 'total', 'total', true))
      AS x(line_no, field, label, always) WHERE always OR tax IS NOT NULL""")
def _(spark, d):
    return pages.label_lines(printed.lines(spark, d)).select(
        "file_id", F.col("page").cast("int").alias("page"), "line_no", "label.field", "label.label")


def amounts_of_pages(spark, d):
    """Pages with the labelled amounts of all their lines."""
    paged = pages.pages_of(pages.read_lines(printed.lines(spark, d)))
    amounts = F.flatten(F.array_compact(F.transform("lines", lambda x: x["amounts"])))
    return paged.select("file_id", F.col("page").cast("int").alias("page"), amounts.alias("amounts"))


@query("win3_strongest_label", f"""SELECT CAST(file_id AS VARCHAR) AS file_id, seq AS page,
      total FROM {KNOWN}""")
def _(spark, d):
    # Grand Total beats the plain Total printed after it.
    return amounts_of_pages(spark, d).select("file_id", "page", pages.strongest(F.col("amounts"), "total").alias("total"))


@query("agg6_tax_from_parts", f"SELECT CAST(file_id AS VARCHAR) AS file_id, seq AS page, tax FROM {KNOWN}")
def _(spark, d):
    return amounts_of_pages(spark, d).select("file_id", "page", pages.tax_parts(F.col("amounts")).alias("tax"))


@query("str6_split_lines", f"""SELECT file_id, page, line_no, CASE line_no WHEN 6 THEN 2 ELSE 1 END AS parts,
      CASE line_no WHEN 6 THEN 'CGST @ 9% ' || cgst ELSE text END AS first_part,
      CASE line_no WHEN 6 THEN 'SGST @ 9 %: ' || sgst ELSE text END AS last_part FROM {PRINTED}""")
def _(spark, d):
    rows = printed.lines(spark, d).withColumn("parts", labels.split_labelled(F.col("text")))
    return rows.select("file_id", F.col("page").cast("int").alias("page"), "line_no", F.size("parts").alias("parts"),
                       F.get("parts", F.lit(0)).alias("first_part"), F.element_at("parts", -1).alias("last_part"))


@query("num3_amounts_in_lines", f"""SELECT file_id, page, line_no, CASE WHEN line_no IN (6, 9) THEN 2
        WHEN line_no IN (1, 2, 5, 8) THEN 1 ELSE 0 END AS amounts,
      CAST(CASE line_no WHEN 1 THEN CAST(regexp_extract(printed, '[0-9]+') AS DECIMAL(12,2)) WHEN 2 THEN 27 WHEN 5 THEN subtotal
        WHEN 6 THEN cgst WHEN 8 THEN total WHEN 9 THEN 2 END AS DECIMAL(12,2)) AS first_amount,
      CAST(CASE line_no WHEN 1 THEN CAST(regexp_extract(printed, '[0-9]+') AS DECIMAL(12,2)) WHEN 2 THEN 27 WHEN 5 THEN subtotal
        WHEN 6 THEN sgst WHEN 8 THEN total WHEN 9 THEN 1 END AS DECIMAL(12,2)) AS last_amount FROM {PRINTED}""")
def _(spark, d):
    rows = printed.lines(spark, d).withColumn("found", money.amounts_in(F.col("text")))
    return rows.select("file_id", F.col("page").cast("int").alias("page"), "line_no", F.size("found").alias("amounts"),
                       F.get("found", F.lit(0)).alias("first_amount"),
                       F.try_element_at("found", F.lit(-1)).alias("last_amount"))


@query("num3_amounts_in_documents")
def _(spark, d):
    rows = b.table(spark, d, "documents")
    return rows.select("doc_id", F.size(money.amounts_in(F.col("text"))).alias("amounts"))


@query("win8_date_by_label", f"SELECT CAST(file_id AS VARCHAR) AS file_id, seq AS page, receipt_date FROM {KNOWN}")
def _(spark, d):
    whole = F.array_join(F.transform("lines", lambda x: x["text"]), "\n")
    paged = pages.pages_of(pages.read_lines(printed.lines(spark, d)))
    found = paged.withColumn("at", pages.date_text(whole))
    return found.select("file_id", F.col("page").cast("int").alias("page"),
                        dates.find_date(F.col("at")).alias("receipt_date"))


@query("win9_fallback_vendor", f"SELECT CAST(file_id AS VARCHAR) AS file_id, seq AS page, vendor FROM {KNOWN}")
def _(spark, d):
    paged = pages.pages_of(pages.read_lines(printed.lines(spark, d)))
    return paged.select("file_id", F.col("page").cast("int").alias("page"),
                        pages.vendor_of(F.col("lines")).alias("vendor"))


@query("str20_number_anywhere", f"SELECT CAST(file_id AS VARCHAR) AS file_id, seq AS page, 'INV/' || id AS receipt_number FROM {KNOWN}")
def _(spark, d):
    rows = printed.lines(spark, d).withColumn("n", labels.number_in(F.col("text")))
    return rows.filter("n IS NOT NULL").select(
        "file_id", F.col("page").cast("int").alias("page"),
        text.clean_receipt_number(F.col("n")).alias("receipt_number"))


@query("str19_source_text", """SELECT CAST(file_id AS VARCHAR) AS file_id,
      CASE WHEN min(seq) = max(seq) THEN 'page ' || min(seq) ELSE 'pages ' || min(seq) || '-' || max(seq) END
      AS source FROM receipts GROUP BY file_id""")
def _(spark, d):
    rows = printed.lines(spark, d).groupBy("file_id").agg(
        F.min("page").alias("a"), F.max("page").alias("b"))
    return rows.select("file_id", text.source_text(F.col("a"), F.col("b")).alias("source"))


@query("join14_values_of_labels", f"""
    SELECT CAST(id AS VARCHAR) AS file_id, x.label, CASE x.label WHEN 'tax' THEN 'INVOICE' WHEN 'net payable' THEN CAST(total AS VARCHAR)
        WHEN 'cgst' THEN '@ 9%' WHEN 'sgst' THEN '@ 9%' ELSE '' END AS rest,
      CASE x.label WHEN 'tax' THEN trim(regexp_replace(printed, '\\s+', ' ', 'g')) WHEN 'bill no' THEN 'B-' || id
        WHEN 'date' THEN strftime(receipt_date, '%d-%b-%Y') WHEN 'taxable value' THEN '₹ ' || subtotal
        WHEN 'cgst' THEN CAST(cgst AS VARCHAR) WHEN 'sgst' THEN CAST({SGST} AS VARCHAR) WHEN 'total' THEN '7' END AS value
    FROM {WITH_NAMES}, (VALUES ('tax'), ('bill no'), ('date'), ('taxable value'), ('cgst'), ('sgst'), ('total'), ('net payable')) AS x(label)""")
def _(spark, d):
    near = grid.with_neighbours(grid.read_cells(printed.cells(spark, d))).filter("label IS NOT NULL")
    return near.select("file_id", "label.label", "label.rest", F.col("beside.text").alias("value"))


@query("join22_header_columns", f"""SELECT CAST(id AS VARCHAR) AS file_id, x.row, x.col, x.name FROM {KNOWN},
    (VALUES (6, 0, 'description'), (6, 1, 'quantity'), (6, 3, 'amount'), (14, 0, 'amount')) AS x(row, col, name)""")
def _(spark, d):
    cells = printed.cells(spark, d).withColumn("name", labels.header_column(F.col("value")))
    return cells.filter("name IS NOT NULL").select("file_id", "row", "col", "name")


@query("num6_field_confidence", f"""SELECT id, CAST(CAST(0.2 + 0.2 + CASE WHEN id % 5 = 0 THEN 0 ELSE 0.3 END
      + CASE WHEN id % 7 = 0 THEN 0 ELSE 0.15 END + CASE WHEN id % 2 = 0 THEN 0.15 ELSE 0 END AS DOUBLE)
      AS DECIMAL(4,3)) AS confidence FROM {KNOWN}""")
def _(spark, d):
    rows = printed.known(spark, d)
    total = F.when(F.col("id") % 5 == 0, F.lit(0)).otherwise(F.col("total"))
    items = F.when(F.col("id") % 2 == 0, 3).otherwise(0)
    sure = money.confidence_of(F.col("printed"), F.col("receipt_date"), total,
                               F.col("receipt_number"), items)
    return rows.select("id", sure.cast("decimal(4,3)").alias("confidence"))


# --- delimited text --------------------------------------------------------------------------


def csv_files(spark, d):
    """Each order's receipt as delimited text; the delimiter depends on the order."""
    n = F.col("id")
    sep = F.element_at(F.array(F.lit(","), F.lit(";"), F.lit("\t"), F.lit("|")), (n % 4 + 1).cast("int"))
    join = lambda *parts: F.array_join(F.array(*parts), "\x1f")
    amount = F.concat(F.lit('"'), F.format_number("total", 2), F.lit('"'))
    rows = F.array_join(F.array(
        join(F.lit("Shop"), F.trim(F.regexp_replace("printed", ",", ""))),
        join(F.lit("Bill No"), F.concat(F.lit("C-"), n.cast("string"))),
        join(F.lit("Date"), F.date_format("receipt_date", "yyyy-MM-dd")),
        join(F.lit("Note"), F.lit('"say ""hi"", twice"')),
        join(F.lit(""), F.lit(""), F.lit("")),
        join(F.lit("Item"), F.lit("Amount")),
        join(F.lit("Goods"), amount),
        F.lit(""),
        join(F.lit("Total"), amount, F.lit("")),
        F.lit(""),
    ), "\r\n")
    body = F.translate(rows, "\x1f", "\x1f")
    return printed.known(spark, d).select(
        n.cast("string").alias("file_id"), sep.alias("sep"),
        F.replace(body, F.lit("\x1f"), sep).alias("text"))


@query("src5_delimiters", """SELECT CAST(o_orderkey AS VARCHAR) AS file_id,
    [',', ';', chr(9), '|'][CAST(o_orderkey % 4 + 1 AS INT)] AS delimiter FROM orders""")
def _(spark, d):
    return csv_files(spark, d).select("file_id", landing.pick_delimiter(F.col("text")).alias("delimiter"))


@query("src4_looks_like_csv", """SELECT doc_id, (SELECT count(*) FROM
      (SELECT unnest(regexp_split_to_array(t, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'))
        AS line) WHERE regexp_matches(line, '[^\\s\\x0b]')) AS lines,
    (SELECT count(*) FROM (SELECT unnest(regexp_split_to_array(t,
        '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')) AS line)
      WHERE regexp_matches(line, '[^\\s\\x0b]') AND regexp_matches(line, '[,;\\t|]')) AS marked
    FROM (SELECT doc_id, text AS t FROM documents)""")
def _(spark, d):
    docs = b.table(spark, d, "documents")
    lines = landing.lines_of(F.col("text"))
    marked = F.size(F.filter(lines, lambda x: x.rlike(r"[,;\t|]")))
    return docs.select("doc_id", F.size(lines).cast("bigint").alias("lines"),
                       marked.cast("bigint").alias("marked"))


@query("src3_kinds_of_documents", None)
def _(spark, d):
    docs = b.table(spark, d, "documents")
    kind = landing.detect(F.encode("text", "UTF-8"))
    return docs.select("doc_id", kind.alias("k")).groupBy("k.kind", "k.problem").agg(
        F.count("*").alias("files"))


def archives(spark, d):
    """Each document's text as the one file of an archive. Some name a workbook in the directory
    and some only in the text, some lost their end, some have a directory that is not one."""
    name = F.when(F.col("doc_id") % 5 == 1, landing.WORKBOOK).otherwise("notes/one.txt")
    body = F.concat(F.lit("PK\x03\x04"), F.coalesce("text", F.lit("")), F.lit(landing.WORKBOOK))
    body = F.encode(body, "UTF-8")
    zeros = lambda n: F.repeat(F.lit("00"), n)
    little = lambda n, size: F.concat(*[
        F.lpad(F.hex(F.shiftright(n.cast("int"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(size)])
    mark = F.when(F.col("doc_id") % 5 == 3, "504B0909").otherwise("504B0102")
    entry = F.concat(mark, zeros(24), little(F.length(name), 2), zeros(16), F.hex(F.encode(name, "UTF-8")))
    end = F.concat(F.lit("504B0506"), zeros(4), little(F.lit(1), 2), little(F.lit(1), 2),
                   little(F.length(name) + 46, 4), little(F.length(body), 4), zeros(2))
    kept = F.when(F.col("doc_id") % 5 == 2, F.substring(F.hex(body), 1, 30)).otherwise(F.concat(F.hex(body), entry, end))
    return b.table(spark, d, "documents").select("doc_id", F.unhex(kept).alias("content"))


@query("src3_kinds_of_archives", """SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'excel' END AS kind,
    CASE WHEN doc_id % 5 IN (2, 3) THEN 'The file is damaged.'
      WHEN doc_id % 5 <> 1 THEN 'This is a zip archive, not a spreadsheet.' END AS problem FROM documents""", model=False)
def _(spark, d):
    return archives(spark, d).select("doc_id", landing.detect(F.col("content")).alias("k")).select(
        "doc_id", "k.kind", "k.problem")


@query("src6_delimited_cells", f"""
    SELECT CAST(id AS VARCHAR) AS file_id, x.row, x.col, CASE x.what WHEN 'vendor' THEN vendor
      WHEN 'number' THEN 'C-' || id WHEN 'day' THEN CAST(receipt_date AS VARCHAR)
      WHEN 'amount' THEN format('{{:,}}', CAST(floor(total) AS BIGINT)) || '.'
        || lpad(CAST(CAST(total * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0') ELSE x.what END AS value
    FROM {KNOWN}, (VALUES (0, 0, 'Shop'), (0, 1, 'vendor'), (1, 0, 'Bill No'), (1, 1, 'number'),
      (2, 0, 'Date'), (2, 1, 'day'), (3, 0, 'Note'), (3, 1, 'say "hi", twice'), (5, 0, 'Item'),
      (5, 1, 'Amount'), (6, 0, 'Goods'), (6, 1, 'amount'), (8, 0, 'Total'), (8, 1, 'amount'))
      AS x(row, col, what)""")
def _(spark, d):
    return landing.csv_cells(csv_files(spark, d)).filter("value IS NOT NULL").select(
        "file_id", "row", "col", "value")


@query("src7_trimmed_grids", """SELECT CAST(o_orderkey AS VARCHAR) AS file_id, 8 AS last_row,
    1 AS last_col, 17 AS cells FROM orders""")
def _(spark, d):
    trimmed = landing.trim_cells(landing.csv_cells(csv_files(spark, d)))
    return trimmed.groupBy("file_id").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"),
                                          F.count("*").cast("int").alias("cells"))


@query("src17_sheets_as_text", f"""SELECT CAST(id AS VARCHAR) AS file_id, concat_ws(chr(10), 'TAX INVOICE', printed, 'Bill No. Date',
      'B-' || id || ' ' || strftime(receipt_date, '%d-%b-%Y'), 'Item Qty Amount', 'Goods 2 ' || total, 'only a heading',
      'Carriage 0.50', 'Taxable Value' || coalesce(' ₹ ' || subtotal, ''), 'CGST @ 9%' || coalesce(' ' || cgst, ''),
      'SGST @ 9%' || coalesce(' ' || {SGST}, ''), 'Total 7', 'Net Payable: ' || total) AS text FROM {WITH_NAMES}""")
def _(spark, d):
    return landing.sheet_texts(printed.cells(spark, d)).select("file_id", "text")


@query("src17_rows_as_csv", f"""SELECT CAST(id AS VARCHAR) AS file_id, x.row, CASE x.row WHEN 0 THEN 'Shop,' || vendor
      WHEN 1 THEN 'Bill No,C-' || id WHEN 2 THEN 'Date,' || receipt_date WHEN 3 THEN 'Note,"say ""hi"", twice"' WHEN 4 THEN ',,'
      WHEN 5 THEN 'Item,Amount' WHEN 6 THEN 'Goods,' || quoted WHEN 8 THEN 'Total,' || quoted || ',' ELSE '' END AS line
    FROM (SELECT *, CASE WHEN amount LIKE '%,%' THEN '"' || amount || '"' ELSE amount END AS quoted
      FROM (SELECT *, format('{{:,}}', {WHOLE}) || '.' || lpad(CAST(CAST(total * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0') AS amount
        FROM {KNOWN})), (SELECT CAST(unnest(range(10)) AS INT) AS row) x""")
def _(spark, d):
    return landing.csv_texts(landing.csv_cells(csv_files(spark, d))).select("file_id", "row", "line")


# --- words of a scan ----------------------------------------------------------------------------


@query("win14_words_to_lines", """SELECT conv_id AS file_id, turn AS page, CAST(k // 7 AS INT) AS line_no,
      string_agg('n' || k, ' ' ORDER BY k DESC) AS text
    FROM (SELECT conv_id, turn, unnest(range(len(string_split(text, ' ')))) AS k FROM conversations) GROUP BY 1, 2, 3""")
def _(spark, d):
    # A box per word, seven on a line, from the right to the left and slightly uneven.
    k = F.posexplode(F.split("text", " ")).alias("k", "word")
    said = b.table(spark, d, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").alias("page"), k)
    k, top = F.col("k"), F.floor(F.col("k") / 7) * 24 + F.col("k") % 3
    boxes = said.select("file_id", "page", F.concat(F.lit("n"), k.cast("string")).alias("text"),
                        (600 - k % 7 * 100).alias("left"), top.alias("top"), (top + 20).alias("bottom"))
    return words.words_to_lines(boxes)


@query("win14_receipts_from_words", f"""SELECT CAST(file_id AS VARCHAR) AS file_id, seq AS first_page,
      vendor, 'INV/' || id AS receipt_number, receipt_date, tax, total FROM {KNOWN}""")
def _(spark, d):
    return pages.read_receipts(words.words_to_lines(printed.words(spark, d))).select(
        "file_id", "first_page", "vendor", "receipt_number", "receipt_date", "tax", "total")


WORDS = """(SELECT file_id, page, CAST(sum(CAST(0.8 + (pos % 4) * 0.05 AS DOUBLE) * length(word)) AS DOUBLE)
      / sum(length(word)) AS score, count(*) AS words
    FROM (SELECT doc_id AS file_id, turn AS page, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos
      FROM (SELECT conv_id AS doc_id, turn, regexp_split_to_array(text, ' ') AS w FROM conversations))
    WHERE word <> '' GROUP BY 1, 2)"""


def conversation_words(spark, d):
    split = b.table(spark, d, "conversations").select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("page"),
        F.posexplode(F.split("text", " ")).alias("at", "text"))
    return split.filter("text <> ''").withColumn("score", F.lit(0.8) + (F.col("at") % 4) * 0.05)


@query("agg13_mean_word_score", f"SELECT file_id, page, CAST(round(score, 6) AS DECIMAL(8,6)) AS score, words FROM {WORDS}")
def _(spark, d):
    return words.page_scores(conversation_words(spark, d)).select(
        "file_id", "page", F.round("score", 6).cast("decimal(8,6)").alias("score"), "words")


@query("agg14_scaled_confidence", f"""SELECT file_id, CAST(round(0.85 * sum(score * words) / sum(words), 3)
    AS DECIMAL(4,3)) AS confidence FROM {WORDS} GROUP BY 1""")
def _(spark, d):
    scores = words.page_scores(conversation_words(spark, d))
    whole = scores.groupBy("file_id").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    receipts = whole.withColumn("group_no", F.lit(1)).withColumn("confidence", F.lit(0.85))
    return pages.scale_by_reading(receipts, scores).select(
        "file_id", F.col("confidence").cast("decimal(4,3)").alias("confidence"))


@query("agg19_texts_of_a_file", f"""SELECT file_id, count(*) AS receipts, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text
    FROM (SELECT file_id, page, string_agg(trim(text), chr(10) ORDER BY line_no) AS text FROM {PRINTED} GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    return pages.texts_of_files(pages.read_receipts(printed.lines(spark, d)))


@query("udf2_own_reader", f"""SELECT CAST(id AS VARCHAR) AS file_id, 'U-' || id AS receipt_number,
    total FROM {KNOWN}""")
def _(spark, d):
    def reader(file_id, content):
        for number, line in enumerate(bytes(content).decode().split("~")):
            yield 1, number, line

    files = b.receipts(spark, d).select(
        F.col("id").cast("string").alias("file_id"),
        F.encode(F.concat(F.lit("Bill No: U-"), F.col("id").cast("string"), F.lit("~Total Rs "),
                          F.col("total").cast("string")), "UTF-8").alias("content"))
    return pages.read_receipts(words.read_files(files, reader)).select(
        "file_id", "receipt_number", "total")


@query("win7_first_labelled_line", f"""SELECT CAST(file_id AS VARCHAR) AS file_id, seq AS page, 'total' AS field,
    total AS amount FROM {KNOWN}""")
def _(spark, d):
    rows = printed.lines(spark, d).select("file_id", "page", "line_no",
                                          labels.match_label(F.col("text")).alias("m"))
    rows = rows.filter("m.field = 'total'").withColumn("amount", money.last_amount(F.col("m.rest")))
    first = Window.partitionBy("file_id", "page", "m.field").orderBy("line_no")
    ranked = rows.filter("amount IS NOT NULL").withColumn("n", F.row_number().over(first))
    return ranked.filter("n = 1").select("file_id", F.col("page").cast("int").alias("page"),
                                         "m.field", "amount")
