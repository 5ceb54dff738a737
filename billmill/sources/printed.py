"""Receipts printed as page lines and as sheet cells, derived from the test tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billmill.functions import money
from billmill.sources import bindings as b


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts with the vendor as printed and the tax in two parts."""
    v = b.printed_vendors(spark, sf_dir).select(F.col("id").alias("vendor_id"), "printed")
    half = money.from_cents(b.div((F.col("tax") * 100).cast("bigint"), 2))
    return (
        b.receipts(spark, sf_dir)
        .join(v, "vendor_id", "left")
        .withColumn("cgst", half)
        .withColumn("sgst", (F.col("tax") - half).cast("decimal(12,2)"))
    )


def plain(amount: Column) -> Column:
    return amount.cast("string")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per receipt, two pages per file."""
    n = F.col("id")
    printed = F.array(
        F.when(n % 3 == 0, "TAX INVOICE").when(n % 3 == 1, "Cash Memo"),
        F.col("printed"),
        F.lit("GSTIN: 27ABCDE1234F1Z5"),
        F.concat(F.lit("Invoice No: INV/"), n.cast("string")),
        F.concat(F.lit("Order Date 01/01/1990 Invoice Date: "), F.date_format("receipt_date", "dd/MM/yyyy")),
        F.concat(F.lit("Sub Total  "), plain(F.col("subtotal"))),
        F.concat(F.lit("CGST @ 9% "), plain(F.col("cgst")), F.lit(" SGST @ 9 %: "),
                 plain(F.col("sgst"))),
        F.lit("Thank you! Visit again."),
        F.concat(F.lit("Grand Total Rs. "), F.substring(money.rupees(F.col("total")), 2, 30)),
        F.lit("Total 2 items 1.00"),
    )
    page = F.posexplode(printed).alias("line_no", "text")
    return known(spark, sf_dir).select(
        F.col("file_id").cast("string").alias("file_id"), F.col("seq").alias("page"), page
    ).filter(F.col("text").isNotNull())


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per order whose items are printed as a table without ruled lines."""
    items = b.line_items(spark, sf_dir)
    key = F.col("receipt_id").cast("string").alias("file_id")
    one = F.lit(1).alias("page")
    rows = items.select(
        key, one, (F.col("position") + 10).alias("line_no"),
        F.concat_ws(" ", "description", F.col("quantity").cast("int").cast("string"),
                    plain(F.col("amount")), F.lit("0.00"), plain(F.col("amount"))).alias("text"),
    )
    sums = items.groupBy("receipt_id").agg(
        F.sum("amount").cast("decimal(12,2)").alias("amount"), F.count("*").alias("n")
    )
    total = sums.select(
        key, one, (F.col("n") + 11).cast("int").alias("line_no"),
        F.concat_ws(" ", F.lit("Total"), F.col("n").cast("string"), plain(F.col("amount")), F.lit("1.50"),
                    plain(F.col("amount"))).alias("text"),
    )
    head = sums.select(
        key, one, F.explode(F.array(*[
            F.struct(F.lit(i).alias("line_no"), t.alias("text")) for i, t in enumerate([
                F.concat(F.lit("Bill No: B-"), F.col("receipt_id").cast("string")),
                F.lit("Particulars Qty Taxable Value CGST Total"),
                F.lit("continued below"),
            ])
        ])).alias("x"),
    ).select("file_id", "page", "x.line_no", "x.text")
    return rows.unionByName(total).unionByName(head)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet per receipt: values beside or below their labels, an items table, totals."""
    n = F.col("id")
    money_text = lambda c: F.concat(F.lit("₹ "), plain(F.col(c)))

    def cell(row: int, col: int, value: Column, number: bool = False) -> Column:
        return F.struct(
            F.lit(row).alias("row"), F.lit(col).alias("col"), value.cast("string").alias("value"),
            F.lit(number).alias("is_number"),
        )

    grid = F.array(
        cell(0, 0, F.lit("TAX INVOICE")),
        cell(1, 0, F.col("printed")),
        cell(3, 0, F.lit("Bill No.")),
        cell(3, 1, F.lit("Date")),
        cell(4, 0, F.concat(F.lit("B-"), n.cast("string"))),
        cell(4, 1, F.date_format("receipt_date", "dd-MMM-yyyy")),
        cell(6, 0, F.lit("Item")),
        cell(6, 1, F.lit("Qty")),
        cell(6, 3, F.lit("Amount")),
        cell(7, 0, F.lit("Goods")),
        cell(7, 1, F.lit("2"), True),
        cell(7, 3, plain(F.col("total")), True),
        cell(8, 0, F.lit("only a heading")),
        cell(9, 0, F.lit("Carriage")),
        cell(9, 3, F.lit("0.50")),
        cell(11, 0, F.lit("Taxable Value")),
        cell(11, 3, money_text("subtotal")),
        cell(12, 0, F.lit("CGST @ 9%")),
        cell(12, 3, plain(F.col("cgst")), True),
        cell(13, 0, F.lit("SGST @ 9%")),
        cell(13, 2, plain(F.col("sgst")), True),
        cell(14, 0, F.lit("Total")),
        cell(14, 1, F.lit("7"), True),
        cell(15, 0, F.concat(F.lit("Net Payable: "), plain(F.col("total")))),
    )
    filled = F.filter(grid, lambda c: c["value"].isNotNull())
    return known(spark, sf_dir).select(
        n.cast("string").alias("file_id"), F.lit("Bill").alias("sheet"), F.explode(filled).alias("c")
    ).select("file_id", "sheet", "c.*")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes as a scan of the printed lines: a box per word, slightly uneven."""
    split = lines(spark, sf_dir).select(
        F.col("file_id"), F.col("page"), "line_no",
        F.posexplode(F.split("text", r"\s+")).alias("at", "text"),
    ).filter("text <> ''")
    top = F.col("line_no") * 30 + F.col("at") % 3
    left = F.col("at") * 100.0
    return split.select(
        "file_id", F.col("page").cast("int").alias("page"), "text",
        (F.lit(0.8) + (F.col("at") % 4) * 0.05).alias("score"),
        left.alias("left"), top.cast("double").alias("top"), (left + 80).alias("right"),
        (top + 20).cast("double").alias("bottom"),
    )
