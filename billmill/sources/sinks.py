"""Writing results: CSV export, run results as JSON, confirmed answers, the view by year."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billmill.functions import dates, text
from billmill.model import BUILTIN_CATEGORIES
from billmill.operators.search import ReceiptQuery, limited, ordering

CSV_HEADER = {
    "receipt_date": "Date", "vendor": "Vendor", "receipt_number": "Receipt no.",
    "category": "Category", "subtotal": "Subtotal", "tax": "Tax", "total": "Total",
    "ref_no": "Reference", "file_ref_no": "File",
}
BYTE_ORDER_MARK = "\ufeff"


def csv_rows(view: DataFrame, query: ReceiptQuery) -> DataFrame:
    """Every match as text cells under the export's headers; text cannot start a formula."""
    rows = limited(view, query)
    kinds = dict(rows.dtypes)

    def cell(name: str) -> Column:
        value = F.col(name)
        if kinds[name] == "string":
            return text.safe_cell(value)
        return F.coalesce(value.cast("string"), F.lit(""))

    return rows.select(*[cell(name).alias(header) for name, header in CSV_HEADER.items()])


def export_csv(view: DataFrame, query: ReceiptQuery, path: str) -> None:
    """Every matching receipt as CSV part files, in the query's order across the parts. The
    mark in front of the header lets spreadsheets read the text as UTF-8."""
    names = list(CSV_HEADER.values())
    marked = [F.col(f"`{n}`").alias((BYTE_ORDER_MARK if i == 0 else "") + n)
              for i, n in enumerate(names)]
    ordered = matching_in_order(view, query)
    csv_rows(ordered, ReceiptQuery()).select(*marked).write.option("header", True).option(
        "emptyValue", ""
    ).csv(path)


def matching_in_order(view: DataFrame, query: ReceiptQuery) -> DataFrame:
    return limited(view, query).orderBy(*ordering(query))


def result_json(receipts: Column) -> Column:
    """A run's receipts as a JSON array; money as strings with two places, dates as ISO."""

    def money(v: Column, scale: int = 2) -> Column:
        return v.cast(f"decimal(14,{scale})").cast("string")

    def item(i: Column) -> Column:
        return F.struct(
            i["description"].alias("description"),
            i["quantity"].cast("string").alias("quantity"),
            i["unit_price"].cast("string").alias("unit_price"),
            money(i["amount"]).alias("amount"),
        )

    def receipt(r: Column) -> Column:
        return F.struct(
            r["vendor"].alias("vendor"),
            r["receipt_number"].alias("receipt_number"),
            r["receipt_date"].cast("string").alias("receipt_date"),
            money(r["subtotal"]).alias("subtotal"),
            money(r["tax"]).alias("tax"),
            money(r["total"]).alias("total"),
            F.transform(r["line_items"], item).alias("line_items"),
            r["confidence"].alias("confidence"),
            r["source"].alias("source"),
        )

    return F.to_json(F.transform(receipts, receipt), {"ignoreNullFields": "false"})


def confirmed_answers(receipts: DataFrame) -> DataFrame:
    """One row per kept file: its name and the answers a person confirmed. `receipts` has
    ref_no (of the file), original_name, seq and the fields."""

    def money(name: str) -> Column:
        return F.col(name).cast("decimal(14,2)").cast("string").alias(name)

    answer = F.struct(
        "seq", "vendor", "receipt_number", F.col("receipt_date").cast("string").alias("receipt_date"),
        money("subtotal"), money("tax"), money("total"),
    )
    name = F.concat("ref_no", F.lit("__"), F.regexp_extract("original_name", r"([^/\\]*)$", 1))
    grouped = receipts.groupBy(name.alias("name")).agg(
        F.array_sort(F.collect_list(answer)).alias("answers")
    )
    return grouped.withColumn("answers", F.transform("answers", lambda a: a.dropFields("seq")))


def keep_answers(receipts: DataFrame, path: str) -> None:
    confirmed_answers(receipts).write.option("ignoreNullFields", "false").json(path)


def seed_categories(existing: DataFrame) -> DataFrame:
    """The built-in categories that are not there yet, ignoring case."""
    spark = existing.sparkSession
    seed = spark.createDataFrame([(n, True) for n in BUILTIN_CATEGORIES], "name string, builtin boolean")
    there = existing.select(F.lower("name").alias("_folded"))
    return seed.join(there, F.lower("name") == F.col("_folded"), "left_anti")


def write_view(view: DataFrame, path: str) -> None:
    """The view as parquet by financial year, sorted by vendor inside, so date filters prune
    folders and vendor filters skip row groups. Rows of a year spread over several files."""
    year = F.year(dates.financial_year_start(F.col("receipt_date")))
    spread = F.pmod(F.xxhash64("ref_no"), F.lit(32))
    view.withColumn("fy", year).repartition("fy", spread).sortWithinPartitions("fy", "vendor").write.partitionBy(
        "fy"
    ).parquet(path)
