"""Reading kept results: run results as JSON, answers of a second reader, confirmed answers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billmill.functions import dates, money, text
from billmill.model import SECOND_READ_CONFIDENCE

_TEXT_ITEM = "struct<description:string,quantity:string,unit_price:string,amount:string>"
RESULT = (
    "array<struct<vendor:string,receipt_number:string,receipt_date:string,subtotal:string,"
    f"tax:string,total:string,line_items:array<{_TEXT_ITEM}>,confidence:double,source:string>>"
)
ANSWER = (
    f"struct<receipts:array<struct<vendor:string,receipt_number:string,receipt_date:string,"
    f"subtotal:string,tax:string,total:string,line_items:array<{_TEXT_ITEM}>>>>"
)
CONFIRMED = (
    "map<string,array<struct<vendor:string,receipt_number:string,receipt_date:string,"
    "subtotal:string,tax:string,total:string>>>"
)


def read_results(runs: DataFrame, column: str = "result_json") -> DataFrame:
    """Adds `result`: typed receipts, or null when the text is not such an array or an item
    does not fit; the run stays listed."""
    raw = F.from_json(column, RESULT, {"mode": "PERMISSIVE"})

    def typed(r: Column) -> Column:
        return F.struct(
            r["vendor"].alias("vendor"),
            r["receipt_number"].alias("receipt_number"),
            r["receipt_date"].try_cast("date").alias("receipt_date"),
            *[r[n].try_cast("decimal(12,2)").alias(n) for n in ("subtotal", "tax", "total")],
            F.transform(
                r["line_items"],
                lambda i: F.struct(
                    i["description"].alias("description"),
                    i["quantity"].try_cast("decimal(12,3)").alias("quantity"),
                    i["unit_price"].try_cast("decimal(14,4)").alias("unit_price"),
                    i["amount"].try_cast("decimal(12,2)").alias("amount"),
                ),
            ).alias("line_items"),
            r["confidence"].alias("confidence"),
            r["source"].alias("source"),
        )

    def fits(r: Column) -> Column:
        """Every value that is there can be read as its type."""
        lost = [
            r[n].isNotNull() & r[n].try_cast(t).isNull()
            for n, t in [("receipt_date", "date"), *[(m, "decimal(12,2)") for m in
                                                     ("subtotal", "tax", "total")]]
        ]
        bad = lost[0] | lost[1] | lost[2] | lost[3]
        return ~bad & r["confidence"].between(0, 1) & r["source"].isNotNull()

    sound = F.forall(raw, lambda r: F.coalesce(r.isNotNull() & fits(r), F.lit(False)))
    listed = F.trim(column).startswith("[")
    return runs.withColumn("result", F.when(listed & sound, F.transform(raw, typed)))


def to_receipts(answers: DataFrame, column: str = "answer", source: str = "second read"):
    """Adds `receipts`: a second reader's JSON answer through the same parsers as any printed
    value. Items without a description or a readable amount are dropped."""
    raw = F.from_json(column, ANSWER)["receipts"]

    def item(i: Column) -> Column:
        return F.struct(
            F.substring(F.trim(i["description"]), 1, 500).alias("description"),
            money.parse_quantity(i["quantity"]).alias("quantity"),
            money.parse_amount(i["unit_price"]).cast("decimal(14,4)").alias("unit_price"),
            money.parse_amount(i["amount"]).alias("amount"),
        )

    def kept(i: Column) -> Column:
        return i["amount"].isNotNull() & (F.coalesce(i["description"], F.lit("")) != "")

    def receipt(r: Column) -> Column:
        items = F.coalesce(r["line_items"], F.array().cast(f"array<{_TEXT_ITEM}>"))
        return F.struct(
            text.clean_vendor(r["vendor"]).alias("vendor"),
            text.clean_receipt_number(r["receipt_number"]).alias("receipt_number"),
            dates.parse_date(r["receipt_date"]).alias("receipt_date"),
            money.parse_amount(r["subtotal"]).alias("subtotal"),
            money.parse_amount(r["tax"]).alias("tax"),
            money.parse_amount(r["total"]).alias("total"),
            F.filter(F.transform(items, item), kept).alias("line_items"),
            F.lit(SECOND_READ_CONFIDENCE).alias("confidence"),
            F.lit(source).alias("source"),
        )

    listed = F.coalesce(raw, F.array().cast(ANSWER[16:-1]))
    return answers.withColumn("receipts", F.transform(listed, receipt))


def read_answers(files: DataFrame, column: str = "value") -> DataFrame:
    """Confirmed answers, one row per file and position, from JSON maps name -> answers."""
    named = files.select(F.explode(F.from_json(column, CONFIRMED)).alias("name", "answers"))
    rows = named.select("name", F.posexplode("answers").alias("pos", "a"))
    return rows.select(
        "name",
        (F.col("pos") + 1).alias("seq"),
        "a.vendor",
        "a.receipt_number",
        F.col("a.receipt_date").try_cast("date").alias("receipt_date"),
        *[F.col(f"a.{n}").try_cast("decimal(12,2)").alias(n) for n in ("subtotal", "tax", "total")],
    )
