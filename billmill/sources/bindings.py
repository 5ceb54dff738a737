"""The receipt model's tables, derived from the star-schema test tables.

Every table here has a twin in plans/model_sql.py, so results can be compared with another
engine. `TODAY` is pinned: the last order date of the test tables.
"""

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billmill.functions import money, text
from billmill.operators.skew import numbered, with_lookup

TODAY = date(2001, 8, 1)
COPY_OFFSET = 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def today() -> Column:
    return F.lit(TODAY)


def now() -> Column:
    return F.lit("2001-08-01 00:00:00").cast("timestamp")


def div(a: Column, n: int) -> Column:
    """Whole-number division."""
    return F.floor(a / n).cast("bigint")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct()
    ranked = names.agg(F.array_sort(F.collect_list("name")).alias("names"))
    return ranked.select(F.posexplode("names").alias("pos", "name")).select(
        (F.col("pos") + 1).cast("bigint").alias("id"), "name", (F.col("pos") < 3).alias("builtin")
    )


def printed_vendor(key: Column) -> Column:
    base = F.concat(F.lit("Trader "), F.lpad((key % 100).cast("string"), 3, "0"))
    variant = div(key, 100) % 3
    return (
        F.when(variant == 0, base)
        .when(variant == 1, F.upper(base))
        .otherwise(F.concat(F.lit("  "), base, F.lit(" ,")))
    )


def printed_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, printed name as on the receipt, default category."""
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        printed_vendor(F.col("c_custkey")).alias("printed"),
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("name"),
    )
    known = categories(spark, sf_dir).select(F.col("id").alias("default_category_id"), "name")
    return people.join(known, "name", "left").drop("name")


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendors with the normalized name: the earliest one that differs only in case."""
    from billmill.operators.registry import normalized_names

    named = printed_vendors(spark, sf_dir).select(
        "id", text.clean_vendor(F.col("printed")).alias("raw_name"), "default_category_id"
    )
    return normalized_names(named)


def file_ref(file_id: Column) -> Column:
    return text.ref_no(file_id, F.lit(2001))


def file_sha(file_id: Column) -> Column:
    content = F.when(file_id % 20 == 3, file_id - 3).otherwise(file_id)
    return F.sha2(F.concat(F.lit("file "), content.cast("string")), 256)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        div(F.col("o_orderkey"), 2).alias("id"), "o_orderstatus", "o_orderdate"
    )
    grouped = orders.groupBy("id").agg(
        F.min("o_orderstatus").alias("letter"),
        F.min("o_orderdate").cast("timestamp").alias("uploaded_at"),
    )
    key = F.col("id")
    waiting = F.array(
        *(F.lit(s) for s in ("needs_review", "flagged", "ai_processing", "pending", "processing",
                             "failed", "rejected"))
    )
    status = (
        F.when(F.col("letter") == "F", "parsed")
        .when(F.col("letter") == "O", "resolved")
        .otherwise(F.element_at(waiting, (key % 7 + 1).cast("int")))
    )
    kinds = F.array(*(F.lit(k) for k in ("excel", "csv", "pdf_text", "pdf_scan", "image")))
    exts = F.array(*(F.lit(e) for e in ("xlsx", "csv", "pdf", "pdf", "jpg")))
    fifth = (key % 5 + 1).cast("int")
    sha = file_sha(key)
    return grouped.select(
        "id",
        file_ref(key).alias("ref_no"),
        div(key, 50).alias("batch_id"),
        F.concat(F.lit("Scan_"), key.cast("string"), F.lit("."), F.element_at(exts, fifth)).alias(
            "original_name"
        ),
        sha.alias("sha256"),
        (key % 4096 * 1024).alias("size_bytes"),
        F.concat(F.substring(sha, 1, 2), F.lit("/"), sha, F.lit(".pdf")).alias("storage_path"),
        F.element_at(kinds, fifth).alias("kind"),
        status.alias("status"),
        (now() - F.make_dt_interval(secs=(key % 1000).cast("decimal(18,6)"))).alias(
            "status_changed_at"
        ),
        (key % 4).cast("int").alias("attempts"),
        F.when(key % 20 == 3, key - 3).alias("duplicate_of_id"),
        F.when(status == "failed", "The reader failed.").alias("error"),
        "uploaded_at",
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One receipt per order; two receipts per file."""
    key = F.col("o_orderkey")
    cents = (F.col("o_totalprice").cast("decimal(14,2)") * 100).cast("bigint")
    tax = div(cents * 18, 118)
    orders = table(spark, sf_dir, "orders")
    file_id = div(key, 2)
    seq = key % 2 + 1
    return orders.select(
        key.alias("id"),
        file_id.alias("file_id"),
        (file_id * 2).alias("run_id"),
        seq.cast("int").alias("seq"),
        text.receipt_ref_no(file_ref(file_id), seq).alias("ref_no"),
        F.col("o_custkey").alias("vendor_id"),
        F.when(key % 7 != 0, key.cast("string")).alias("receipt_number"),
        F.col("o_orderdate").cast("date").alias("receipt_date"),
        F.when(key % 6 != 0, money.from_cents(cents - tax)).alias("subtotal"),
        F.when(
            key % 6 != 0, money.from_cents(tax + F.when(key % 13 == 0, 500).otherwise(0))
        ).alias("tax"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("total"),
        F.when(key % 17 == 0, key % 5 + 1).alias("category_override_id"),
        F.round((key % 100) / 100.0, 2).alias("confidence"),
    )


def receipts_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts plus a 5 % that were stored again from another file."""
    own = receipts(spark, sf_dir)
    key = F.col("id")
    again = own.filter(key % 20 == 5).select(
        (key + COPY_OFFSET).alias("id"),
        (F.col("file_id") + 1).alias("file_id"),
        *[c for c in own.columns if c not in ("id", "file_id", "seq", "ref_no")],
        F.lit(3).alias("seq"),
        text.receipt_ref_no(file_ref(F.col("file_id") + 1), F.lit(3)).alias("ref_no"),
    )
    return own.unionByName(again)


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as receipt items; (order, line number) is not unique, so positions count."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("receipt_id"), "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice", "l_discount", "l_shipdate",
    )
    order = [c for c in lines.columns if c != "receipt_id"]
    counted = numbered(lines, ["receipt_id"], order, "position")
    return counted.select(
        "receipt_id",
        "position",
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("description"),
        F.col("l_quantity").cast("decimal(12,3)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(14,4)").alias("unit_price"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"),
    )


def item_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what sums need: no positions, so no sort."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("receipt_id"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"),
    )


def priced_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts whose amounts follow from their items, some of them off, for the checks."""
    sums = (
        item_amounts(spark, sf_dir)
        .groupBy("receipt_id")
        .agg(F.sum("amount").cast("decimal(14,2)").alias("items_total"), F.count("*").alias("n"))
    )
    own = receipts_with_copies(spark, sf_dir).drop("subtotal", "tax", "total")
    key = F.col("id") % COPY_OFFSET  # a copy has the amounts of its original
    joined = own.withColumn("receipt_id", key).join(sums, "receipt_id", "left")
    cents = (F.coalesce(F.col("items_total"), F.lit(100)) * 100).cast("bigint")
    sub = cents + F.when(key % 5 == 0, 75).when(key % 9 == 0, 175).otherwise(0)
    tax = div(sub * 18, 100)
    total = sub + tax + F.when(key % 11 == 0, 500).otherwise(0)
    return joined.select(
        *own.columns,
        "items_total",
        F.coalesce("n", F.lit(0)).alias("items"),
        F.when(key % 6 != 0, money.from_cents(sub)).alias("subtotal"),
        F.when(key % 6 != 0, money.from_cents(tax)).alias("tax"),
        money.from_cents(total).alias("total"),
    )


def receipt_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billmill.operators.search import view

    return view(
        receipts(spark, sf_dir), files(spark, sf_dir), vendors(spark, sf_dir),
        categories(spark, sf_dir),
    )


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    kinds = F.array(
        *(F.lit(t) for t in ("validation_failed", "duplicate_receipt", "arithmetic_mismatch"))
    )
    resolved = key % 3 == 0
    orders = table(spark, sf_dir, "orders").filter((key % 9 == 0) | (key % 10 == 0))
    return orders.select(
        (key * 2).alias("id"),
        div(key, 2).alias("file_id"),
        key.alias("receipt_id"),
        F.element_at(kinds, (key % 3 + 1).cast("int")).alias("type"),
        F.when(key % 4 == 0, "error").otherwise("warning").alias("severity"),
        F.concat(F.lit("Look at receipt "), key.cast("string")).alias("detail"),
        F.concat_ws(
            ":", div(key, 2).cast("string"), (key % 2 + 1).cast("string"), F.lit("check")
        ).alias("dedupe_key"),
        resolved.alias("resolved"),
        F.when(resolved, "asha").alias("resolved_by"),
        F.when(resolved, F.col("o_orderdate").cast("timestamp")).alias("resolved_at"),
    )


def run_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two readers made of each receipt: the library, then a second read."""
    own = with_lookup(
        receipts(spark, sf_dir), vendors(spark, sf_dir).select("id", "raw_name"), "vendor_id", "id"
    ).withColumnRenamed("raw_name", "vendor")
    keep = ["file_id", "seq", "vendor", "receipt_number", "receipt_date", "subtotal", "tax", "total"]
    key = F.col("id")
    library = own.select("id", *keep).withColumn("parser", F.lit("pdf_text"))
    second = own.select("id", *keep).select(
        "id",
        "file_id",
        "seq",
        F.when(key % 3 == 0, F.upper("vendor"))
        .when(key % 19 == 0, F.lit("Somebody Else"))
        .otherwise(F.col("vendor"))
        .alias("vendor"),
        "receipt_number",
        F.when(key % 13 != 0, F.col("receipt_date")).alias("receipt_date"),
        "subtotal",
        "tax",
        (F.col("total") + F.when(key % 11 == 0, 5).otherwise(0)).cast("decimal(12,2)").alias("total"),
        F.lit("ai").alias("parser"),
    )
    return library.unionByName(second)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs per file: the library's (even id), then a second read (odd id)."""
    base = files(spark, sf_dir).select("id", "sha256", "uploaded_at", "status")
    key = F.col("id")
    failed = key % 8 == 1
    library = base.select(
        (key * 2).alias("id"), key.alias("file_id"), "sha256", F.lit("pdf_text").alias("parser"),
        F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("model"),
        F.lit(None).cast("string").alias("ai_approved_by"),
        F.lit(None).cast("timestamp").alias("ai_approved_at"),
        (key % 3 != 0).alias("accepted"), F.lit(None).cast("string").alias("error"),
        F.col("uploaded_at").alias("finished_at"), F.col("uploaded_at").alias("created_at"),
        F.lit(True).alias("has_result"), F.lit(None).cast("bigint").alias("cached_from_id"),
    )
    asked = base.filter(key % 4 != 2)
    second = asked.select(
        (key * 2 + 1).alias("id"), key.alias("file_id"), "sha256", F.lit("ai").alias("parser"),
        F.when(div(key, 20) % 2 == 0, "openai").otherwise("gemini").alias("provider"),
        F.when(key % 25 != 0, "reader-1").alias("model"),
        F.when(key % 30 != 0, "asha").alias("ai_approved_by"),
        (F.col("uploaded_at") + F.make_dt_interval(hours=(key % 24).cast("int"))).alias(
            "ai_approved_at"
        ),
        (key % 3 == 0).alias("accepted"), F.when(failed, "The call failed.").alias("error"),
        F.when(key % 9 != 0, F.col("uploaded_at")).alias("finished_at"),
        (now() - F.make_dt_interval(secs=(key % 1000).cast("decimal(18,6)"))).alias("created_at"),
        (~failed & (key % 9 != 0)).alias("has_result"),
        F.when(key % 12 == 0, key * 2 - 1).alias("cached_from_id"),
    )
    return library.unionByName(second)


def label_number(key: Column) -> Column:
    return F.when(key % 3 == 0, key % 20).otherwise(key % 10)


def vendor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that corrections taught, per vendor key."""
    key = F.col("c_custkey")
    fields = F.array(F.lit("subtotal"), F.lit("tax"), F.lit("total"))
    taught = table(spark, sf_dir, "customer").filter(key % 100 < 40)
    return taught.select(
        F.lower(text.clean_vendor(printed_vendor(key))).alias("vendor_key"),
        F.element_at(fields, (key % 3 + 1).cast("int")).alias("field"),
        F.concat(
            F.element_at(F.array(F.lit("before gst"), F.lit("levy"), F.lit("to settle")),
                         (key % 3 + 1).cast("int")),
            F.lit(" "), label_number(key).cast("string"),
        ).alias("label"),
    ).distinct()
