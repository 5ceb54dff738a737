"""Categories: how much each is used, their order, and changes asked for."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billmill.functions import text


def uses(categories: DataFrame, receipts: DataFrame, vendors: DataFrame) -> DataFrame:
    """Adds receipts_using and vendors_using. A receipt counts once for each category it
    names, automatic or override; counts are partial before the shuffle."""
    named = F.array_distinct(F.array("category_auto_id", "category_override_id"))
    per_receipt = (
        receipts.select(F.explode(named).alias("id"))
        .filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.count("*").alias("receipts_using"))
    )
    per_vendor = (
        vendors.select(F.col("default_category_id").alias("id"))
        .filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.count("*").alias("vendors_using"))
    )
    joined = categories.join(per_receipt, "id", "left").join(per_vendor, "id", "left")
    return joined.fillna(0, ["receipts_using", "vendors_using"])


def in_order(categories: DataFrame) -> DataFrame:
    """Built-in ones in their usual order, then custom ones A to Z ignoring case."""
    usual = F.when(F.col("builtin"), F.col("id"))
    return categories.orderBy(F.col("builtin").desc(), usual, F.lower("name"))


def unknown(asked: DataFrame, categories: DataFrame) -> DataFrame:
    """Asked-for category ids that do not exist."""
    wanted = asked.filter(F.col("category_id").isNotNull()).select("category_id").distinct()
    return wanted.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_anti")


def by_name(rows: DataFrame, name: str, categories: DataFrame, into: str) -> DataFrame:
    """Text categories to ids, ignoring case."""
    side = categories.select(F.lower("name").alias("_folded"), F.col("id").alias(into))
    keyed = rows.withColumn("_folded", F.lower(name))
    return keyed.join(side, "_folded", "left").drop("_folded")


def fold_custom(categories: DataFrame) -> DataFrame:
    """The fixed list's word for each category: custom ones fold to 'other'."""
    word = F.when(F.col("builtin"), F.lower("name")).otherwise("other")
    return categories.withColumn("old_value", word)


def change(categories: DataFrame, used: DataFrame, asked: DataFrame) -> DataFrame:
    """Decide renames and deletions (asked: id, action, name, and `at` for their order; by id
    without it). `refused` says why not; a null one is carried out. Of renames to one name in
    the same batch the first is accepted, as it takes the name from those of other categories.
    `used` is the result of uses()."""
    turn = F.struct("at", "id") if "at" in asked.columns else F.struct("id")
    cleaned = asked.withColumn("new_name", text.category_name(F.col("name")))
    taken = categories.select(F.col("id").alias("_owner"), F.lower("name").alias("_folded"))
    known = used.select(
        "id", F.col("builtin"), "receipts_using", "vendors_using", F.lit(True).alias("_known")
    )
    joined = (
        cleaned.withColumn("_folded", F.lower("new_name"))
        .join(known, "id", "left")
        .join(taken, "_folded", "left")
    )
    rename, delete = F.col("action") == "rename", F.col("action") == "delete"
    clash = F.col("_owner").isNotNull() & (F.col("_owner") != F.col("id"))
    busy = (F.col("receipts_using") > 0) | (F.col("vendors_using") > 0)
    refused = (
        F.when(F.col("_known").isNull(), "Category not found.")
        .when(rename & F.col("builtin"), "Built-in categories cannot be renamed.")
        .when(rename & F.col("new_name").isNull(), "That is not a category name.")
        .when(
            rename & clash,
            F.concat(F.lit('A category called "'), "new_name", F.lit('" already exists.')),
        )
        .when(delete & F.col("builtin"), "Built-in categories cannot be deleted.")
        .when(
            delete & busy,
            F.concat(
                F.lit("This category is used by "), F.col("receipts_using").cast("string"),
                F.lit(" receipt(s) and "), F.col("vendors_using").cast("string"),
                F.lit(" vendor(s). Move them to another category first."),
            ),
        )
    )
    decided = joined.withColumn("refused", refused).withColumn("_turn", turn)
    free = decided.filter(rename & F.col("refused").isNull())
    first = free.groupBy("_folded").agg(F.min_by("id", "_turn").alias("_first"))
    late = rename & F.col("refused").isNull() & (F.col("_first") != F.col("id"))
    taken_now = F.concat(F.lit('A category called "'), "new_name", F.lit('" already exists.'))
    return decided.join(first, "_folded", "left").select(
        "id", "action", "new_name", F.when(late, taken_now).otherwise(F.col("refused")).alias("refused")
    )


def carry_out(categories: DataFrame, decisions: DataFrame) -> DataFrame:
    """The categories after the accepted renames and deletions."""
    accepted = decisions.filter(F.col("refused").isNull())
    renamed = accepted.filter("action = 'rename'").select("id", "new_name")
    deleted = accepted.filter("action = 'delete'").select("id")
    left = categories.join(deleted, "id", "left_anti").join(renamed, "id", "left")
    return left.withColumn("name", F.coalesce("new_name", "name")).drop("new_name")
