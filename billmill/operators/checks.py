"""Checks on receipts: the acceptance gate, arithmetic, dates, duplicates, and flags."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billmill.functions import dates, money, text
from billmill.functions.labels import lookup
from billmill.model import COUNTED, MIN_CONFIDENCE
from billmill.operators.skew import first_per_key

PROBLEM = ["file_id", "receipt_id", "seq", "type", "detail", "key"]


def missing_required() -> Column:
    """The names of the required fields a receipt lacks."""
    tests = {
        "vendor": F.coalesce("vendor", F.lit("")) == "",
        "receipt_date": F.col("receipt_date").isNull(),
        "total": F.col("total").isNull(),
    }
    found = F.array(*[F.when(absent, F.lit(name)) for name, absent in tests.items()])
    return F.filter(found, lambda name: name.isNotNull())


def field_words(names: Column) -> Column:
    return F.transform(names, lambda n: F.when(n == "receipt_date", "date").otherwise(n))


def acceptance(files: DataFrame, receipts: DataFrame, min_confidence: Column | None = None):
    """Per file: the problems that stop its read from being accepted, in receipt order.

    files: id, kind. receipts: file_id, seq, vendor, receipt_date, total, confidence.
    """
    limit = lookup(MIN_CONFIDENCE, F.col("kind")) if min_confidence is None else min_confidence
    missing = missing_required()
    known = receipts.select("file_id", "seq", "confidence", missing.alias("missing"))
    listed = known.groupBy(F.col("file_id").alias("id")).agg(
        F.count("*").alias("receipts"),
        F.array_sort(F.collect_list(F.struct("seq", "missing", "confidence"))).alias("read"),
    )
    joined = files.join(listed, "id", "left").withColumn("_limit", limit)

    def problem(r: Column, i: Column) -> Column:
        which = F.when(
            F.col("receipts") > 1, F.concat(F.lit("Receipt "), (i + 1).cast("string"))
        ).otherwise("The receipt")
        lacks = F.concat(
            which, F.lit(" is missing its "), text.join_words(field_words(r["missing"])), F.lit(".")
        )
        percent = F.bround(r["confidence"] * 100, 0).cast("int").cast("string")
        doubtful = F.concat(
            which, F.lit(" was read with low confidence ("), percent, F.lit("%).")
        )
        return F.when(F.size(r["missing"]) > 0, lacks).when(
            r["confidence"] < F.col("_limit"), doubtful
        )

    found = F.filter(F.transform("read", problem), lambda p: p.isNotNull())
    none = F.array(F.lit("No receipt could be found in this file."))
    problems = F.when(F.col("receipts").isNull(), none).otherwise(found)
    return (
        joined.withColumn("problems", problems)
        .withColumn("accepted", F.size("problems") == 0)
        .withColumn("receipts", F.coalesce("receipts", F.lit(0)))
        .drop("read", "_limit")
    )


def decide_status(files: DataFrame) -> DataFrame:
    """Status after reading: files has unreadable, has_reader, accepted, problems."""
    status = (
        F.when(F.col("unreadable"), "flagged")
        .when(~F.col("has_reader"), "needs_review")
        .when(F.col("accepted"), "parsed")
        .otherwise("needs_review")
    )
    error = (
        F.when(F.col("unreadable"), F.col("read_error"))
        .when(~F.col("has_reader"), "No reader is available for this kind of file.")
        .when(~F.col("accepted"), text.summarize(F.col("problems")))
    )
    return files.withColumn("new_status", status).withColumn("new_error", error)


def keep_candidates(receipts: DataFrame) -> DataFrame:
    """Only what looks like a receipt: a non-zero total, items, or a number."""
    total = F.coalesce("total", F.lit(0)) != 0
    items = F.coalesce(F.col("items"), F.lit(0)) > 0
    return receipts.filter(total | items | F.col("receipt_number").isNotNull())


def item_sums(items: DataFrame) -> DataFrame:
    return items.groupBy("receipt_id").agg(
        F.sum("amount").cast("decimal(14,2)").alias("items_total"), F.count("*").alias("items")
    )


def _problem_rows(receipts: DataFrame, kind: str, detail: Column, key: Column) -> DataFrame:
    rows = receipts.withColumn("detail", detail).filter(F.col("detail").isNotNull())
    return rows.select(
        "file_id", F.col("id").alias("receipt_id"), "seq", F.lit(kind).alias("type"), "detail",
        key.alias("key"),
    )


def sum_problem() -> Column:
    """The sentence when subtotal and tax do not make the total."""
    expected = F.col("subtotal") + F.col("tax")
    sentence = F.concat(
        F.lit("Subtotal "), money.rupees_western(F.col("subtotal")), F.lit(" + tax "),
        money.rupees_western(F.col("tax")), F.lit(" = "), money.rupees_western(expected),
        F.lit(", but the total is "), money.rupees_western(F.col("total")), F.lit("."),
    )
    return F.when(~money.close(expected, F.col("total")), sentence)


def items_problem() -> Column:
    """The sentence when the items match neither subtotal nor total."""
    near = lambda name: F.coalesce(money.close(F.col("items_total"), F.col(name)), F.lit(False))
    named = F.concat_ws(
        " or ",
        *[
            F.when(
                F.col(n).isNotNull(), F.concat(F.lit(f"the {n} "), money.rupees_western(F.col(n)))
            )
            for n in ("subtotal", "total")
        ],
    )
    sentence = F.concat(
        F.lit("Line items add up to "), money.rupees_western(F.col("items_total")),
        F.lit(", which does not match "), named, F.lit("."),
    )
    has_target = F.col("subtotal").isNotNull() | F.col("total").isNotNull()
    wrong = (F.col("items") > 0) & has_target & ~near("subtotal") & ~near("total")
    return F.when(wrong, sentence)


def arithmetic_problems(receipts: DataFrame, **_: object) -> DataFrame:
    """receipts carry items_total and items (see item_sums)."""
    kind = "arithmetic_mismatch"
    sums = _problem_rows(receipts, kind, sum_problem(), F.lit("subtotal+tax"))
    return sums.unionByName(_problem_rows(receipts, kind, items_problem(), F.lit("items")))


def date_problems(receipts: DataFrame, *, today: Column, **_: object) -> DataFrame:
    detail = dates.date_problem(F.col("receipt_date"), today)
    return _problem_rows(receipts, "validation_failed", detail, F.lit("date"))


def duplicates(
    receipts: DataFrame, stored: DataFrame, *, symmetric: bool = False
) -> DataFrame:
    """Receipts that are stored already: same vendor (ignoring case), total and number (the
    date when there is no number), from another file that counts; `other` is the first.

    The first such receipt of another file is either the group's first receipt or the first
    one of a second file, so each group shrinks to two rows before anything is joined: no
    pairs, however many copies there are. `symmetric` also flags the earlier receipt.
    """
    counted = stored.filter(F.col("status").isin(*COUNTED))
    kind = F.when(F.coalesce("receipt_number", F.lit("")) != "", "number").otherwise("date")

    def keyed(df: DataFrame, name: str, branch: str) -> DataFrame:
        value = F.col("receipt_number") if branch == "number" else F.col("receipt_date").cast("string")
        return df.withColumns(
            {"_vendor": F.lower(name), "_kind": F.lit(branch), "_value": value}
        ).filter(F.col("_value").isNotNull() & F.col("_vendor").isNotNull())

    group = ["_vendor", "total", "_kind", "_value"]
    branches = keyed(counted, "normalized_name", "number").unionByName(
        keyed(counted, "normalized_name", "date")
    )
    per_file = branches.groupBy(*group, "file_id").agg(
        F.min(F.struct("id", "ref_no")).alias("_first")
    )
    two = first_per_key(per_file, group, [F.col("_first.id")], how_many=2)
    pair = two.groupBy(*group).agg(
        F.min(F.struct("_first", "file_id")).alias("_one"),
        F.max(F.struct("_first", "file_id")).alias("_two"),
    )
    asked = receipts.filter(F.col("total").isNotNull()).withColumn("_branch", kind)
    mine = keyed(asked.filter(F.col("_branch") == "number"), "vendor", "number").unionByName(
        keyed(asked.filter(F.col("_branch") == "date"), "vendor", "date")
    )
    joined = mine.drop("_branch").join(pair, group)
    other = F.when(F.col("_one.file_id") != F.col("file_id"), F.col("_one._first")).when(
        F.col("_two.file_id") != F.col("file_id"), F.col("_two._first")
    )
    found = joined.withColumn("other", other).filter(F.col("other").isNotNull())
    if not symmetric:
        found = found.filter(F.col("other.id") < F.col("id"))
    return found.drop(*[g for g in group if g != "total"], "_one", "_two")


def duplicate_problems(receipts: DataFrame, *, stored: DataFrame, symmetric: bool = False, **_: object):
    found = duplicates(receipts, stored, symmetric=symmetric)
    ref = F.col("other.ref_no")
    detail = F.concat(
        F.lit("The same receipt (vendor, number and total) is already stored as "), ref, F.lit(".")
    )
    return _problem_rows(
        found, "duplicate_receipt", detail, F.concat(F.lit("duplicate-of:"), ref)
    )


CHECKS: list[Callable[..., DataFrame]] = [arithmetic_problems, date_problems, duplicate_problems]


def check_receipts(receipts: DataFrame, *, checks=CHECKS, **context: object) -> DataFrame:
    """Every check's problems in one table; add a function to `checks` to add a check."""
    problems = [check(receipts, **context).select(*PROBLEM) for check in checks]
    result = problems[0]
    for more in problems[1:]:
        result = result.unionByName(more)
    return result


def to_flags(problems: DataFrame) -> DataFrame:
    key = F.concat_ws(":", F.col("file_id").cast("string"), F.col("seq").cast("string"), "key")
    return problems.select(
        "file_id", "receipt_id", "type", F.lit("warning").alias("severity"), "detail",
        key.alias("dedupe_key"),
    )


def new_flags(problems: DataFrame, flags: DataFrame) -> DataFrame:
    """Problems as flags, without those that are open already (same type and key)."""
    from billmill.operators.registry import insert_if_absent

    open_ones = flags.filter(~F.col("resolved"))
    return insert_if_absent(to_flags(problems), open_ones, ["type", "dedupe_key"])


def items_add_up(receipts: DataFrame) -> DataFrame:
    """The form's hint: items against subtotal or total, ignoring targets that are zero."""
    near = lambda n: (F.col(n) != 0) & money.close(F.col("items_total"), F.col(n))
    ok = F.coalesce(near("subtotal"), F.lit(False)) | F.coalesce(near("total"), F.lit(False))
    hint = F.when(F.col("items") > 0, ok)
    return receipts.withColumn("items_add_up", hint)
