"""The receipt view and the searches over it: filters, totals, order, top N, pages."""

from dataclasses import dataclass, replace
from datetime import date
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billmill.model import COUNTED, PAGE_SIZE, TOP_LIMIT, WAITING

ROW_COLUMNS = (
    "receipt_date", "vendor", "receipt_number", "category", "subtotal", "tax", "total",
    "ref_no", "file_ref_no",
)


def view(
    receipts: DataFrame, files: DataFrame, vendors: DataFrame, categories: DataFrame
) -> DataFrame:
    """Receipts with their file, vendor and category; the only thing searches read."""
    f = files.select(
        F.col("id").alias("file_id"), F.col("ref_no").alias("file_ref_no"), F.col("status")
    )
    auto = (
        [] if "category_auto_id" in receipts.columns else [F.col("default_category_id").alias("_auto")]
    )
    v = vendors.select(
        F.col("id").alias("vendor_id"), F.col("normalized_name").alias("vendor"), *auto
    )
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    joined = receipts.drop("category_id").join(f, "file_id").join(v, "vendor_id")
    automatic = F.col("_auto") if auto else F.col("category_auto_id")
    with_category = joined.withColumn("category_id", F.coalesce("category_override_id", automatic))
    return with_category.join(c, "category_id", "left").select(
        "id", "ref_no", "file_ref_no", "status", "receipt_date", "vendor", "receipt_number",
        "category_id", "category", "subtotal", "tax", "total",
    )


class BadQuery(ValueError):
    """The filters contradict each other or are out of range."""


@dataclass(frozen=True)
class ReceiptQuery:
    date_from: date | None = None
    date_to: date | None = None
    vendor: str | None = None
    category_id: int | None = None
    min_total: Decimal | None = None
    max_total: Decimal | None = None
    sort: str = "date"
    limit: int | None = None
    page: int = 1

    def __post_init__(self) -> None:
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise BadQuery("From cannot be later than To.")
        for amount in (self.min_total, self.max_total):
            if amount is not None and amount < 0:
                raise BadQuery("Amounts cannot be negative.")
        if self.min_total is not None and self.max_total is not None:
            if self.min_total > self.max_total:
                raise BadQuery("The minimum amount cannot be more than the maximum.")
        if self.vendor is not None and len(self.vendor) > 255:
            raise BadQuery("Vendor names have at most 255 characters.")
        if self.sort not in ("date", "amount"):
            raise BadQuery("Sort by date or amount.")
        if self.limit is not None and not 1 <= self.limit <= TOP_LIMIT:
            raise BadQuery(f"The limit is 1 to {TOP_LIMIT}.")
        if self.page < 1:
            raise BadQuery("Pages start at 1.")

    @classmethod
    def of(cls, **filters: object) -> "ReceiptQuery":
        """From named filters; a name that is not a filter is refused."""
        unknown = filters.keys() - cls.__dataclass_fields__.keys()
        if unknown:
            raise BadQuery(f"Unknown filter: {sorted(unknown)[0]}")
        return cls(**filters)  # type: ignore[arg-type]


def with_default_dates(query: ReceiptQuery, today: date) -> ReceiptQuery:
    """With neither date given, the financial year so far."""
    if query.date_from is None and query.date_to is None:
        start = date(today.year - (today.month < 4), 4, 1)
        return replace(query, date_from=start, date_to=today)
    return query


def counted() -> Column:
    return F.col("status").isin(*COUNTED)


def predicates(query: ReceiptQuery) -> list[Column]:
    """The filters as columns; values only ever enter as literals."""
    tests = {
        "date_from": lambda v: F.col("receipt_date") >= F.lit(v),
        "date_to": lambda v: F.col("receipt_date") <= F.lit(v),
        "vendor": lambda v: F.col("vendor") == F.lit(v),
        "category_id": lambda v: F.col("category_id") == F.lit(v),
        "min_total": lambda v: F.col("total") >= F.lit(v),
        "max_total": lambda v: F.col("total") <= F.lit(v),
    }
    given = {name: getattr(query, name) for name in tests}
    return [counted()] + [tests[n](v) for n, v in given.items() if v is not None and v != ""]


def matching(receipts_view: DataFrame, query: ReceiptQuery) -> DataFrame:
    return receipts_view.filter(reduce(Column.__and__, predicates(query)))


def ordering(query: ReceiptQuery) -> list[Column]:
    by_date = [F.col("receipt_date"), F.col("ref_no")]
    return [F.col("total").desc(), *by_date] if query.sort == "amount" else by_date


def limited(receipts_view: DataFrame, query: ReceiptQuery) -> DataFrame:
    """Every match, or the first N of them when a limit is set."""
    rows = matching(receipts_view, query)
    return rows.orderBy(*ordering(query)).limit(query.limit) if query.limit else rows


def totals(rows: DataFrame) -> DataFrame:
    """count, sum (0 if none) and average (null if none), to the paisa."""
    return rows.agg(
        F.count("*").alias("receipts"),
        F.coalesce(F.sum("total"), F.lit(0)).cast("decimal(18,2)").alias("sum_total"),
        F.bround(F.sum("total") / F.count("total"), 2).cast("decimal(18,2)").alias("average_total"),
    )


def page(receipts_view: DataFrame, query: ReceiptQuery) -> DataFrame:
    """One page of rows in order; past the end it is empty."""
    offset = (query.page - 1) * PAGE_SIZE
    size = PAGE_SIZE if query.limit is None else min(PAGE_SIZE, query.limit - offset)
    rows = matching(receipts_view, query)
    if size <= 0:
        return rows.select(*ROW_COLUMNS).limit(0)
    return rows.orderBy(*ordering(query)).offset(offset).limit(size).select(*ROW_COLUMNS)


def page_after(receipts_view: DataFrame, query: ReceiptQuery, last: tuple, shown: int = 0) -> DataFrame:
    """The page after the row `last`: (date, reference), or (total, date, reference) when sorted
    by amount; `shown` rows came before, which counts when there is a limit. However deep the
    page, no task holds more than one page of rows: those before it are filtered out. Rows
    without a date come first, so a date of None stands for the last of them."""
    size = PAGE_SIZE if query.limit is None else min(PAGE_SIZE, query.limit - shown)
    rows = matching(receipts_view, query)
    if size <= 0:
        return rows.select(*ROW_COLUMNS).limit(0)
    *amount, day, ref = last
    day = F.lit(day).cast("date")
    dated = F.col("receipt_date")
    later = F.when(dated.isNull(), F.lit(False)).when(day.isNull(), F.lit(True)).otherwise(dated > day)
    after = later | (dated.eqNullSafe(day) & (F.col("ref_no") > F.lit(ref)))
    if query.sort == "amount":
        total = F.lit(amount[0]).cast("decimal(14,2)")
        lower = F.coalesce(F.col("total") < total, F.col("total").isNull() & total.isNotNull())
        after = lower | (F.col("total").eqNullSafe(total) & after)
    return rows.filter(after).orderBy(*ordering(query)).limit(size).select(*ROW_COLUMNS)


def waiting_for_review(files: DataFrame) -> DataFrame:
    return files.filter(F.col("status").isin(*WAITING)).agg(F.count("*").alias("waiting_for_review"))


def search(receipts_view: DataFrame, files: DataFrame, query: ReceiptQuery) -> DataFrame:
    """A whole search page as one row: totals over every match, the waiting count, the rows
    of one page (at most 50) as an array. All of it is one job: the single values are
    subqueries of the page."""
    sums = totals(limited(receipts_view, query)).select(F.struct("*")).scalar()
    waiting = waiting_for_review(files).scalar()
    rows = page(receipts_view, query)
    packed = rows.agg(F.collect_list(F.struct(*ROW_COLUMNS)).alias("_rows"))
    if query.sort == "amount":
        key = lambda r: F.struct(-r["total"], r["receipt_date"], r["ref_no"], r)
    else:
        key = lambda r: F.struct(r["receipt_date"], r["ref_no"], r)
    ordered = F.transform(
        F.array_sort(F.transform("_rows", lambda r: F.struct(key(r).alias("k"), r.alias("r")))),
        lambda x: x["r"],
    )
    return packed.select(
        sums["receipts"].alias("receipts"),
        sums["sum_total"].alias("sum_total"),
        sums["average_total"].alias("average_total"),
        waiting.alias("waiting_for_review"),
        ordered.alias("rows"),
    )


def vendor_names(receipts: DataFrame, vendors: DataFrame) -> DataFrame:
    """The normalized names of vendors that have a receipt."""
    used = receipts.select(F.col("vendor_id").alias("id")).distinct()
    return vendors.join(used, "id", "left_semi").select(
        F.col("normalized_name").alias("vendor")
    ).distinct()
