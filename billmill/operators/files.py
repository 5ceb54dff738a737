"""Files: lists, counts, recovery, detail with children, the attention report."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billmill.model import (
    ATTENTION,
    ATTENTION_REPORT_FILES,
    FILE_STATUSES,
    MAX_ATTEMPTS,
    PENDING_GRACE_SECONDS,
    RETRY_BACKOFF_SECONDS,
    SECOND_READ_ELIGIBLE,
    STUCK_AFTER_SECONDS,
)


def open_flags(files: DataFrame, flags: DataFrame) -> DataFrame:
    """Adds `open_flags`: flags are counted per file first, then joined."""
    counts = (
        flags.filter(~F.col("resolved"))
        .groupBy(F.col("file_id").alias("id"))
        .agg(F.count("*").alias("open_flags"))
    )
    joined = files.join(counts, "id", "left")
    return joined.withColumn("open_flags", F.coalesce("open_flags", F.lit(0)))


def needs_attention() -> Column:
    return F.col("status").isin(*ATTENTION) | (F.col("open_flags") > 0)


def name_or_reference_contains(term: str) -> Column:
    """Ignoring case; % and _ in the term mean themselves."""
    wanted = F.lower(F.lit(term))
    return (F.instr(F.lower("original_name"), wanted) > 0) | (F.instr(F.lower("ref_no"), wanted) > 0)


def find(files: DataFrame, status: str | None, search: str | None, attention: bool) -> DataFrame:
    """Files (with open_flags) that match the list's filters."""
    if attention:
        files = files.filter(needs_attention())
    if status is not None:
        files = files.filter(F.col("status") == F.lit(status))
    if search:
        files = files.filter(name_or_reference_contains(search))
    return files


def newest_page(files: DataFrame, page: int, page_size: int) -> DataFrame:
    return files.orderBy(F.col("id").desc()).offset((page - 1) * page_size).limit(page_size)


def with_originals(files: DataFrame, originals: DataFrame) -> DataFrame:
    """Adds the reference number of the file each one is a copy of."""
    side = originals.select(F.col("id").alias("duplicate_of_id"), F.col("ref_no").alias("copy_of"))
    return files.join(side, "duplicate_of_id", "left")


def lookup(files: DataFrame, keys: DataFrame) -> DataFrame:
    """Files by key text: all digits is an id, REF-... a reference, anything else nothing."""
    by_id = keys.filter(F.col("key").rlike(r"^[0-9]+$")).select(
        "key", F.col("key").try_cast("bigint").alias("id")
    )
    by_ref = keys.filter(F.col("key").rlike(r"^REF-[0-9]{4}-[0-9]{6,}$")).select(
        "key", F.col("key").alias("ref_no")
    )
    columns = ["key", *files.columns]
    found = files.join(by_id, "id").select(*columns)
    return found.unionByName(files.join(by_ref, "ref_no").select(*columns))


def status_counts(files: DataFrame) -> DataFrame:
    """One row per status, zero for absent ones."""
    counts = files.groupBy("status").agg(F.count("*").alias("files"))
    spark = files.sparkSession
    all_statuses = spark.createDataFrame([(s,) for s in FILE_STATUSES], "status string")
    joined = all_statuses.join(counts, "status", "left")
    return joined.select("status", F.coalesce("files", F.lit(0)).alias("files"))


def summary(files: DataFrame) -> DataFrame:
    """Totals over files with open_flags, in one aggregation."""
    return files.agg(
        F.count("*").alias("total"),
        F.count_if((F.col("status") == "parsed") & (F.col("open_flags") > 0)).alias("with_warnings"),
        F.count_if(needs_attention()).alias("needs_attention"),
    )


def count_of(files: DataFrame, *statuses: str) -> DataFrame:
    return files.agg(F.count_if(F.col("status").isin(*statuses)).alias("files"))


def waited_longer(column: str, now: Column, seconds: Column | int) -> Column:
    wait = F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
    return F.col(column) < now - wait


def due(files: DataFrame, now: Column) -> DataFrame:
    """Pending past the grace time, or failed with tries left and the back-off over."""
    pending = (F.col("status") == "pending") & waited_longer(
        "status_changed_at", now, PENDING_GRACE_SECONDS
    )
    retry = (
        (F.col("status") == "failed")
        & (F.col("attempts") < MAX_ATTEMPTS)
        & waited_longer("status_changed_at", now, F.col("attempts") * RETRY_BACKOFF_SECONDS)
    )
    return files.filter(pending | retry)


def reset_stuck(files: DataFrame, now: Column) -> DataFrame:
    """Files processing for too long go back to pending."""
    stuck = (F.col("status") == "processing") & waited_longer(
        "status_changed_at", now, STUCK_AFTER_SECONDS
    )
    return files.withColumns(
        {
            "status": F.when(stuck, "pending").otherwise(F.col("status")),
            "status_changed_at": F.when(stuck, now).otherwise(F.col("status_changed_at")),
        }
    )


def unfinished_second_reads(runs: DataFrame, now: Column) -> DataFrame:
    return runs.filter(
        (F.col("parser") == "ai")
        & F.col("finished_at").isNull()
        & waited_longer("created_at", now, STUCK_AFTER_SECONDS)
    )


def second_read_eligible(files: DataFrame) -> DataFrame:
    return files.filter(F.col("status").isin(*SECOND_READ_ELIGIBLE))


def reject(files: DataFrame, flags: DataFrame, asked: DataFrame, now: Column):
    """Rejects files (asked: id, reason, person) and resolves their open flags."""
    decisions = asked.select("id", "reason", "person")
    joined = files.join(decisions, "id", "left")
    hit = F.col("reason").isNotNull() & ~F.col("status").isin("processing", "ai_processing")
    reason = F.concat(F.lit("Rejected: "), F.trim(F.regexp_replace("reason", r"\s+", " ")))
    updated = joined.withColumns(
        {
            "error": F.when(hit, reason).otherwise(F.col("error")),
            "status_changed_at": F.when(hit, now).otherwise(F.col("status_changed_at")),
            "status": F.when(hit, "rejected").otherwise(F.col("status")),
        }
    ).select(*files.columns)
    movable = files.filter(~F.col("status").isin("processing", "ai_processing")).select("id")
    closers = decisions.join(movable, "id", "left_semi").select(
        F.col("id").alias("file_id"), "person"
    )
    return updated, resolve(flags, closers, "file_id", now)


def resolve(flags: DataFrame, closers: DataFrame, key: str, now: Column) -> DataFrame:
    """Marks open flags as looked at, for the keys in `closers` (key, person)."""
    joined = flags.join(closers.select(key, "person"), key, "left")
    hit = F.col("person").isNotNull() & ~F.col("resolved")
    return joined.withColumns(
        {
            "resolved_by": F.when(hit, F.col("person")).otherwise(F.col("resolved_by")),
            "resolved_at": F.when(hit, now).otherwise(F.col("resolved_at")),
            "resolved": F.col("resolved") | hit,
        }
    ).select(*flags.columns)


def children(rows: DataFrame, parent: str, order: list[Column], name: str, keep: list[str]):
    """One array per parent, in order. Parents are files or receipts, whose rows are bounded
    by the upload size limit."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    packed = F.array_sort(F.collect_list(F.struct(*keys, F.struct(*keep).alias("row"))))
    grouped = rows.groupBy(parent).agg(packed.alias(name))
    return grouped.withColumn(name, F.transform(name, lambda x: x["row"]))


def detail(
    files: DataFrame, receipts: DataFrame, vendors: DataFrame, items: DataFrame,
    flags: DataFrame, runs: DataFrame,
) -> DataFrame:
    """Each file with its receipts (by seq, with items), flags (open first) and runs (newest
    first) as nested arrays."""
    item_lists = children(
        items, "receipt_id", [F.col("position")], "line_items",
        ["position", "description", "quantity", "unit_price", "amount"],
    ).withColumnRenamed("receipt_id", "id")
    printed = vendors.select(F.col("id").alias("vendor_id"), F.col("raw_name").alias("vendor"))
    full = receipts.join(printed, "vendor_id", "left").join(item_lists, "id", "left")
    by_file = [
        children(full, "file_id", [F.col("seq")], "receipts",
                 ["id", "ref_no", "seq", "vendor", "receipt_number", "receipt_date", "subtotal",
                  "tax", "total", "line_items"]),
        children(flags, "file_id", [F.col("resolved").cast("int"), F.col("id")], "flags",
                 ["id", "receipt_id", "type", "severity", "detail", "resolved", "resolved_by"]),
        children(runs, "file_id", [-F.col("id")], "runs",
                 ["id", "parser", "accepted", "error", "ai_approved_by", "finished_at"]),
    ]
    result = files
    for side in by_file:
        result = result.join(side.withColumnRenamed("file_id", "id"), "id", "left")
    return result


def attention_report(
    files: DataFrame, receipts: DataFrame, vendors: DataFrame, items: DataFrame,
    flags: DataFrame, runs: DataFrame, limit: int = ATTENTION_REPORT_FILES,
) -> DataFrame:
    """What the error report holds: the first files that need a person, with their children.
    The files are chosen first, so only their children are gathered."""
    chosen = open_flags(files, flags).filter(needs_attention()).orderBy("id").limit(limit)
    ids = chosen.select(F.col("id").alias("file_id"))
    few = F.broadcast(ids)  # at most `limit` ids
    mine = receipts.join(few, "file_id", "left_semi")
    receipt_ids = mine.select(F.col("id").alias("receipt_id"))
    return detail(
        chosen, mine, vendors, items.join(receipt_ids, "receipt_id", "left_semi"),
        flags.join(few, "file_id", "left_semi"), runs.join(few, "file_id", "left_semi"),
    )
