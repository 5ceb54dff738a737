"""Uploads, vendors and stored receipts: duplicates, reference numbers, deletion."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billmill.functions import text
from billmill.model import BUSY, MAX_FILES_PER_BATCH, MAX_UPLOAD_BYTES
from billmill.operators.skew import first_per_key, numbered, with_lookup
from billmill.session import cut


def normalized_names(vendors: DataFrame) -> DataFrame:
    """Vendors with the name of the earliest one that differs only in case. The earliest is
    found by a partial aggregate, so a name printed a billion times stays one row per task."""
    folded = vendors.withColumn("_folded", F.lower("raw_name"))
    earliest = folded.groupBy("_folded").agg(F.min_by("raw_name", "id").alias("normalized_name"))
    return folded.join(earliest, "_folded").drop("_folded")


def vendor_key(names: DataFrame, printed: str, vendors: DataFrame) -> DataFrame:
    """Adds `vendor_key`: the normalized name a printed one is known by, in lower case."""
    known = (
        vendors.withColumn("_folded", F.lower("raw_name"))
        .groupBy("_folded")
        .agg(F.min_by("normalized_name", "id").alias("_known"))
    )
    raw = F.coalesce(text.clean_vendor(F.col(printed)), F.trim(F.col(printed)))
    keyed = names.withColumn("_raw", raw).withColumn("_folded", F.lower("_raw"))
    joined = keyed.join(known, "_folded", "left")
    key = text.blank_to_null(F.lower(F.trim(F.coalesce("_known", "_raw"))))
    return joined.withColumn("vendor_key", key).drop("_raw", "_folded", "_known")


def mark_duplicates(files: DataFrame, id_col: str = "id", sha: str = "sha256") -> DataFrame:
    """Later files with the same bytes point to the earliest one. Only hashes that occur
    twice are joined back."""
    firsts = (
        files.groupBy(sha)
        .agg(F.min(id_col).alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    joined = files.join(firsts, sha, "left")
    original = F.when(F.col(id_col) > F.col("_first"), F.col("_first"))
    return joined.withColumn("duplicate_of_id", original).drop("_first")


def batch_fill(files: DataFrame, max_files: int = MAX_FILES_PER_BATCH) -> DataFrame:
    counts = files.groupBy("batch_id").agg(F.count("*").alias("files"))
    return counts.withColumn("full", F.col("files") >= max_files)


def register(
    uploads: DataFrame,
    existing: DataFrame,
    *,
    year: int,
    first_number: int,
    max_bytes: int = MAX_UPLOAD_BYTES,
    max_files: int = MAX_FILES_PER_BATCH,
) -> DataFrame:
    """Decide every upload (id, batch_id, name, size_bytes, sha256, confirmed), as if they came
    one after the other by id: `outcome` is registered, duplicate, too_large, bad_type or
    batch_full. A full batch is answered before a duplicate, and only a stored file makes later
    copies duplicates: the copy of a refused upload is a first one.

    Registered ones get a reference number, a storage path and the earliest file with the
    same bytes. `existing` holds (id, sha256, batch_id) of files already there.

    Which file of some bytes is stored first depends on which batches are full, and the other
    way round. Both are settled by rounds: the first stored file of each hash gives the
    duplicates, what is left fills the batches, and that gives the first stored files anew,
    until none changes. What an upload depends on came before it, so the rounds end, and with
    the one answer there is. Each round is two aggregations and a rank limit, so no hash or
    batch gathers its uploads in one task.
    """
    ext = text.extension_of(F.col("name"))
    checked = uploads.withColumn("ext", ext).withColumn(
        "_refused",
        F.when(F.col("size_bytes") > max_bytes, "too_large").when(F.col("ext").isNull(), "bad_type"),
    )
    refused = checked.filter(F.col("_refused").isNotNull())
    stored = existing.groupBy("sha256").agg(F.min("id").alias("_stored"))
    taken = existing.groupBy("batch_id").agg(F.count("*").alias("_taken"))
    sound = checked.filter(F.col("_refused").isNull()).join(stored, "sha256", "left").join(taken, "batch_id", "left")
    sound = cut(sound.withColumn("_taken", F.coalesce("_taken", F.lit(0))))

    firsts = cut(sound.groupBy("sha256").agg(F.min("id").alias("_first")))
    while True:
        decided = _decided(sound, firsts, max_files)
        kept = decided.filter("outcome = 'registered'").groupBy("sha256").agg(F.min("id").alias("_first"))
        kept = cut(kept)
        changed = kept.join(firsts, ["sha256", "_first"], "left_anti").isEmpty() and (
            firsts.join(kept, ["sha256", "_first"], "left_anti").isEmpty()
        )
        firsts = kept
        if changed:
            break
    is_registered = F.col("outcome") == "registered"
    numbers = F.col("id") + F.lit(first_number)
    path = F.concat(F.substring("sha256", 1, 2), F.lit("/"), "sha256", F.lit("."), "ext")
    answered = decided.select(
        "id", "batch_id", "outcome", "duplicate_of_id",
        F.when(is_registered, text.ref_no(numbers, F.lit(year))).alias("ref_no"),
        F.when(is_registered, path).alias("storage_path"),
    )
    blank = F.lit(None).cast("string")
    return answered.unionByName(refused.select(
        "id", "batch_id", F.col("_refused").alias("outcome"), F.lit(None).cast("bigint").alias("duplicate_of_id"),
        blank.alias("ref_no"), blank.alias("storage_path"),
    ))


def _decided(sound: DataFrame, firsts: DataFrame, max_files: int) -> DataFrame:
    """Outcome and duplicate_of_id of sound uploads, given the first stored file of each hash."""
    seen = sound.join(firsts, "sha256", "left")
    earlier = F.when(F.col("id") > F.col("_first"), F.col("_first"))
    seen = seen.withColumn("_original", F.coalesce("_stored", earlier))
    is_copy = F.col("_original").isNotNull() & ~F.col("confirmed")
    wanted = seen.filter(~is_copy & (F.col("_taken") < max_files)).select("batch_id", "id", "_taken")
    filling = first_per_key(wanted, ["batch_id"], ["id"], how_many=max_files, rank="_place")
    last = filling.filter(F.col("_place") == max_files - F.col("_taken")).select("batch_id", F.col("id").alias("_last"))
    full = (F.col("_taken") >= max_files) | F.coalesce(F.col("id") > F.col("_last"), F.lit(False))
    outcome = F.when(full, "batch_full").when(is_copy, "duplicate").otherwise("registered")
    decided = seen.join(last, "batch_id", "left").withColumn("outcome", outcome)
    return decided.withColumn("duplicate_of_id", F.when(~full, F.col("_original")))


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose key is not there yet, one per key (the first by the other columns)."""
    rest = [c for c in new.columns if c not in keys]
    picked = F.min(F.struct(*rest)).alias("_row") if rest else F.count("*").alias("_row")
    one = new.groupBy(*keys).agg(picked)
    if rest:
        one = one.select(*keys, "_row.*")
    else:
        one = one.select(*keys)
    return one.join(existing.select(*keys), keys, "left_anti").select(*new.columns)


def new_vendors(printed: DataFrame, vendors: DataFrame) -> DataFrame:
    """Vendor rows that receipts bring with them: raw name, and the normalized name of the
    earliest known vendor that matches ignoring case, or of the first new form."""
    raw = printed.select(
        F.coalesce(text.clean_vendor(F.col("vendor")), F.col("vendor")).alias("raw_name"), "at"
    )
    fresh = insert_if_absent(raw, vendors, ["raw_name"]).withColumn("_folded", F.lower("raw_name"))
    known = (
        vendors.withColumn("_folded", F.lower("normalized_name"))
        .groupBy("_folded")
        .agg(F.min_by("normalized_name", "id").alias("_known"))
    )
    own = fresh.groupBy("_folded").agg(F.min_by("raw_name", F.struct("at", "raw_name")).alias("_own"))
    joined = fresh.join(known, "_folded", "left").join(own, "_folded")
    return joined.select("raw_name", F.coalesce("_known", "_own").alias("normalized_name"))


def store_receipts(read: DataFrame, vendors: DataFrame, *, manual: bool = False) -> DataFrame:
    """Rows for the receipts table from accepted reads (file_id, file_ref_no, run_id, order
    `at`, the fields). Position in the file gives the reference; the vendor the category."""
    complete = read.filter(
        F.col("vendor").isNotNull() & F.col("receipt_date").isNotNull() & F.col("total").isNotNull()
    )
    placed = numbered(complete, ["file_id"], ["at"], "seq").withColumn(
        "raw_name", F.coalesce(text.clean_vendor(F.col("vendor")), F.col("vendor"))
    )
    one = first_per_key(vendors, ["raw_name"], ["id"]).select(
        "raw_name", F.col("id").alias("vendor_id"), "normalized_name", "default_category_id"
    )
    joined = placed.join(one, "raw_name", "left")
    confidence = F.lit(None).cast("double") if manual else F.col("confidence")
    return joined.select(
        "file_id", "run_id", "seq",
        text.receipt_ref_no(F.col("file_ref_no"), F.col("seq")).alias("ref_no"),
        "vendor_id", "receipt_number", "receipt_date", "subtotal", "tax", "total",
        F.col("default_category_id").alias("category_auto_id"), confidence.alias("confidence"),
    )


def promote_copies(files: DataFrame, removed: DataFrame) -> DataFrame:
    """The files that stay. Copies of a removed original point to its earliest copy, which
    becomes the original. `removed` holds the ids."""
    stay = files.join(removed.select("id"), "id", "left_anti")
    gone = removed.select(F.col("id").alias("duplicate_of_id"))
    orphans = stay.join(gone, "duplicate_of_id", "left_semi")
    heirs = orphans.groupBy("duplicate_of_id").agg(F.min("id").alias("_heir"))
    joined = with_lookup(stay, heirs, "duplicate_of_id", "duplicate_of_id")
    pointer = (
        F.when(F.col("_heir").isNull(), F.col("duplicate_of_id"))
        .when(F.col("_heir") == F.col("id"), F.lit(None))
        .otherwise(F.col("_heir"))
    )
    return joined.withColumn("duplicate_of_id", pointer).drop("_heir").select(*files.columns)


def removable(files: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked-for files that may go: those being processed stay."""
    return files.join(asked.select("id"), "id", "left_semi").filter(~F.col("status").isin(*BUSY))


def delete_files(tables: dict[str, DataFrame], asked: DataFrame) -> dict[str, DataFrame]:
    """Every table without the removed files' rows, plus `unused_paths`: stored bytes no
    file names any more."""
    files = tables["files"]
    gone = removable(files, asked).select("id", "storage_path")
    kept = promote_copies(files, gone)
    by_file = gone.select(F.col("id").alias("file_id"))
    result = {"files": kept}
    for name in ("flags", "receipts", "runs"):
        if name in tables:
            result[name] = tables[name].join(by_file, "file_id", "left_anti")
    if "line_items" in tables and "receipts" in tables:
        dropped = tables["receipts"].join(by_file, "file_id", "left_semi")
        dropped = dropped.select(F.col("id").alias("receipt_id"))
        result["line_items"] = tables["line_items"].join(dropped, "receipt_id", "left_anti")
    paths = gone.select("storage_path").distinct()
    result["unused_paths"] = paths.join(kept.select("storage_path"), "storage_path", "left_anti")
    return result
