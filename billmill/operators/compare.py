"""Readers against each other and against confirmed answers; corrections; second reads."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billmill.functions import dates, text
from billmill.model import BUSY, LOCAL_ZONE
from billmill.operators import checks
from billmill.operators.files import resolve
from billmill.operators.skew import first_per_key, numbered

COMPARED = {"vendor": "vendor", "receipt_date": "date", "total": "total"}
SCORED = ("vendor", "receipt_number", "receipt_date", "subtotal", "tax", "total")
CHECKED = ("receipt_number", "receipt_date", "subtotal", "tax", "total")


def found_receipts(library: DataFrame) -> DataFrame:
    """Library receipts that say anything that can be compared, numbered again."""
    something = (
        F.col("total").isNotNull()
        | F.col("receipt_date").isNotNull()
        | (F.coalesce("vendor", F.lit("")) != "")
    )
    kept = library.filter(something).withColumnRenamed("seq", "_seq")
    return numbered(kept, ["file_id"], ["_seq"], "seq").drop("_seq")


def zipped(left: DataFrame, right: DataFrame, fields: list[str], names=("library", "second")):
    """Both readers' receipts side by side by position; either side may lack one."""
    sides = [
        df.select("file_id", "seq", F.struct(*fields).alias(name))
        for df, name in zip((left, right), names, strict=True)
    ]
    return sides[0].join(sides[1], ["file_id", "seq"], "full")


def side_by_side(pairs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row per compared field: (…, field, library, second, same)."""
    rows = []
    for name, label in fields.items():
        mine, theirs = F.col(f"library.{name}"), F.col(f"second.{name}")
        same = text.same_text(mine, theirs) if name == "vendor" else mine == theirs
        rows.append(
            F.struct(
                F.lit(label).alias("field"), mine.cast("string").alias("library"),
                theirs.cast("string").alias("second"), same.alias("same"),
            )
        )
    keys = [c for c in pairs.columns if c not in ("library", "second")]
    return pairs.select(*keys, F.posexplode(F.array(*rows)).alias("at", "f")).select(*keys, "at", "f.*")


def disagreements(library: DataFrame, second: DataFrame) -> DataFrame:
    """(file_id, seq, field, library, second): a differing number of receipts first, else
    fields both readers have and do not agree on. Files the library saw nothing in are out."""
    found = found_receipts(library)
    mine = found.groupBy("file_id").agg(F.count("*").alias("_mine"))
    theirs = second.groupBy("file_id").agg(F.count("*").alias("_theirs"))
    counts = mine.join(theirs, "file_id", "left").fillna(0, ["_theirs"])
    uneven = counts.filter("_mine <> _theirs").select(
        "file_id", F.lit(0).alias("seq"), F.lit(-1).alias("at"), F.lit("receipts").alias("field"),
        F.col("_mine").cast("string").alias("library"), F.col("_theirs").cast("string").alias("second"),
        F.col("_theirs").alias("of"),
    )
    even = counts.filter("_mine = _theirs").select("file_id", F.col("_theirs").alias("of"))
    pairs = zipped(found, second, list(COMPARED)).join(even, "file_id")
    rows = side_by_side(pairs, COMPARED)
    both = F.col("library").isNotNull() & F.col("second").isNotNull()
    differing = rows.filter(both & ~F.col("same"))
    return uneven.unionByName(differing.select(*uneven.columns))


def as_text(differences: DataFrame) -> DataFrame:
    """One sentence part per file: '...; ...' in receipt and field order."""
    values = F.concat(F.lit(" (library "), "library", F.lit(", AI "), "second", F.lit(")"))
    which = F.when(
        (F.col("of") > 1) & (F.col("at") >= 0),
        F.concat(F.lit("receipt "), F.col("seq").cast("string"), F.lit(": ")),
    ).otherwise("")
    name = F.when(F.col("at") < 0, "the number of receipts").otherwise(F.col("field"))
    part = F.concat(which, name, values).alias("part")
    packed = F.array_sort(F.collect_list(F.struct("seq", "at", part)))
    return differences.groupBy("file_id").agg(
        F.array_join(F.transform(packed, lambda x: x["part"]), "; ").alias("differences")
    )


def form_differences(library: DataFrame, second: DataFrame) -> DataFrame:
    """The review screen's version: also number, subtotal and tax, compared as shown."""
    names = {n: n for n in SCORED}
    pairs = zipped(library, second, list(SCORED))
    rows = side_by_side(pairs, names)
    shown = lambda n: F.coalesce(n, F.lit("")) != ""
    return rows.filter(shown("library") & shown("second") & (F.col("library") != F.col("second"))).select(
        "file_id", "seq", "field", "library", "second"
    )


def decide_second_read(reads: DataFrame, acceptance: DataFrame, differences: DataFrame) -> DataFrame:
    """What a second read leads to. reads: file_id, run_id, label, error; acceptance: id,
    problems (with no least confidence); differences: file_id, differences."""
    checked = acceptance.select(F.col("id").alias("file_id"), "problems")
    joined = reads.join(checked, "file_id", "left").join(differences, "file_id", "left")
    run = F.col("run_id").cast("string")
    failed = F.col("error").isNotNull()
    bad = F.size(F.coalesce("problems", F.array().cast("array<string>"))) > 0
    conflict = F.col("differences").isNotNull()
    outcome = F.when(failed | bad, "failed").when(conflict, "conflict").otherwise("parsed")
    detail = (
        F.when(failed, F.concat("label", F.lit(" could not read this file: "), "error"))
        .when(
            bad,
            F.concat("label", F.lit("'s result also failed the checks: "), text.summarize(F.col("problems"))),
        )
        .when(conflict, F.concat(F.lit("The library and "), "label", F.lit(" disagree on "), "differences", F.lit(".")))
    )
    kind = F.when(failed | bad, "validation_failed").when(conflict, "parser_conflict")
    key = F.when(failed | bad, F.concat(F.lit("ai-failed:"), run)).when(
        conflict, F.concat(F.lit("conflict:"), run)
    )
    status = F.when(failed | bad | conflict, "flagged").otherwise("parsed")
    return joined.select(
        "file_id", "run_id", outcome.alias("outcome"), status.alias("status"),
        kind.alias("flag_type"), key.alias("dedupe_key"), detail.alias("detail"),
    )


# --- runs ----------------------------------------------------------------------------------


def cached_reads(runs: DataFrame) -> DataFrame:
    """For each second read: the latest other successful one of the same bytes, provider and
    model. Each group shrinks to its two latest before the join."""
    ai = runs.filter(F.col("parser") == "ai")
    good = ai.filter(F.col("error").isNull() & F.col("has_result") & F.col("finished_at").isNotNull())
    keys = ["sha256", "provider", "model"]
    latest = first_per_key(good.select(*keys, "id"), keys, [F.col("id").desc()], how_many=2)
    two = latest.groupBy(*keys).agg(F.max("id").alias("_one"), F.min("id").alias("_two"))
    joined = ai.join(two, keys)
    other = F.when(F.col("_one") != F.col("id"), F.col("_one")).when(
        F.col("_two") != F.col("id"), F.col("_two")
    )
    return joined.withColumn("cached_id", other).filter("cached_id IS NOT NULL").select(
        "id", "file_id", "cached_id"
    )


def latest_library_run(runs: DataFrame) -> DataFrame:
    usable = runs.filter(~F.col("parser").isin("ai", "manual") & F.col("has_result"))
    return usable.groupBy("file_id").agg(F.max("id").alias("run_id"))


def accepted_runs(runs: DataFrame) -> DataFrame:
    """The newest accepted run of a file stays accepted; the earlier ones do not."""
    newest = runs.filter("accepted").groupBy("file_id").agg(F.max("id").alias("_newest"))
    joined = runs.join(newest, "file_id", "left")
    stays = F.coalesce(F.col("id") == F.col("_newest"), F.lit(False))
    return joined.withColumn("accepted", stays).drop("_newest")


def unapproved(runs: DataFrame) -> DataFrame:
    """Second reads without a complete approval."""
    complete = (
        (F.col("parser") == "ai")
        & F.col("provider").isNotNull()
        & (F.coalesce("model", F.lit("")) != "")
        & (F.coalesce("ai_approved_by", F.lit("")) != "")
        & F.col("ai_approved_at").isNotNull()
    )
    return runs.filter(~complete)


def used_per_day(runs: DataFrame, zone: str = LOCAL_ZONE) -> DataFrame:
    """Approved second reads per local day; cached ones cost nothing and are not counted."""
    counted = runs.filter(
        (F.col("parser") == "ai") & F.col("cached_from_id").isNull() & F.col("ai_approved_at").isNotNull()
    )
    return counted.groupBy(dates.local_day(F.col("ai_approved_at"), zone).alias("day")).agg(
        F.count("*").alias("used")
    )


def admit_batches(requests: DataFrame, used: DataFrame, cap: int) -> DataFrame:
    """Each request (day, batch_id, file_id, at) batch against what is left of its day's cap, all
    of it or nothing, in the order in which batches were first asked for (ties by id). An
    admitted batch uses up what it asked for before the next one's turn."""
    sizes = requests.groupBy("day", "batch_id").agg(F.count("*").alias("asked"), F.min("at").alias("at"))
    days = sizes.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("at", "batch_id", "asked"))).alias("batches"))
    left = F.greatest(F.lit(cap) - F.coalesce("used", F.lit(0)), F.lit(0)).cast("bigint")
    answer = "array<struct<batch_id:bigint,asked:bigint,remaining:bigint,admitted:boolean>>"

    def decide(state: Column, batch: Column) -> Column:
        admitted = batch["asked"] <= state["left"]
        said = F.struct(batch["batch_id"].cast("bigint").alias("batch_id"), batch["asked"].alias("asked"),
                        state["left"].alias("remaining"), admitted.alias("admitted"))
        after = F.when(admitted, state["left"] - batch["asked"]).otherwise(state["left"])
        return F.struct(after.alias("left"), F.array_append(state["said"], said).alias("said"))

    start = F.struct(left.alias("left"), F.array().cast(answer).alias("said"))
    said = F.aggregate("batches", start, decide, lambda state: state["said"])
    return days.join(used, "day", "left").select("day", F.explode(said).alias("x")).select("day", "x.*")


def least_confidence(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy("run_id").agg(F.min("confidence").alias("confidence"))


def best_values(files: DataFrame, stored: DataFrame, run_receipts: DataFrame) -> DataFrame:
    """What a form starts from: stored receipts; else those of the latest run that has any;
    else one blank row. stored: file_id, seq, fields; run_receipts: also run_id."""
    fields = [c for c in stored.columns if c not in ("file_id", "seq")]
    without = files.select(F.col("id").alias("file_id")).join(
        stored.select("file_id").distinct(), "file_id", "left_anti"
    )
    latest = run_receipts.groupBy("file_id").agg(F.max("run_id").alias("run_id"))
    chosen = latest.join(without, "file_id", "left_semi")
    read = run_receipts.join(chosen, ["file_id", "run_id"])
    blank = without.join(latest, "file_id", "left_anti")
    kinds = dict(stored.dtypes)
    return (
        stored.select("file_id", "seq", *fields, F.lit("stored").alias("origin"))
        .unionByName(read.select("file_id", "seq", *fields, F.lit("read").alias("origin")))
        .unionByName(
            blank.select(
                "file_id", F.lit(1).alias("seq"),
                *[F.lit(None).cast(kinds[f]).alias(f) for f in fields], F.lit("blank").alias("origin"),
            )
        )
    )


def overlay(receipts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrected files' receipts are replaced; the others stay."""
    corrected = corrections.select("file_id").distinct()
    kept = receipts.join(corrected, "file_id", "left_anti")
    return kept.unionByName(corrections, allowMissingColumns=True)


def overlay_runs(runs: DataFrame, corrections: DataFrame, now: Column) -> DataFrame:
    """Corrected files' runs stay as history; the new manual run is the accepted one."""
    corrected = corrections.groupBy("file_id").agg(F.min("run_id").alias("id"))
    marked = runs.join(corrected.select("file_id", F.lit(True).alias("_hit")), "file_id", "left")
    kept = marked.withColumn("accepted", F.col("accepted") & F.col("_hit").isNull()).drop("_hit")
    manual = corrected.select(
        "id", "file_id", F.lit("manual").alias("parser"), F.lit(True).alias("accepted"),
        F.lit(True).alias("has_result"), now.alias("finished_at"), now.alias("created_at"),
    )
    return kept.unionByName(manual, allowMissingColumns=True)


def refused_corrections(corrections: DataFrame, files: DataFrame, categories: DataFrame) -> DataFrame:
    """(file_id, reason) of files whose correction can't be taken: unknown, still being read, or
    with a receipt in an unknown category. One bad receipt refuses its file."""
    known = categories.select(F.col("id").alias("category_override_id"), F.lit(True).alias("_known"))
    asked = corrections.join(known, "category_override_id", "left")
    bad = F.col("category_override_id").isNotNull() & F.col("_known").isNull()
    per_file = asked.groupBy("file_id").agg(F.bool_or(bad).alias("_bad"))
    there = files.select(F.col("id").alias("file_id"), "status")
    reason = (
        F.when(F.col("status").isNull(), "unknown_file")
        .when(F.col("status").isin(*BUSY), "busy")
        .when(F.col("_bad"), "unknown_category")
    )
    judged = per_file.join(there, "file_id", "left").select("file_id", reason.alias("reason"))
    return judged.filter(F.col("reason").isNotNull())


def resolve_flags(flags: DataFrame, problems: DataFrame, touched: DataFrame, user: str, now: Column):
    """Open flags of the touched files are closed by the person; what the checks find in the
    corrected receipts is kept beside them, closed as well: the person has seen it. New flags
    have no id yet."""
    kept = resolve(flags, touched.select("file_id", F.lit(user).alias("person")), "file_id", now)
    seen = checks.to_flags(problems).withColumns(
        {"resolved": F.lit(True), "resolved_by": F.lit(user), "resolved_at": now}
    )
    return kept.unionByName(seen, allowMissingColumns=True)


def resolve_files(files: DataFrame, touched: DataFrame, now: Column) -> DataFrame:
    """Corrected files are resolved, without an error, as of now."""
    marked = files.join(touched.select(F.col("file_id").alias("id"), F.lit(True).alias("_hit")), "id", "left")
    hit = F.col("_hit").isNotNull()
    return marked.withColumns({
        "status": F.when(hit, "resolved").otherwise(F.col("status")),
        "error": F.when(~hit, F.col("error")),
        "status_changed_at": F.when(hit, now).otherwise(F.col("status_changed_at")),
    }).select(files.columns)


def correct(
    corrections: DataFrame,
    tables: dict[str, DataFrame],
    named: Callable[[DataFrame, DataFrame], DataFrame],
    *, user: str, now: Column, today: Column,
) -> dict[str, DataFrame]:
    """The tables after a person's corrections, as one change: corrected receipts replace the
    file's, their manual run is the accepted one, the file is resolved, its open flags are closed,
    and the checks run again over the corrected receipts, their findings closed at once. Files
    whose correction is refused keep everything; they are listed in `refused`.

    `tables` holds receipts, runs, flags, files and categories as they are, and `named` gives
    receipts what the checks ask for (vendor, normalized_name, status, items_total, items) from
    the files beside them. Duplicates are looked for among all receipts after the change. Write
    the results table by table; each of them can be written again when a job is repeated.
    """
    refused = refused_corrections(corrections, tables["files"], tables["categories"])
    taken = corrections.join(refused, "file_id", "left_anti")
    touched = taken.select("file_id").distinct()
    receipts = overlay(tables["receipts"], taken)
    files = resolve_files(tables["files"], touched, now)
    problems = checks.check_receipts(
        named(taken, files), today=today, stored=named(receipts, files), symmetric=True
    )
    return {
        "receipts": receipts,
        "runs": overlay_runs(tables["runs"], taken, now),
        "flags": resolve_flags(tables["flags"], problems, touched, user, now),
        "files": files,
        "refused": refused,
    }


# --- against confirmed answers ----------------------------------------------------------------


def scored(expected: DataFrame, read: DataFrame, fields=SCORED) -> DataFrame:
    """(file_id, field, compared, matched) per expected receipt: fields with an answer; a
    receipt that was not read misses them all, extra ones are passed over."""
    pairs = expected.select("file_id", "seq", F.struct(*fields).alias("library")).join(
        read.select("file_id", "seq", F.struct(*fields).alias("second")), ["file_id", "seq"], "left"
    )
    rows = side_by_side(pairs, {f: f for f in fields}).filter("library IS NOT NULL")
    hit = F.coalesce(F.col("same"), F.lit(False)) & F.col("second").isNotNull()
    return rows.select("file_id", "field", F.lit(1).alias("compared"), hit.cast("int").alias("matched"))


def accuracy(scores: DataFrame, *keys: str) -> DataFrame:
    """Matched of compared, per field or per file."""
    sums = scores.groupBy(*keys).agg(
        F.sum("compared").alias("compared"), F.sum("matched").alias("matched")
    )
    return sums.withColumn("accuracy", F.round(F.col("matched") / F.col("compared"), 4))


def status_accuracy(statuses: DataFrame) -> DataFrame:
    return statuses.agg(
        F.count("*").alias("files"), F.count_if(F.col("status") == F.col("expected")).alias("as_expected")
    )


def regressions(expected: DataFrame, read: DataFrame) -> DataFrame:
    """(file_id, seq, field, expected, read): confirmed fields read wrong, and files with the
    wrong number of receipts (seq 0). The vendor is left out: people tidy it."""
    wanted = expected.groupBy("file_id").agg(F.count("*").alias("_wanted"))
    got = read.groupBy("file_id").agg(F.count("*").alias("_got"))
    counts = wanted.join(got, "file_id", "left").fillna(0, ["_got"])
    uneven = counts.filter("_wanted <> _got").select(
        "file_id", F.lit(0).alias("seq"), F.lit("receipts").alias("field"),
        F.col("_wanted").cast("string").alias("expected"), F.col("_got").cast("string").alias("read"),
    )
    pairs = expected.select("file_id", "seq", F.struct(*CHECKED).alias("library")).join(
        read.select("file_id", "seq", F.struct(*CHECKED).alias("second")), ["file_id", "seq"]
    )
    rows = side_by_side(pairs, {f: f for f in CHECKED}).filter("library IS NOT NULL")
    folded = lambda n: F.lower(F.trim(n))
    same = F.when(F.col("field") == "receipt_number", folded("library") == folded("second")).otherwise(
        F.col("same")
    )
    wrong = rows.filter(~F.coalesce(same, F.lit(False)))
    return uneven.unionByName(
        wrong.select("file_id", "seq", "field", F.col("library").alias("expected"), F.col("second").alias("read"))
    )


def right_and_wrong(expected: DataFrame, problems: DataFrame) -> DataFrame:
    """How many files were read without any problem, and how many with one."""
    files = expected.select("file_id").distinct()
    bad = problems.select("file_id").distinct().withColumn("_bad", F.lit(1))
    joined = files.join(bad, "file_id", "left")
    return joined.agg(
        F.count_if(F.col("_bad").isNull()).alias("right"), F.count("_bad").alias("wrong")
    )
