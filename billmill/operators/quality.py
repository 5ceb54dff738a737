"""Expectations: the model's constraints as rules that list the rows breaking them."""

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billmill.functions.text import padded
from billmill.model import (
    AI_PROVIDERS,
    FILE_KINDS,
    FILE_STATUSES,
    FLAG_TYPES,
    LEARNED_FIELDS,
    LIBRARY_PARSERS,
    ROLES,
    RUN_PARSERS,
    SEVERITIES,
)


@dataclass(frozen=True)
class RowRule:
    """Every row must make `holds` true or null, as a CHECK does."""

    name: str
    table: str
    holds: Column


@dataclass(frozen=True)
class UniqueRule:
    name: str
    table: str
    keys: Sequence[Column]
    where: Column | None = None


@dataclass(frozen=True)
class ReferenceRule:
    """Every non-null key must exist in the other table."""

    name: str
    table: str
    keys: Sequence[str]
    other: str
    other_keys: Sequence[str]


def c(name: str) -> Column:
    return F.col(name)


def clean(name: str) -> Column:
    return (c(name) != "") & (c(name) == F.trim(name)) & ~c(name).rlike(r"[\x00-\x1f\x7f]")


def safe_name(name: str) -> Column:
    return (c(name) != "") & ~c(name).rlike(r"[/\\\x00-\x1f\x7f]")


def relative_path(name: str) -> Column:
    return (c(name) != "") & ~F.substring(name, 1, 1).isin("/", "\\") & (F.instr(name, "..") == 0)


def lower_case(name: str) -> Column:
    return (c(name) != "") & (c(name) == F.lower(name))


def one_of(name: str, values: Sequence[str]) -> Column:
    return c(name).isin(*values)


def ref_matches_seq() -> Column:
    stem = F.regexp_replace("ref_no", "-[0-9]+$", "")
    return c("ref_no") == F.concat(stem, F.lit("-"), padded(c("seq"), 2))


def approval_fields_null() -> Column:
    return reduce(
        Column.__and__,
        [c(n).isNull() for n in ("provider", "model", "ai_approved_by", "ai_approved_at")],
    )


def row_rules() -> list[RowRule]:
    is_ai = c("parser") == "ai"
    approved = c("provider").isNotNull() & c("ai_approved_by").isNotNull()
    approved = approved & c("ai_approved_at").isNotNull()
    closed = c("resolved_by").isNotNull() & c("resolved_at").isNotNull()
    untouched = c("resolved_by").isNull() & c("resolved_at").isNull()
    succeeded = c("error").isNull() & c("has_result") & c("finished_at").isNotNull()
    receipt_ref = r"^REF-[0-9]{4}-[0-9]{6,}-[0-9]{2,}$"
    return [
        RowRule("name_clean", "categories", clean("name")),
        RowRule("file_ref_format", "files", c("ref_no").rlike(r"^REF-[0-9]{4}-[0-9]{6,}$")),
        RowRule("receipt_ref_format", "receipts", c("ref_no").rlike(receipt_ref)),
        RowRule("ref_matches_seq", "receipts", ref_matches_seq()),
        RowRule("sha256_format", "files", c("sha256").rlike("^[0-9a-f]{64}$")),
        RowRule("size_not_negative", "files", c("size_bytes") >= 0),
        RowRule("attempts_not_negative", "files", c("attempts") >= 0),
        RowRule("seq_positive", "receipts", c("seq") >= 1),
        RowRule("position_positive", "line_items", c("position") >= 1),
        RowRule("duration_not_negative", "runs", c("duration_ms") >= 0),
        RowRule("times_used_not_negative", "vendor_labels", c("times_used") >= 0),
        RowRule("original_name_safe", "files", safe_name("original_name")),
        RowRule("storage_path_relative", "files", relative_path("storage_path")),
        RowRule("not_copy_of_itself", "files", c("duplicate_of_id") != c("id")),
        RowRule("receipt_confidence_range", "receipts", c("confidence").between(0, 1)),
        RowRule("run_confidence_range", "runs", c("confidence").between(0, 1)),
        RowRule("second_read_approved", "runs", ~is_ai | approved),
        RowRule("library_read_unapproved", "runs", is_ai | approval_fields_null()),
        RowRule("accepted_run_succeeded", "runs", ~c("accepted") | succeeded),
        RowRule(
            "resolution_consistent",
            "flags",
            (c("resolved") & closed) | (~c("resolved") & untouched),
        ),
        RowRule("dedupe_key_not_empty", "flags", c("dedupe_key") != ""),
        RowRule("file_status_known", "files", one_of("status", FILE_STATUSES)),
        RowRule("file_kind_known", "files", one_of("kind", FILE_KINDS)),
        RowRule("run_parser_known", "runs", one_of("parser", RUN_PARSERS)),
        RowRule("run_provider_known", "runs", one_of("provider", AI_PROVIDERS)),
        RowRule("flag_type_known", "flags", one_of("type", FLAG_TYPES)),
        RowRule("flag_severity_known", "flags", one_of("severity", SEVERITIES)),
        RowRule("user_role_known", "users", one_of("role", ROLES)),
        RowRule("user_name_clean", "users", clean("display_name")),
        RowRule("label_clean", "vendor_labels", lower_case("label")),
        RowRule("vendor_key_clean", "vendor_labels", lower_case("vendor_key")),
        RowRule("label_field_known", "vendor_labels", one_of("field", LEARNED_FIELDS)),
        RowRule("raw_name_not_empty", "vendors", c("raw_name") != ""),
        RowRule("normalized_name_not_empty", "vendors", c("normalized_name") != ""),
        *[
            RowRule(f"receipt_{name}_given", "receipts", c(name).isNotNull())
            for name in ("vendor_id", "receipt_date", "total")
        ],
    ]


def unique_rules() -> list[UniqueRule]:
    return [
        UniqueRule("vendor_raw_name", "vendors", [c("raw_name")]),
        UniqueRule("file_ref_no", "files", [c("ref_no")]),
        UniqueRule("receipt_ref_no", "receipts", [c("ref_no")]),
        UniqueRule("receipt_seq", "receipts", [c("file_id"), c("seq")]),
        UniqueRule("item_position", "line_items", [c("receipt_id"), c("position")]),
        UniqueRule("vendor_label", "vendor_labels", [c("vendor_key"), c("field"), c("label")]),
        UniqueRule("category_name", "categories", [F.lower("name")]),
        UniqueRule("one_accepted_run", "runs", [c("file_id")], c("accepted")),
        UniqueRule("one_library_run", "runs", [c("file_id")], one_of("parser", LIBRARY_PARSERS)),
        UniqueRule("one_open_flag", "flags", [c("type"), c("dedupe_key")], ~c("resolved")),
    ]


def reference_rules() -> list[ReferenceRule]:
    return [
        ReferenceRule("file_batch", "files", ["batch_id"], "upload_batches", ["id"]),
        ReferenceRule("file_original", "files", ["duplicate_of_id"], "files", ["id"]),
        ReferenceRule("run_file", "runs", ["file_id"], "files", ["id"]),
        ReferenceRule("run_cached_from", "runs", ["cached_from_id"], "runs", ["id"]),
        ReferenceRule("receipt_run", "receipts", ["run_id", "file_id"], "runs", ["id", "file_id"]),
        ReferenceRule("receipt_file", "receipts", ["file_id"], "files", ["id"]),
        ReferenceRule("receipt_vendor", "receipts", ["vendor_id"], "vendors", ["id"]),
        ReferenceRule("receipt_override", "receipts", ["category_override_id"], "categories", ["id"]),
        ReferenceRule("vendor_category", "vendors", ["default_category_id"], "categories", ["id"]),
        ReferenceRule("item_receipt", "line_items", ["receipt_id"], "receipts", ["id"]),
        ReferenceRule("flag_file", "flags", ["file_id"], "files", ["id"]),
        ReferenceRule("flag_receipt", "flags", ["receipt_id"], "receipts", ["id"]),
    ]


def rule(name: str) -> RowRule | UniqueRule | ReferenceRule:
    for known in [*row_rules(), *unique_rules(), *reference_rules()]:
        if known.name == name:
            return known
    raise KeyError(name)


def breaks_row_rule(df: DataFrame, holds: Column) -> DataFrame:
    return df.filter(~F.coalesce(holds, F.lit(True)))


def breaks_unique(df: DataFrame, keys: Sequence[Column], where: Column | None = None) -> DataFrame:
    """The keys that occur more than once, as text, with their number of rows."""
    rows = df if where is None else df.filter(where)
    named = [key.cast("string").alias(f"k{i}") for i, key in enumerate(keys)]
    columns = [f"k{i}" for i in range(len(keys))]
    known = rows.select(*named).dropna(subset=columns)
    counts = known.groupBy(*columns).agg(F.count("*").alias("rows")).filter("rows > 1")
    return counts.select(F.concat_ws("|", *columns).alias("key"), "rows")


def breaks_reference(
    df: DataFrame, keys: Sequence[str], other: DataFrame, other_keys: Sequence[str]
) -> DataFrame:
    there = other.select(*[c(o).alias(k) for k, o in zip(keys, other_keys, strict=True)])
    return df.dropna(subset=list(keys)).join(there, list(keys), "left_anti")


def expect(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """The rows (or keys) of its table that break the named rule."""
    known = rule(name)
    df = tables[known.table]
    if isinstance(known, RowRule):
        return breaks_row_rule(df, known.holds)
    if isinstance(known, UniqueRule):
        return breaks_unique(df, known.keys, known.where)
    return breaks_reference(df, known.keys, tables[known.other], known.other_keys)


def row_rule_counts(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """How many rows break each rule of one table: one pass over it, whatever the number of
    rules."""
    broken = [F.count_if(~F.coalesce(r.holds, F.lit(True))).alias(r.name) for r in rules]
    counts = df.agg(*broken)
    pairs = ", ".join(f"'{r.name}', {r.name}" for r in rules)
    return counts.selectExpr(f"stack({len(rules)}, {pairs}) AS (rule, violations)")
