"""The field parsers by name, for DataFrames and for SQL text."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billmill.functions import dates, money, text

PARSERS: dict[str, Callable[[Column], Column]] = {
    "receipt_number": text.clean_receipt_number,
    "receipt_date": dates.parse_date,
    "vendor": text.clean_vendor,
    "total": money.parse_amount,
    "subtotal": money.parse_amount,
    "tax": money.parse_amount,
}



def _raw(pattern: str) -> str:
    """A pattern as SQL text that keeps its backslashes."""
    return f"r'{pattern}'"


COLLAPSED = f"trim(regexp_replace(value, {_raw(text.SPACES)}, ' '))"


def _day_sql(form: str, parts: tuple[int, int, int]) -> str:
    """The day that one match `m` of a printed form names."""
    day, month, year = (f"regexp_extract(m, {_raw('(?iU)' + form)}, {part})" for part in parts)
    if dates.MONTH in form:
        month = f"(instr('{dates.MONTH_STARTS}', lower(substring({month}, 1, 3))) + 2) div 3"
    century = f"try_cast({year} AS INT) + CASE WHEN try_cast({year} AS INT) < 100 THEN 2000 ELSE 0 END"
    return f"try_cast(concat(lpad(CAST({century} AS STRING), 4, '0'), '-', {month}, '-', {day}) AS DATE)"


def _dates_sql(form: str, before: str, after: str, parts: tuple[int, int, int]) -> str:
    """Every date of one printed form in `plain`, with its place."""
    pattern = _raw(f"(?iU){before}{form}{after}")
    pieces = f"split(regexp_replace(plain, {pattern}, '\\u0001$0'), '\\u0001')"
    place = f"length(array_join(slice({pieces}, 1, i + 1), ''))"
    return (
        f"transform(regexp_extract_all(plain, {pattern}, 0), "
        f"(m, i) -> named_struct('at', {place}, 'day', {_day_sql(form, parts)}))"
    )


# The parsers as SQL text, from the same patterns; Catalyst puts their text in place of the call.
SQL_FUNCTIONS = {
    "fy_start": ("day DATE", "DATE", "add_months(trunc(add_months(day, -3), 'YEAR'), 3)"),
    "within_a_rupee": (
        "a DECIMAL(14,2), b DECIMAL(14,2)", "BOOLEAN", "abs(a - b) <= CAST(1 AS DECIMAL(3,2))",
    ),
    "safe_cell": (
        "value STRING", "STRING",
        "CASE WHEN coalesce(value, '') RLIKE '^[=+\\\\-@\\\\t\\\\r]' "
        "THEN concat('\\'', value) ELSE coalesce(value, '') END",
    ),
    "clean_text": ("value STRING", "STRING", f"nullif({COLLAPSED}, '')"),
    "clean_vendor": (
        "value STRING", "STRING", f"nullif(substring(btrim({COLLAPSED}, ' :,-|*'), 1, 255), '')",
    ),
    "clean_receipt_number": (
        "value STRING", "STRING",
        f"CASE WHEN btrim({COLLAPSED}, ' :#.-') RLIKE {_raw(chr(92) + 'p{Nd}')} "
        f"THEN substring(btrim({COLLAPSED}, ' :#.-'), 1, 64) END",
    ),
    "parse_amount": (
        "value STRING", "DECIMAL(12,2)",
        "try_cast(regexp_extract(regexp_replace(btrim(regexp_replace(translate(trim(regexp_replace("
        f"value, {_raw(money.CURRENCY)}, '')), ', ', ''), r'^\\(+(.*?)\\)+$', '-$1'), '()'), '^--', ''), "
        "r'^-?[0-9]+(?:\\.[0-9]+)?$', 0) AS DECIMAL(12,2))",
    ),
    "first_date": (
        "plain STRING", "DATE",
        "CASE WHEN plain RLIKE '[0-9]' THEN array_min(filter(concat("
        + ", ".join(_dates_sql(*form) for form in dates.FORMS)
        + "), c -> c.day IS NOT NULL)).day END",
    ),
    "parse_date": ("value STRING", "DATE", f"first_date(translate({COLLAPSED}, '\\u0001', ' '))"),
}


def with_parsers(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds a column per entry: name -> (parser's field, column to parse)."""
    return df.withColumns({n: PARSERS[field](F.col(c)) for n, (field, c) in fields.items()})


def register_sql_functions(spark: SparkSession) -> None:
    """Offers the parsers to SQL text for this session, under their own names."""
    for name, (arguments, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}"
        )
