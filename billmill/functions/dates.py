"""Dates as printed (day first) and the ranges reports use. Unreal dates are null."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from billmill.functions.text import by_alphabet, collapsed, let

# fixed values: how dates are printed
MONTH = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
ISO = r"(\d{4})-(\d{1,2})-(\d{1,2})"
DAY_FIRST = r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4}|\d{2})"
DAY_MONTH_NAME = rf"(\d{{1,2}})(?:st|nd|rd|th)?[\s\-/.]*{MONTH}\.?[\s\-/.,]*(\d{{4}}|\d{{2}})"
MONTH_NAME_DAY = rf"{MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})"
MONTH_SEEN = r"(?iU)[jfmasond](?:an|eb|a[ry]|pr|u[nlg]|ep|ct|ov|ec)"  # in every text that names one
MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"

# The printed form, what may stand before and after it, and where day, month, year are. The form's
# first character is looked at first, which passes over most places.
FORMS = [
    (ISO, r"(?=\d)(?<!\d)", r"(?!\d)", (3, 2, 1)),
    (DAY_FIRST, r"(?=\d)(?<!\d)", r"(?!\d)", (1, 2, 3)),
    (DAY_MONTH_NAME, r"(?=\d)(?<!\d)", r"(?!\d)", (1, 2, 3)),
    (MONTH_NAME_DAY, r"(?=[jfmasond])\b", r"(?!\d)", (2, 1, 3)),
]
ANY_DATE = "(?:" + "|".join(form.replace("(", "(?:").replace("(?:?:", "(?:")
                            for form, *_ in FORMS) + ")"


def make_date(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts, given as text or numbers; null when there is no such day."""
    dash = F.lit("-")
    text = F.concat(year.cast("string"), dash, month.cast("string"), dash, day.cast("string"))
    return text.try_cast("date")


def month_number(name: Column) -> Column:
    at = F.instr(F.lit(MONTH_STARTS), F.lower(F.substring(name, 1, 3)))
    return F.when((at > 0) & (name != ""), (at + 2) / 3).cast("int")


def full_year(year: Column) -> Column:
    """Two-digit years are in this century."""
    number = year.cast("int")
    return F.when(number < 100, number + 2000).otherwise(number)


def _read(match: Column, form: str, parts: tuple[int, int, int]) -> Column:
    day, month, year = (F.regexp_extract(match, f"(?iU){form}", part) for part in parts)
    number = month if MONTH not in form else month_number(month).cast("string")
    return make_date(F.lpad(full_year(year.try_cast("int")).cast("string"), 4, "0"), number, day)


def _found(plain: Column, form: str, before: str, after: str, parts: tuple) -> Column:
    """Every date of one form with its place; null without one. The form's matches are marked in
    the text, so a match's place is the length of everything before its mark."""

    def marked(pattern: str) -> Column:
        return let(
            F.split(F.regexp_replace(plain, pattern, "\u0001$0"), "\u0001"),
            lambda pieces: F.transform(
                F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)),
                lambda match, i: F.struct(
                    F.length(F.array_join(F.slice(pieces, F.lit(1), i + 1), "")).alias("at"),
                    _read(match, form, parts).alias("day"),
                ),
            ),
        )

    pattern = f"(?iU){before}{form}{after}"
    found = by_alphabet(plain, pattern, lambda p: F.when(plain.rlike(p), marked(p)))
    return found if MONTH not in form else F.when(by_alphabet(plain, MONTH_SEEN, plain.rlike), found)


def find_date(text: Column) -> Column:
    """The first readable date in a text."""

    def first(plain: Column) -> Column:
        found = F.flatten(F.array_compact(F.array(*(_found(plain, *form) for form in FORMS))))
        readable = F.filter(found, lambda c: c["day"].isNotNull())
        return F.when(plain.rlike(r"(?U)\d"), F.array_min(readable)["day"])

    return let(F.replace(text, F.lit("\u0001"), F.lit(" ")), first)


def parse_date(value: Column) -> Column:
    """A printed date, or a date/timestamp cell written as yyyy-MM-dd[ HH:mm:ss]."""
    return find_date(collapsed(value))


def financial_year_start(day: Column) -> Column:
    """1 April of the Indian financial year a day lies in."""
    return F.add_months(F.trunc(F.add_months(day, -3), "YEAR"), 3)


def month_end(day: Column) -> Column:
    return F.last_day(day)


def named_financial_year(first_year: Column) -> tuple[Column, Column]:
    first = full_year(first_year)
    return make_date(first, F.lit(4), F.lit(1)), make_date(first + 1, F.lit(3), F.lit(31))


def relative_range(today: Column, unit: str, last: bool) -> tuple[Column, Column]:
    """This or last week (from Monday), month, calendar year or financial year."""
    if unit == "fy":
        start = financial_year_start(today)
        before = F.add_months(start, -12)
    else:
        start = F.trunc(today, unit.upper()).cast("date")
        steps = {"week": F.date_sub(start, 7), "month": F.add_months(start, -1)}
        before = steps.get(unit, F.add_months(start, -12))
    return (before, F.date_sub(start, 1)) if last else (start, today)


def last_n(today: Column, n: Column, unit: Column) -> Column:
    """The first day of the last n days, weeks or months that end today."""
    months = F.date_add(F.add_months(today, -n), 1)
    days = F.date_sub(today, n * F.when(unit.startswith("week"), 7).otherwise(1) - 1)
    return F.when(unit.startswith("month"), months).otherwise(days)


def latest_month(month: Column, today: Column) -> Column:
    """The first day of the latest such month that has started."""
    year = F.year(today) - F.when(month <= F.month(today), 0).otherwise(1)
    return make_date(year, month, F.lit(1))


def latest_day(month: Column, day: Column, today: Column) -> Column:
    """The latest such day that has come."""
    come = (month < F.month(today)) | ((month == F.month(today)) & (day <= F.dayofmonth(today)))
    return make_date(F.year(today) - F.when(come, 0).otherwise(1), month, day)


def date_label(day: Column) -> Column:
    return F.date_format(day, "d MMM yyyy")


def span(start: Column, end: Column) -> Column:
    """'1 Aug 2026 to 31 Aug 2026'."""
    return F.concat(date_label(start), F.lit(" to "), date_label(end))


def date_problem(day: Column, today: Column) -> Column:
    """A date from 1 April of last financial year up to today is plausible: null. Else why not."""
    earliest = F.add_months(financial_year_start(today), -12)
    shown = F.date_format(day, "dd MMM yyyy")
    return F.when(
        day > today, F.concat(F.lit("The date "), shown, F.lit(" is in the future."))
    ).when(
        day < earliest,
        F.concat(
            F.lit("The date "), shown, F.lit(" is before "), F.date_format(earliest, "dd MMM yyyy"),
            F.lit(", the start of last financial year."),
        ),
    )


def local_day(moment: Column, zone: str) -> Column:
    """The calendar day of a UTC moment in a zone."""
    return F.to_date(F.from_utc_timestamp(moment, zone))


def local_day_start(day: Column, zone: str) -> Column:
    """The UTC moment a local day starts."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)
