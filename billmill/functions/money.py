"""Amounts and quantities as exact decimals. What cannot be read is null."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from billmill.functions.text import by_alphabet, collapsed, let
from billmill.model import MONEY, QUANTITY, TOLERANCE

# fixed values: how money is printed
CURRENCY = r"(?iU)₹|\brs\b\.?|\binr\b|/-"
AMOUNT_IN_TEXT = (
    r"(?iU)(?<![\w.,/-])(?:₹|rs\.?|inr)?\s*"
    r"(\(?-?(?:\d{1,3}(?:,\d{2,3})+|\d+)(?:\.\d{1,2})?\)?)"
    r"(?![\d,]*\d|\.\d|[/-]\d|\s*%)"
)
NUMBER_TOKEN = r"^\(?-?(?:\d{1,3}(?:,\d{2,3})+|\d+)(?:\.\d+)?\)?$"


def parse_amount(value: Column) -> Column:
    """Printed money: currency marks, commas and spaces go; (1.00) is negative; else null. What
    is digits and commas as it stands is not searched for the others."""
    value = value.cast("string")
    bare = F.translate(F.trim(F.regexp_replace(value, CURRENCY, "")), ", ", "")
    signed = F.btrim(F.regexp_replace(bare, r"^\(+(.*?)\)+$", "-$1"), F.lit("()"))
    number = F.regexp_extract(F.regexp_replace(signed, "^--", ""), r"^-?[0-9]+(?:\.[0-9]+)?$", 0)
    usual = value.rlike(r"^-?[0-9][0-9,]*(?:\.[0-9]+)?\z")
    return F.when(usual, F.replace(value, F.lit(","), F.lit(""))).otherwise(number).try_cast(MONEY)


def parse_quantity(value: Column) -> Column:
    """The number a quantity starts with: '12.35 L' is 12.350."""
    plain = F.replace(collapsed(value), F.lit(","), F.lit(""))
    return F.regexp_extract(plain, r"^[0-9]+(?:\.[0-9]+)?", 0).try_cast(QUANTITY)


def _printed(text: Column) -> Column:
    return by_alphabet(text, AMOUNT_IN_TEXT, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1)))


def amounts_in(text: Column) -> Column:
    """Every amount printed in a line, left to right; rates, dates and codes are passed over."""
    return F.filter(F.transform(_printed(text), parse_amount), lambda a: a.isNotNull())


def last_amount(text: Column) -> Column:
    """The last amount of a line, which is the one a label on it names."""
    return let(F.try_element_at(_printed(text), F.lit(-1)), parse_amount)


def amount_with_unit(number: Column, unit: Column) -> Column:
    """'1.5' with 'lakh' is 150000; 'k' is a thousand."""
    base = F.translate(number, ",", "").try_cast("decimal(14,2)")
    factor = F.when(unit == "k", 1000).when(unit.rlike("^la"), 100000).otherwise(1)
    return (base * factor).cast("decimal(14,2)")


def from_cents(cents: Column) -> Column:
    return (cents.cast("decimal(14,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY)


def close(a: Column, b: Column) -> Column:
    """Within one rupee, which also takes in a printed round-off."""
    return F.abs(a - b) <= F.lit(TOLERANCE).cast("decimal(3,2)")


def rupees(amount: Column) -> Column:
    """Indian digit grouping: ₹1,23,456.50."""
    text = F.abs(amount).cast("decimal(18,2)").cast("string")
    grouped = F.regexp_replace(text, r"(?<=\d)(?=(?:\d{2})*\d{3}\.)", ",")
    return F.concat(F.when(amount < 0, "-₹").otherwise("₹"), grouped)


def rupees_western(amount: Column) -> Column:
    """Thousands grouping, as messages print it: ₹1,100.00."""
    return F.concat(F.lit("₹"), F.format_number(amount, 2))


def sum_tokens(tokens: Column) -> Column:
    """The sum of printed amounts; null if there are none or one cannot be read."""
    total = F.aggregate(
        F.transform(tokens, parse_amount),
        F.lit(0).cast("decimal(18,2)"),
        lambda acc, a: (acc + a).cast("decimal(18,2)"),
    )
    return F.when(F.size(tokens) > 0, total).cast(MONEY)


def field_weight(found: Column, weight: float) -> Column:
    return F.when(found, F.lit(weight)).otherwise(F.lit(0.0))


def confidence_of(
    vendor: Column, receipt_date: Column, total: Column, receipt_number: Column, items: Column
) -> Column:
    """The share of a receipt's fields that were found; a zero total counts as not found."""
    from billmill.model import CONFIDENCE_WEIGHTS as w

    score = (
        field_weight(F.coalesce(vendor, F.lit("")) != "", w["vendor"])
        + field_weight(receipt_date.isNotNull(), w["receipt_date"])
        + field_weight(F.coalesce(total, F.lit(0)) != 0, w["total"])
        + field_weight(F.coalesce(receipt_number, F.lit("")) != "", w["receipt_number"])
        + field_weight(F.coalesce(items, F.lit(0)) > 0, w["line_items"])
    )
    return F.round(F.least(score, F.lit(1.0)), 3)
