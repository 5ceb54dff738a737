"""Printed labels: which field a piece of text names, and the value after the label.

The dictionary is small and fixed, so it becomes one alternation (longest label first)
instead of a join: every row is matched where it lies, with no row growth and no shuffle.
"""

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from billmill.functions.text import by_alphabet, let, normalize_label, strip_chars
from billmill.model import FIELD_LABELS, ITEM_HEADERS, LABELS, MONEY_FIELDS, Label

NOT_ALNUM = r"(?![\p{L}\p{N}])"


def _java_quote(word: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", word)


def alternation(texts: Iterable[str], between: str | None = None) -> str:
    """Longest first, so the longest label a text starts with is the one found."""
    ordered = sorted(dict.fromkeys(texts), key=len, reverse=True)
    if between is None:
        return "|".join(_java_quote(text) for text in ordered)
    return "|".join(between.join(_java_quote(w) for w in text.split()) for text in ordered)


def any_start(texts: Iterable[str]) -> str:
    """The class of first letters: looked at ahead of an alternation, it passes over most places."""
    return f"[{''.join(sorted({text[0] for text in texts}))}]"


def lookup(entries: dict, key: Column) -> Column:
    """The literal map's value for a key, or null."""
    pairs = [F.lit(x) for pair in entries.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def value_pattern(label: str) -> str:
    """The pattern that takes a label, as printed, off the front of a text."""
    return r"(?iU)^\W*" + r"\W*".join(_java_quote(w) for w in label.split()) + r"\b"


def value_pattern_column(label: Column) -> Column:
    """The same pattern for labels that are data."""
    quoted = F.regexp_replace(label, r"([^\p{L}\p{N}_\s])", r"\\$1")
    return F.concat(F.lit(r"(?iU)^\W*"), F.regexp_replace(quoted, r"\s+", r"\\W*"), F.lit(r"\b"))


def rest_after(raw: Column, pattern: Column) -> Column:
    """What is printed after the label; empty when the label cannot be taken off."""
    rest = F.when(F.regexp_like(raw, pattern), F.regexp_replace(raw, pattern, F.lit("")))
    return strip_chars(F.coalesce(rest, F.lit("")), " :.-#\t|")


def _named(raw: Column, label: Column, labels: list[Label]) -> Column:
    """What is known of the label, and rest_after it. Each label has its own fixed pattern, as one
    that changes from row to row is compiled for each row. The label is looked for by halves of
    the sorted ones; where the pattern doesn't hold, nothing is extracted."""
    known = sorted({x.text: x for x in labels}.items())

    def told(text: str, x: Label) -> Column:
        rest = by_alphabet(raw, value_pattern(text) + "((?s:.*))", lambda p: F.regexp_extract(raw, p, 1))
        return F.struct(
            F.lit(x.field).alias("field"), label.alias("label"), F.lit(x.rank).alias("priority"),
            strip_chars(rest, " :.-#\t|").alias("rest"),
        )

    def among(low: int, high: int) -> Column:
        if high - low == 1:
            return F.when(label == known[low][0], told(*known[low]))
        half = (low + high) // 2
        return F.when(label < known[half][0], among(low, half)).otherwise(among(half, high))

    return among(0, len(known))


def match_label(raw: Column, labels: list[Label] | None = None, normal: Column | None = None) -> Column:
    """struct(field, label, priority, rest) of the longest label a text starts with, or null.
    `normal` is the text's normal form, where it is at hand."""
    labels = LABELS if labels is None else labels
    pattern = f"^({alternation(x.text for x in labels)}){NOT_ALNUM}"
    normal = normalize_label(raw) if normal is None else normal
    found = F.regexp_extract(normal, pattern, 1)
    return let(found, lambda label: F.when(label != "", _named(raw, label, labels)))


def label_field(raw: Column) -> Column:
    """Only the field of the label a text starts with (cheaper than the whole match)."""
    pattern = f"^({alternation(x.text for x in LABELS)}){NOT_ALNUM}"
    label = F.regexp_extract(normalize_label(raw), pattern, 1)
    return F.when(label != "", lookup({x.text: x.field for x in LABELS}, label))


_MONEY_LABELS = [x.text for x in LABELS if x.field in MONEY_FIELDS]
SPLIT_PATTERN = rf"(?i)(?<=\d)\s+(?=(?:{alternation(_MONEY_LABELS)})\b)"

SEVERAL = rf"(?i)\d\s+(?:{alternation(_MONEY_LABELS)})\b"


def split_labelled(line: Column) -> Column:
    """A line with several labelled amounts, as its parts."""
    return F.filter(F.split(line, SPLIT_PATTERN), lambda p: F.trim(p) != "")


NUMBER_PATTERN = (
    rf"(?iU)\b(?={any_start(FIELD_LABELS['receipt_number'])})(?:{alternation(FIELD_LABELS['receipt_number'], chr(92) + 'W*')})(?![A-Za-z])"
    r"\W*?([A-Za-z0-9][A-Za-z0-9/\-]*\d[A-Za-z0-9/\-]*|\d+)"
)


def number_in(text: Column) -> Column:
    """The receipt number printed after any number label, anywhere in a text."""
    found = by_alphabet(text, NUMBER_PATTERN, lambda p: F.regexp_extract(text, p, 1))
    return F.when(found != "", found)


def header_column(cell: Column) -> Column:
    """Which items-table column a header cell names, or null."""
    word = strip_chars(F.lower(cell), " .:()#")
    return lookup({name: col for col, names in ITEM_HEADERS.items() for name in names}, word)


def label_before(part: Column) -> Column:
    """The words in front of the first amount of a text, if they can be a label."""
    head = F.split(part, r"(?iU)(?:₹|\brs\.?|\binr)?\s*\d", 2)[0]
    label = F.regexp_replace(normalize_label(head), r"(?U)\s*\b(rs|inr)$", "")
    return let(
        strip_chars(label, " -:()[]"),
        lambda x: F.when(x.rlike("[a-z]") & F.length(x).between(2, 60), x),
    )


def builtin_field(label: Column) -> Column:
    """The field a label already means, when it is exactly a known label."""
    return lookup({x.text: x.field for x in LABELS}, F.when(normalize_label(label) == label, label))
