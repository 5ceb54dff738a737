"""Text columns: tidying, labels as printed, file names. Null in, null out."""

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from billmill.model import ALLOWED_EXTENSIONS, DOCUMENT_TITLES

# All the white space Unicode knows, written out because \s alone is ASCII.
SPACES = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
# Each of them, as Python takes them off the ends of a text.
EDGE_SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NOT_PLAIN = r"[^\x00-\x7f₹]"
# The ASCII ones but the space, each by itself: Java looks such a class up in a table.
PLAIN_GAPS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f"
CONTROL = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often `use` names it. Inside lambdas
    nothing else removes repeated work."""
    return F.element_at(F.transform(F.array(value), use), 1)


def beyond_plain(value: Column) -> Column:
    """Whether there is more than ASCII text and rupee signs. Lengths are compared first, as most
    texts have one byte a character and need no search."""
    return (F.octet_length(value) != F.length(value)) & value.rlike(NOT_PLAIN)


def may_hold(value: Column, word: str) -> Column:
    """False only where a text can't hold an ASCII word in any case; quicker than to search for it."""
    return (F.octet_length(value) != F.length(value)) | F.contains(F.lower(value), F.lit(word))


def by_alphabet(value: Column, pattern: str, use: Callable[[str], Column]) -> Column:
    """use(pattern) of an (?iU) pattern. On ASCII text and rupee signs it says the same without
    the Unicode classes, which are several times as slow."""
    plain = pattern.replace("(?iU)", "(?i)", 1)
    return F.when(beyond_plain(value), use(pattern)).otherwise(use(plain))


def single_spaced(value: Column, more: str = "") -> Column:
    """Runs of white space, and of the characters `more`, as single spaces. On ASCII text and
    rupee signs only what is no single space yet is replaced."""
    runs = rf"[ {more}{PLAIN_GAPS}]{{2,}}|[{more}{PLAIN_GAPS}]"
    full = F.regexp_replace(value, rf"[{more}{SPACES[1:]}", " ")
    return F.when(beyond_plain(value), full).otherwise(F.regexp_replace(value, runs, " "))


def collapsed(value: Column) -> Column:
    return F.trim(single_spaced(value.cast("string")))


def has_text(value: Column) -> Column:
    """Whether clean_text leaves anything."""
    return value.cast("string").rlike(f"[^{SPACES[1:-1]}")


def clean_text(value: Column) -> Column:
    """White space collapsed to single spaces; nothing left is null."""
    return blank_to_null(collapsed(value))


def strip_chars(value: Column, chars: str) -> Column:
    return F.btrim(value, F.lit(chars))


def clean_vendor(value: Column) -> Column:
    return blank_to_null(F.substring(strip_chars(collapsed(value), " :,-|*"), 1, 255))


def clean_receipt_number(value: Column, is_number: Column | None = None) -> Column:
    """A receipt number has a digit in it. Numeric cells lose their '.0'."""
    text = strip_chars(collapsed(value), " :#.-")
    if is_number is not None:
        text = F.when(is_number, F.regexp_replace(text, r"\.0+$", "")).otherwise(text)
    return F.when(text.rlike(r"\p{Nd}"), F.substring(text, 1, 64))


def normalize_label(text: Column) -> Column:
    """'Invoice No. :' and 'INVOICE NO' both become 'invoice no'."""
    return strip_chars(single_spaced(F.lower(text), ".:"), " -#()[]*")


def is_document_title(text: Column, normal: Column | None = None) -> Column:
    """`normal` is the text's normal form, where it is at hand."""
    return (normalize_label(text) if normal is None else normal).isin(*DOCUMENT_TITLES)


def mostly_digits(text: Column) -> Column:
    """More than a third of the characters are digits."""
    without = by_alphabet(text, r"(?iU)\p{Nd}+", lambda p: F.regexp_replace(text, p.replace("(?i)\\p{Nd}", "[0-9]"), ""))
    return F.length(text) - F.length(without) > F.length(text) / 3


def same_text(a: Column, b: Column) -> Column:
    """Equal apart from case and spacing."""
    fold = lambda c: F.coalesce(F.lower(clean_text(c)), F.lit(""))
    return fold(a) == fold(b)


def category_name(value: Column) -> Column:
    """A category name as kept: tidied, 1 to 50 characters, no control characters; else null."""
    name = clean_text(value)
    return F.when((F.length(name) <= 50) & ~name.rlike(r"\p{C}"), name)


def extension_of(name: Column) -> Column:
    """The accepted extension in lower case; null when it is not accepted."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(ext.isin(*ALLOWED_EXTENSIONS), ext)


def name_problem(nfc_name: Column) -> Column:
    """Why a (trimmed, NFC) display name is refused; null when it is fine."""
    return (
        F.when(nfc_name.isNull() | nfc_name.isin("", ".", ".."), "The file has no name.")
        .when(nfc_name.rlike(r"[/\\]"), "File names cannot contain / or \\.")
        .when(nfc_name.rlike(CONTROL), "File names cannot contain control characters.")
    )


def cut_name(nfc_name: Column, limit: int = 255) -> Column:
    """At most `limit` characters, keeping a short extension at the end."""
    ext = F.regexp_extract(nfc_name, r"(?s)\.([^.]{1,10})$", 1)
    stem = F.substring_index(nfc_name, ".", -1)
    head = nfc_name.substr(F.lit(1), F.length(nfc_name) - F.length(stem) - 1)
    with_ext = F.concat(head.substr(F.lit(1), F.lit(limit - 1) - F.length(ext)), F.lit("."), ext)
    cut = F.when(ext != "", with_ext).otherwise(F.substring(nfc_name, 1, limit))
    return F.when(F.length(nfc_name) > limit, cut).otherwise(nfc_name)


def safe_cell(value: Column) -> Column:
    """Text a spreadsheet would run as a formula gets a leading '; null becomes empty."""
    text = F.coalesce(value, F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def ref_no(number: Column, year: Column) -> Column:
    """REF-yyyy-nnnnnn; longer numbers keep all their digits."""
    return F.concat(F.lit("REF-"), padded(year, 4), F.lit("-"), padded(number, 6))


def receipt_ref_no(file_ref: Column, seq: Column) -> Column:
    return F.concat(file_ref, F.lit("-"), padded(seq, 2))


def padded(number: Column, width: int) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def join_words(words: Column) -> Column:
    """['a', 'b', 'c'] -> 'a, b and c'."""
    size = F.size(words)
    head = F.concat_ws(", ", F.slice(words, F.lit(1), F.greatest(size - 1, F.lit(0))))
    last = F.try_element_at(words, F.lit(-1))
    return F.when(size > 1, F.concat(head, F.lit(" and "), last)).otherwise(last)


def summarize(problems: Column, limit: int = 3) -> Column:
    """The first problems, then how many more there are."""
    shown = F.concat_ws(" ", F.slice(problems, 1, limit))
    more = F.size(problems) - limit
    return F.when(
        more > 0, F.concat(shown, F.lit(" And "), more.cast("string"), F.lit(" more."))
    ).otherwise(shown)


def tidy_ocr(line: Column) -> Column:
    """Spaces that character recognition dropped, put back where label rules need them."""
    line = F.regexp_replace(line, r"((?:19|20)\d{2})(\d{1,2}:\d{2})", "$1 $2")
    line = F.regexp_replace(line, r"(?=[IR])(?<=[a-z])(INR|Rs\.?)(?=[\s\d.₹]|$)", " $1")
    glued = (
        r"(?i)(?=[tapsgciud])\b(total|amount|payable|subtotal|tax|gst|cgst|sgst|igst|utgst|paid|due)(?=[₹\d])"
    )
    return F.regexp_replace(line, glued, "$1 ")


def lines_of_cells(filled: Column) -> Column:
    """A sheet as text, a line per row, from the column of its filled cells in order (row, value)."""

    def after(cell: Column, i: Column) -> Column:
        same_row = F.get(filled, i - 1)["row"] == cell["row"]
        return F.concat(F.when(i == 0, "").when(same_row, " ").otherwise("\n"), cell["value"])

    return F.array_join(F.transform(filled, after), "")


def source_text(first_page: Column, last_page: Column) -> Column:
    first, last = first_page.cast("string"), last_page.cast("string")
    return F.when(first_page == last_page, F.concat(F.lit("page "), first)).otherwise(
        F.concat(F.lit("pages "), first, F.lit("-"), last)
    )


def _nfc(names: pd.Series) -> pd.Series:
    return names.map(lambda name: None if name is None else unicodedata.normalize("NFC", name))


def composed(value: Column) -> Column:
    """The Unicode normal form C without white space around it; null stays null. Spark has no
    function for it, so this runs in Python, a batch at a time. Text below U+0300 is in that form
    as it is and stays out of it."""
    ascii_only = F.octet_length(value) == F.length(value)
    other = F.when(~ascii_only & value.rlike(r"[^\u0000-\u02ff]"), value)
    return F.btrim(F.coalesce(F.pandas_udf(_nfc, "string")(other), value), F.lit(EDGE_SPACES))
