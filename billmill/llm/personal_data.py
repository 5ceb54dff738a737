"""Personal data in texts: patterns propose spans, checks confirm them, words nearby decide."""

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from billmill.llm.common import text_blocks

# The kinds in the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]

# Characters of an account number by country (ISO 13616).
IBAN_CHARS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

# Words that speak for a kind (en, de, fr, es), and words that speak against any.
WORDS_FOR = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "serveur", "servidor"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "kreditkarte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "fax", "mobile", "telefon", "handy", "téléphone", "teléfono", "móvil"),
    "iban": ("iban", "bic", "swift", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security"),
}
WORDS_AGAINST = ("version", "isbn", "issn", "order", "invoice", "serial", "part", "model", "sku", "test")

LEAST_SCORE = 0.6
CONTEXT_CHARS = 48
FOR, AGAINST = 0.3, 0.2

SPANS = "array<struct<kind: string, start: int, end: int, score: double, base: boolean>>"


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    """Every second digit from the right counts twice, less nine above nine; the sum ends in 0."""
    total = sum(map(int, digits[-1::-2]))
    for digit in map(int, digits[-2::-2]):
        total += digit * 2 - 9 * (digit > 4)
    return total % 10 == 0


def mod_97(account: str) -> bool:
    """The number with its first four characters put last and letters as 10 to 35 leaves 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits either matches from its first digit or not at all, so only that one is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,35}")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+(.@-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /-]|[0-9]{3}[ .-])[0-9]{3}[0-9 .-]{2,8}[0-9](?![0-9A-Za-z@-])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from each @ outwards, so that a long run of
    letters is read once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for match in _IP.finditer(text):
        parts = [part.lstrip("0") for part in match.group().split(".")]
        if all(len(part) < 3 or (len(part) == 3 and part <= "255") for part in parts):
            yield match.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _CARD.finditer(text):
        if 12 <= match.end() - match.start() <= 37:
            digits = match.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield match.span()


def _digits(text: str) -> int:
    return sum(c in "0123456789" for c in text)


def phones(text: str) -> Iterator[tuple[int, int]]:
    for match in _PHONE.finditer(text):
        if 9 <= _digits(match.group()) <= 15:
            yield match.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length that pass mod 97; letters or digits that
    follow without a space speak for another number."""
    for match in _IBAN.finditer(text):
        chars, end = IBAN_CHARS.get(match.group()[:2], 0), match.start()
        account = match.group().replace(" ", "")[:chars]
        if not chars or len(account) < chars:
            continue
        for _ in range(chars):
            end += 1 + (text[end] == " ")
        if not text[end : end + 1].isalnum() and mod_97(account):
            yield match.start(), end


def local_phones(text: str) -> Iterator[tuple[int, int]]:
    for match in _LOCAL_PHONE.finditer(text):
        if 7 <= _digits(match.group()) <= 12:
            yield match.span()


def ssns(text: str) -> Iterator[tuple[int, int]]:
    return (match.span() for match in _SSN.finditer(text))


class Rule(NamedTuple):
    """Spans of one kind; `score` is what they have before words nearby are looked at; a rule
    of the base keeps its spans whatever stands nearby."""

    kind: str
    find: Callable[[str], Iterator[tuple[int, int]]]
    needs: str  # a span holds one of these characters
    score: float
    base: bool


# Rules of the base come first.
RULES = (
    Rule("email", emails, "@", 0.8, True),
    Rule("ip", ips, ".", 0.7, True),
    Rule("card", cards, "0123456789", 0.8, True),
    Rule("phone", phones, "+", 0.7, True),
    Rule("iban", ibans, "0123456789", 0.9, False),
    Rule("phone", local_phones, "0123456789", 0.4, False),
    Rule("ssn", ssns, "-", 0.4, False),
)

_NEAR = {kind: re.compile(rf"\b(?:{'|'.join(words)})\b") for kind, words in WORDS_FOR.items()}
_NEAR_AGAINST = re.compile(rf"\b(?:{'|'.join(WORDS_AGAINST)})\b")


def context(text: str, kind: str, start: int, end: int) -> float:
    """What the words around a span add to its score or take from it."""
    around = text[max(0, start - CONTEXT_CHARS) : start] + " | " + text[end : end + CONTEXT_CHARS // 2]
    around = around.lower()
    return FOR * bool(_NEAR[kind].search(around)) - AGAINST * bool(_NEAR_AGAINST.search(around))


class Stretches:
    """Where the spans of the base lie, as stretches that don't meet, in order."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meet(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and start < self.ends[at]


def spans_of(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind. A proposed span that meets one of the base is
    left out: the base has named it."""
    if not text:
        return []
    found: list[Span] = []
    named = None
    for rule in RULES:
        if not any(c in text for c in rule.needs):
            continue
        if not rule.base and named is None:
            named = Stretches([(s.start, s.end) for s in found])
        for start, end in rule.find(text):
            if not rule.base and named.meet(start, end):
                continue
            score = rule.score + context(text, rule.kind, start, end)
            if rule.base or score >= LEAST_SCORE:
                score = max(score, LEAST_SCORE)
                found.append(Span(rule.kind, start, end, min(round(score, 3), 1.0), rule.base))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def masked(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind; of spans that meet, the first that
    starts names the whole stretch."""
    if not spans:
        return text
    out, done = [], 0
    for span in spans:
        if span.start >= done:
            out += [text[done : span.start], f"[{span.kind}]"]
        done = max(done, span.end)
    return "".join(out) + text[done:]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: its id, `pii` (kind, start and end in code points, score, and
    whether the span is of the base), `spans` and `base_sha256` (the spans as text, and the
    SHA-256 of the base's), and `masked`, the text with the spans replaced.

    Base: addresses, IPs, cards that pass Luhn and international phone numbers as their
    patterns match them. Added: account numbers that pass mod 97, and phone numbers without a
    country or social security numbers where a word nearby says so. A null text has no spans
    and stays null; an empty text has none. Repeated rows and rows with a null id are each
    answered. Texts are read whole, one at a time; other columns are not read, whatever their
    names.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch):
                texts = block.column("text").to_pylist()
                spans = [spans_of(t) for t in texts]
                base = [listed([s for s in row if s.base]) for row in spans]
                rows = {
                    "pii": pa.array([[s._asdict() for s in row] for row in spans], PII_TYPE),
                    "spans": pa.array([listed(row) for row in spans], pa.string()),
                    "base_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                    "masked": pa.array([masked(t, row) for t, row in zip(texts, spans)], pa.string()),
                }
                columns = [block.column("id"), *rows.values()]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *rows])

    ids = docs.schema[row_id].dataType.simpleString()
    schema = f"id {ids}, pii {SPANS}, spans string, base_sha256 string, masked string"
    found = docs.selectExpr(f"`{row_id}` AS id", f"`{text}` AS text").mapInArrow(scanned, schema)
    return found.withColumnRenamed("id", row_id)


PII_TYPE = pa.list_(
    pa.struct(
        [
            pa.field("kind", pa.string()),
            pa.field("start", pa.int32()),
            pa.field("end", pa.int32()),
            pa.field("score", pa.float64()),
            pa.field("base", pa.bool_()),
        ]
    )
)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, spans of the base by kind, its digest, and all spans of every document."""
    counts = [f"CAST(size(filter(pii, s -> s.base AND s.kind = '{kind}')) AS long) AS n_{kind}" for kind in BASE_KINDS]
    return find(docs).selectExpr("doc_id", *counts, "base_sha256", "spans")
