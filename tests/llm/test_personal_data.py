import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from billmill.llm import personal_data, queries

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def checked_card(found):
    digits = [int(c) for c in found if c.isdigit()]
    doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
    return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def plain(text):
    """The base by the patterns as they are given."""
    found = []
    for kind, pattern, holds in (
        ("email", EMAIL, lambda m: True),
        ("ip", IP, lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", CARD, checked_card),
        ("phone", PHONE, lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
    ):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if holds(m.group())]
    order = ("email", "ip", "card", "phone")
    return [f"{k}:{s}:{e}" for s, k, e in sorted(found, key=lambda x: (x[0], order.index(x[1])))]


def base_of(text):
    return [f"{s.kind}:{s.start}:{s.end}" for s in personal_data.spans_of(text) if s.base]


CASES = ["", "@", "a@b", "a@b.c", "x a@b.cd@e.f_y@g.h.", "@a@b.c", "a@-.-..b@c.d", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1",
         "0000255.00.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112 4111111111111111", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0",
         "+1 (017) 555-7713.", "+1+2 333 444 555", "+12345678", "+1" + "2" * 20, "é😀 a.b+c@d.ee é 10.0.0.1",
         "+49 30 4111111111111111 a@1.2.3.4"]


@pytest.mark.parametrize("text", CASES)
def test_base_as_the_patterns(text):
    assert base_of(text) == plain(text)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1290.@+-( )_é", max_size=60))
def test_base_as_the_patterns_on_any_text(text):
    assert base_of(text) == plain(text)


def test_checksums():
    assert personal_data.luhn("4111111111111111") and not personal_data.luhn("4111111111111112")
    assert personal_data.mod_97("DE89370400440532013000") and not personal_data.mod_97("DE88370400440532013000")


def kinds(text):
    return [s.kind for s in personal_data.spans_of(text)]


def test_added_spans():
    for account in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947"):
        span = personal_data.spans_of(f"pay to {account} NOW please")
        assert [(s.kind, s.end - s.start) for s in span] == [("iban", len(account))]
    assert kinds("pay to DE88 3704 0044 0532 0130 00 now") == []
    assert kinds("pay to DE89 3704 0044 0532 0130 007 now") == []
    assert kinds("call 030/1234567 today") == ["phone"] and kinds("wrote 030/1234567 today") == []
    assert kinds("SSN 123-45-6789.") == ["ssn"] and kinds("on 123-45-6789.") == [] and kinds("ssn 000-45-6789") == []
    assert kinds("order tel 555-123-4567") == [] and kinds("tel 555-123-4567") == ["phone"]


def test_words_nearby_change_the_score_but_not_the_base():
    near, far, against = (personal_data.spans_of(t)[0].score for t in ("mail a@b.de", "or a@b.de", "version test a@b.de"))
    assert near > far > against >= personal_data.LEAST_SCORE


def test_masked():
    text = "é a@b.de or tel. +1 (017) 555-7713 x"
    assert personal_data.masked(text, personal_data.spans_of(text)) == "é [email] or tel. [phone] x"
    assert personal_data.masked(None, []) is None


def test_long_texts_take_time_in_proportion():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1 " * 500_000, "+" * 1_000_000, "a@" * 500_000, "DE12" * 300_000):
        assert len(personal_data.spans_of(text)) <= 1
    for text, spans in (("1." * 500_000, 125_000), ("10.0.0.1 tel 555-123-4567 " * 20_000, 40_000)):
        assert len(personal_data.spans_of(text)) == spans


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (None, "a@b.de", "z"), (3, "a@b.de", None), (3, "a@b.de", None), (4, "x " * 100_000 + "10.0.0.1", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, r.n_email, r.n_ip, r.spans) for r in personal_data.counted(docs).collect())
    assert got == [(0, 1, 0, "email:0:6"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, "email:0:6"), (3, 1, 0, "email:0:6"), (4, 0, 1, "ip:200000:200008")]
    assert personal_data.counted(docs.limit(0)).collect() == []


def test_query_against_brute_force(spark, sf_dir):
    rows = queries.QUERIES["op13_personal_data"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == texts.keys() and len(rows) == len(texts)
    hits = 0
    for row in rows:
        base = plain(texts[row.doc_id])
        hits += len(base)
        assert row.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        for kind in ("email", "ip", "card", "phone"):
            assert row[f"n_{kind}"] == sum(b.startswith(kind + ":") for b in base)
        assert set(base) <= set(row.spans.split(",")) | {""}
    assert hits > 0
    clean = random.Random(7).sample([r for r in rows if r.base_sha256 == hashlib.sha256(b"").hexdigest()], 50)
    assert all(r.spans == "" for r in clean)
