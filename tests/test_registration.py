"""Uploads registered as if one after the other."""

import random

import pytest

from billmill.operators import registry


def one_by_one(uploads, existing, most):
    files = [(i, sha, batch) for i, sha, batch in existing]
    out = {}
    for i, batch, sha, confirmed in sorted(uploads):
        if sum(b == batch for _, _, b in files) >= most:
            out[i] = ("batch_full", None)
            continue
        same = [f for f, s, _ in files if s == sha]
        old = [f for f, s, _ in existing if s == sha]
        original = min(old or same, default=None)
        if original is not None and not confirmed:
            out[i] = ("duplicate", original)
            continue
        out[i] = ("registered", original)
        files.append((i, sha, batch))
    return out


def registered(spark, uploads, existing, most):
    rows = spark.createDataFrame([(i, b, "a.pdf", 10, s, c) for i, b, s, c in uploads],
                                 "id bigint, batch_id bigint, name string, size_bytes bigint, sha256 string, confirmed boolean")
    there = spark.createDataFrame(existing, "id bigint, sha256 string, batch_id bigint")
    got = registry.register(rows, there, year=2026, first_number=0, max_files=most).collect()
    assert all((r.ref_no is None) == (r.outcome != "registered") for r in got)
    return {r.id: (r.outcome, r.duplicate_of_id) for r in got}


def test_copy_of_a_refused_upload_is_a_first_one(spark):
    uploads = [(1, 1, "aa", False), (2, 1, "bb", False), (3, 1, "cc", False), (4, 2, "cc", False), (5, 2, "cc", False), (6, 1, "aa", False)]
    assert registered(spark, uploads, [], 2) == {
        1: ("registered", None), 2: ("registered", None), 3: ("batch_full", None), 4: ("registered", None),
        5: ("duplicate", 4), 6: ("batch_full", None),
    }


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_one_by_one(spark, seed):
    draw = random.Random(seed)
    uploads = [(i, draw.randrange(6), f"h{draw.randrange(25)}", draw.random() < 0.2) for i in range(120)]
    existing = [(1000 + i, f"h{draw.randrange(30)}", draw.randrange(6)) for i in range(8)]
    assert registered(spark, uploads, existing, 7) == one_by_one(uploads, existing, 7)
