import hashlib
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from billmill.llm import periodic_runs, queries


def plain_lyndon(seq):
    """The longest word from i on that is smaller than all its own later parts."""
    out = []
    for i in range(len(seq)):
        out.append(max(k for k in range(1, len(seq) - i + 1) if all(seq[i : i + k] < seq[j : i + k] for j in range(i + 1, i + k))))
    return out


def plain_runs(seq, least=6, repeats=4):
    """All stretches that keep a period, by trying every period."""
    found = {}
    for period in range(1, len(seq) // repeats + 1):
        start = 0
        while start < len(seq) - period:
            end = start
            while end < len(seq) - period and seq[end] == seq[end + period]:
                end += 1
            if end > start and end + period - start >= max(least, repeats * period):
                found.setdefault((start, end + period - start), period)
            start = end + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def as_rows(runs):
    return [tuple(row) for row in runs.tolist()]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_lyndon_array(seq):
    ranks = {v: k for k, v in enumerate(sorted(set(seq)))}
    seq = [ranks[v] for v in seq]
    assert periodic_runs.lyndon_array(seq) == plain_lyndon(seq)


pieces = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 7)), max_size=6)


def grown(parts):
    return [item for part, times in parts for item in part * times]


@settings(max_examples=500, deadline=None)
@given(pieces)
def test_runs_against_brute_force(parts):
    seq = grown(parts)
    assert as_rows(periodic_runs.runs_of(np.array(seq, np.int64))) == plain_runs(seq)


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=5))
def test_blocks_of_texts_against_brute_force(texts):
    seqs = [grown(parts) for parts in texts]
    ids = np.array([item for seq in seqs for item in seq], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(seq) for seq in seqs])]).astype(np.int64)
    assert [as_rows(runs) for runs in periodic_runs.runs_in_block(ids, starts)] == [plain_runs(seq) for seq in seqs]


def test_sequences_that_share_hashes_of_parts():
    """The sequence of Thue and Morse and its opposite have one polynomial hash modulo 2**64."""
    bits = [bin(k).count("1") % 2 for k in range(4096)]
    seq = [2, 3] * 5 + bits + [1 - b for b in bits] + [4] * 9
    want = [r for r in plain_runs(seq[:200])[:1]]
    got = as_rows(periodic_runs.runs_of(np.array(seq, np.int64)))
    assert got[0] == want[0] == (0, 10, 2) and got[-1] == (len(seq) - 9, 9, 1) and len(got) == 2
    twice = bits + [1 - b for b in bits]
    at = np.array([0])
    assert periodic_runs._by_comparing(np.array(twice * 2), 10, len(twice)) == (0, 2 * len(twice))
    assert periodic_runs.Common(np.array(twice)).right(at, np.array([len(bits)]))[0] >= 0


def test_long_texts():
    for seq in ([0] * 300_000, list(range(1000)) * 200, list(range(100_000)) + [5, 6] * 50_000):
        assert len(periodic_runs.runs_of(np.array(seq, np.int64))) == 1


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    code = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if code % 10 == 0 and words:
        g, n = code // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest(),
    )


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, " \t\n", 3), (None, "a a a a a a b", 4), (5, "é é é é é é", 5), (5, "é é é é é é", 5),
            (6, "A a A a A a a\x0ba b\x0cb b b b b", 6), (17, "x y z x y z x y z x y z", 7), (8, "w " * 50_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = sorted(map(tuple, periodic_runs.digested(docs).collect()), key=repr)
    assert got == sorted((plain_row(i, t) if i != 8 else got_long(i, t) for i, t, _ in rows), key=repr)
    assert periodic_runs.digested(docs.limit(0)).collect() == []


def got_long(doc_id, text):
    assert crc32(str(doc_id).encode()) % 10
    sha = hashlib.sha256
    return (doc_id, 1, 0, 50_000, 1, 50_000_000, sha(b"0,50000,1\n").hexdigest(), sha(b"w").hexdigest())


@pytest.mark.parametrize("name", ["op12_periodic_runs"])
def test_query_against_brute_force(spark, sf_dir, name):
    want = sorted(plain_row(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = queries.QUERIES[name](spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == want
    assert any(row[1] for row in want)
