import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from billmill.llm import ngram_join, queries
from billmill.llm.words import hashed_words


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingled(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = {i: shingled(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            p, q = sets[a], sets[b]
            if p and q and min(len(p), len(q)) * 4 >= 3 * max(len(p), len(q)):
                both = len(p & q)
                if 100 * both >= 75 * (len(p) + len(q) - both):
                    u, v = sorted((find(a), find(b)))
                    root[v] = u
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def got(frame):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect())


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(queries.QUERIES["op5_ngram_jaccard_join"](spark, sf_dir)) == brute(rows)


def test_edited_families_and_shared_passages(spark):
    source = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    hot = " ".join(source.choices(vocabulary, k=60))
    rows, number = [], 0
    for size in (3, 8, 15, 40, 90, 200, 500):
        for _ in range(3):
            base = source.choices(vocabulary, k=size)
            for edits in (0, 0, 1, 1, 2, 3, size // 30, size // 20, size // 12):
                words = list(base)
                for _ in range(edits):
                    words[source.randrange(len(words))] = source.choice(vocabulary)
                rows.append((number, " ".join(words)))
                number += 1
            rows.append((number, hot + "\n" + " ".join(base)))
            number += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join.join(docs)) == brute(rows)


def test_one_group_of_near_copies(spark):
    source = random.Random(6)
    base = [f"w{source.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        words[source.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in ngram_join.join(docs).collect()} == {0}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, 7), (2, "", 7), (3, " \t\n", 7), (4, "One two", 7), (5, "one\x0bTWO ", 7), (6, long, 7), (7, long + " end", 7),
            (7, long + " end", 7), (None, "one two", 7), (None, None, None), (8, "two one", 7), (9, " ", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    found = ngram_join.join(docs).collect()
    said = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in found)
    assert said == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 29_996, 6), (7, 29_997, 6), (7, 29_997, 6),
                           (-1, 1, -1), (-1, 0, -1), (8, 1, 8), (9, 1, 9)])
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabAé ", max_size=12)))
def test_words_of_blocks(texts):
    hashes, starts = hashed_words(pa.array([*texts, None], pa.string()))
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts] + [[]]
    assert np.diff(starts).tolist() == [len(w) for w in words]
    flat = [w for own in words for w in own]
    assert len(set(hashes.tolist())) == len(set(flat))
    assert len(set(zip(hashes.tolist(), flat, strict=True))) == len(set(flat))


def test_long_texts_are_worked_off_in_steps(monkeypatch):
    text = "ab " * 50 + "x" * 300 + " ab" * 9
    whole = hashed_words(pa.array([text, "ab"]))
    monkeypatch.setattr("billmill.llm.words._STEP", 16)
    pieces = hashed_words(pa.array([text, "ab"]))
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()


def test_one_id_with_several_texts(spark):
    words = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join(["x", *words[k + 1 : k + 20]])
    rows = [(1, " ".join(words[:20])), (7, near(0)), (2, " ".join(words[30:50])), (7, near(30)), (7, near(30)), (9, "alone here"),
            (3, "one two three"), (5, "one two three"), (4, "four five"), (5, "four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in ngram_join.join(docs).collect()}
    assert found == {1: 1, 2: 1, 7: 1, 9: 9, 3: 3, 5: 3, 4: 3}


def test_near_copies_too_far_apart(spark):
    """Copies that share most of one text but link with few others."""
    source = random.Random(8)
    base = [f"w{source.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(source.choice([1, 3, 4, 5, 8])):
            words[source.randrange(150)] = source.choice(base)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join.join(docs)) == brute(rows)
