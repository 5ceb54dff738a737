import hashlib
import random
import re

from pyspark.sql import functions as F

from billmill.llm import queries, spotsigs


def chains(text):
    """Signatures of a text, unhashed."""
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    passed = set(spotsigs.ANCHORS) | set(spotsigs.COMMON)
    found = set()
    for i, word in enumerate(words):
        if word in spotsigs.ANCHORS:
            after = [w for w in words[i + 1 :] if w not in passed][: spotsigs.CHAIN]
            if after:
                found.add((word, " ".join(after)))
    return found or ({(text,)} if (text or "").strip() else set())


def alike(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def check(rows, docs):
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] is not None, d[1] or ""))
    want = []
    for n, (doc_id, text) in enumerate(docs):
        text, following = text or "", docs[(n + 1) % len(docs)][1] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        own = chains(text)
        want.append((doc_id or -1, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(alike(own, chains(edited)), 9), round(alike(own, chains(following)), 9)))
    got = [(r.doc_id or -1, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]
    assert sorted(got) == sorted(want)


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.QUERIES["op4_spotsigs_fingerprints"](spark, sf_dir).collect()
    check(rows, docs)
    texts, prints = dict(docs), {}
    for r in rows:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_cells_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "ROWS_PER_CELL", 3)
    docs = [(i * 7 % 23, f"The é\U0001f600 {i} cat sat on a mat{i} and ran") for i in range(23)]
    docs += [(100, None), (101, ""), (101, ""), (102, " \n"), (103, "of the"), (None, "null the id row"), (104, "the word " * 20_000)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, fingerprint string")
    check(spotsigs.fingerprints(frame).collect(), docs)
    assert spotsigs.fingerprints(frame.limit(0)).collect() == []
    check(spotsigs.fingerprints(frame.filter("doc_id = 100")).collect(), [(100, None)])


def test_pairs_against_brute_force(spark):
    source = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for family in range(12):
        base = []
        for _ in range(source.randrange(5, 60)):
            base += [source.choice(spotsigs.ANCHORS), *source.choices(vocabulary, k=source.randrange(1, 5))]
        for edits in (0, 0, 1, 1, 2, 3, 4):
            own = list(base)
            for _ in range(edits):
                own[source.randrange(len(own))] = source.choice(vocabulary)
            docs.append((len(docs), " ".join(own)))
    docs += [(900, None), (901, ""), (902, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    firsts = {}
    for i, text in docs:
        if own := frozenset(chains(text)):
            firsts.setdefault(own, i)
    want = set()
    for a, i in firsts.items():
        for b, j in firsts.items():
            if i < j and alike(a, b) >= 0.75:
                want.add((i, j, round(alike(a, b), 9)))
    got = {(r.a, r.b, round(r.likeness, 9)) for r in spotsigs.near_pairs(frame).collect()}
    assert got == want and want


def test_length_parts_are_next_to_each_other(spark):
    sizes = spark.range(1, 400).select(F.col("id"), spotsigs.length_part(F.col("id"), 0.75).alias("part")).collect()
    part = {r.id: r.part for r in sizes}
    assert all(part[b] - part[a] in (0, 1) for b in part for a in range(-(-3 * b // 4), b + 1))
