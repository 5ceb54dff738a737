import random

import pytest

from billmill.llm import line_dedup, queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(docs, edits=2, least=24):
    lines = [(d, n, line) for d, text in docs if text is not None for n, line in enumerate(text.split("\n"))]
    whole = sorted({line for _, _, line in lines if line.strip()})
    root = {line: line for line in whole}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(whole):
        for b in whole[i + 1 :]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                root[find(a)] = find(b)
    classes = {}
    for d, n, line in lines:
        if line.strip():
            classes.setdefault(find(line), []).append((d is None, d or 0, n))
    out = []
    for d, n, line in lines:
        if line.strip():
            own = classes[find(line)]
            first = min(own)
            out.append((d or 0, n, first[1], first[2], len(own), first == (d is None, d or 0, n)))
        else:
            out.append((d or 0, n, -1, -1, -1, True))
    return sorted(out)


def got(frame):
    clean = lambda v: -1 if v is None else v
    return sorted(((r.doc_id or 0), r.line_no, clean(r.class_doc), clean(r.class_line), clean(r.class_lines), r.kept) for r in frame.collect())


def test_edited_lines_against_brute_force(spark):
    source = random.Random(11)
    letters = "abcdeé \U0001f600"

    def edit(line, times):
        for _ in range(times):
            at = source.randrange(len(line) + 1)
            kind = source.randrange(3)
            line = line[:at] + ("" if kind == 0 else source.choice(letters)) + line[at + (kind != 1) :]
        return line

    docs = []
    for n in range(40):
        base = "".join(source.choices(letters, k=source.randrange(20, 90)))
        family = [edit(base, source.choice([0, 0, 1, 1, 2, 3])) for _ in range(6)]
        docs.append((n, "\n".join([*family, source.choice(["", "short", " \t", "shory"])])))
    source.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(line_dedup.deduplicated(frame)) == brute(docs)


def test_query_against_brute_force(spark, sf_dir):
    """Whole documents; pairs of lines are few enough by length to try them all."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = got(queries.QUERIES["op1_line_dedup"](spark, sf_dir))
    lines = {(d, n): line for d, text in docs for n, line in enumerate(text.split("\n"))}
    assert len(rows) == len(lines)
    first = {}
    for d, n in sorted(lines):
        first.setdefault(lines[d, n], (d, n))
    for d, n, cd, cn, count, kept in rows:
        if lines[d, n].strip():
            assert (cd, cn) <= first[lines[d, n]] and kept == ((cd, cn) == (d, n)) and count >= 1
            assert cd == first[lines[d, n]][0] or len(lines[d, n]) >= 24


def test_one_group_of_near_lines(spark):
    """Every line has one edit of its own: all share segments, no pair is one edit apart."""
    base = "the quick brown fox jumps over the lazy dog and runs away again "
    docs = [(i, base[: i % 60] + chr(0x4E00 + i) + base[i % 60 + 1 :]) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.class_doc for r in line_dedup.deduplicated(frame).collect()} == {0}


def test_odd_rows(spark):
    long = "x" * 60_000
    docs = [(1, None), (2, ""), (3, "a line of more than twenty-four\n\nA line of more than twenty-four"), (None, "a line of more than twenty-four"),
            (4, long + "\n" + long + "y"), (5, "ab\nac\nab")]
    frame = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, line string")
    assert got(line_dedup.deduplicated(frame)) == [
        (0, 0, 3, 0, 3, False), (2, 0, -1, -1, -1, True), (3, 0, 3, 0, 3, True), (3, 1, -1, -1, -1, True), (3, 2, 3, 0, 3, False),
        (4, 0, 4, 0, 2, True), (4, 1, 4, 0, 2, False), (5, 0, 5, 0, 2, True), (5, 1, 5, 1, 1, True), (5, 2, 5, 0, 2, False),
    ]
    assert line_dedup.deduplicated(frame.limit(0)).collect() == []
    repeated = line_dedup.deduplicated(spark.createDataFrame([(1, "ab"), (1, "ab")], "doc_id long, text string")).collect()
    assert [(r.class_lines, r.kept) for r in repeated] == [(2, True), (2, True)]


@pytest.mark.parametrize("edits", [1, 3])
def test_automaton_against_dynamic_programming(spark, edits):
    source = random.Random(edits)
    pairs = []
    for i in range(300):
        a = "".join(source.choices("ab", k=source.randrange(0, 9)))
        b = "".join(source.choices("ab", k=source.randrange(0, 9)))
        pairs.append((i, i, a, b))
    frame = spark.createDataFrame(pairs, "a long, b long, line_a string, line_b string")
    assert sorted(r.a for r in line_dedup.within(frame, edits).collect()) == [i for i, _, a, b in pairs if distance(a, b) <= edits]
