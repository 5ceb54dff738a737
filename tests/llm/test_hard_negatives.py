import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import compare
from billmill.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, row int"


def plain(rows, every=100, positives=5, negatives=10):
    """All scores of every anchor, sorted."""
    usable = {}
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector])
        usable[vec_id] = min(row, usable.get(vec_id, row))
    out = []
    for anchor, (label, vector) in usable.items():
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), i, l) for i, (l, v) in usable.items() if i != anchor)
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and -30 * score <= -100 * s[0] <= -90 * score][:negatives]
            out += [(anchor, positive, k, i, -score, -s) for k, (s, i, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows):
    table = spark.createDataFrame([(i, v, l, "x", 1) for i, v, l in rows], SCHEMA)
    return sorted(map(tuple, hard_negatives.mine(hard_negatives.usable_rows(table), F.col("vec_id") % 100 == 0).collect()))


def random_rows(seed, count, width=8, groups=12):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, width))
    vectors = centres[draw.integers(0, groups, count)] + draw.normal(size=(count, width)) * 0.3
    return [(i, [float(np.float32(x)) for x in vectors[i]], int(draw.integers(0, 4))) for i in range(count)]


def test_tree_covers_and_bounds_hold():
    draw = np.random.default_rng(3)
    rows = np.floor(np.array([v for _, v, _ in random_rows(5, 3000)]) * 256)
    rows[100:400] = rows[0]
    rows[400] = 0
    units, norm = hard_negatives.on_sphere(rows)
    tree = hard_negatives.cover_tree(units)
    assert sorted(tree.rows.tolist()) == list(range(len(rows)))
    assert (tree.parent[1:] < np.arange(1, len(tree.parent))).all()
    held = tree.last - tree.first
    assert held.max() <= hard_negatives.LEAF and len(tree.parent) > len(rows) / hard_negatives.LEAF
    asked = np.vstack([rows[:20], draw.normal(size=(5, 8)) * 1000, np.zeros((1, 8))])
    bounds = hard_negatives.Bounds(tree, units, norm, asked)
    scores = asked @ rows.T
    for k, leaf in enumerate(bounds.leaves):
        members = tree.rows[tree.first[leaf] : tree.last[leaf]]
        assert (scores[:, members].max(axis=1) <= bounds.above[:, k]).all()
        assert (scores[:, members].min(axis=1) >= bounds.below[:, k]).all()
    # what lies close together is passed over
    assert (bounds.above[:20] < scores[:20].max(axis=1, keepdims=True) * 0.5).mean() > 0.2


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(hard_negatives, "ROWS_PER_TREE", 400)
    monkeypatch.setattr(hard_negatives, "ANCHORS_PER_BLOCK", 9)
    rows = random_rows(seed, 1800)
    rows += [(2000 + i, rows[7][1], i % 4) for i in range(300)]  # copies of one row: ties
    assert mined(spark, rows) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.25], 2), (3, [0.5, 0.25], 3), (4, None, 1), (5, [1.0, None], 1),
            (6, [nan, 1.0], 1), (8, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (9, [0.4], None), (10, [], 2), (11, [0.9], 1),
            (7, [0.6, 0.3], 0), (2, [0.5, 0.25], 2), (12, [0.7], 2), (12, [0.1], 2), (100, [-1.0, -1.0], 5), (200, [0.0, 0.0], 5),
            (13, [0.5, 0.25, 3.0], 4)]
    got = mined(spark, rows)
    assert got == plain(rows) and got
    assert mined(spark, []) == []
    assert mined(spark, rows[4:9]) == []
    assert mined(spark, [(0, [1.0], 1)]) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-300, 300), min_size=1, max_size=6))
def test_windows_in_whole_numbers(scores):
    for positive in scores:
        low = -((-hard_negatives.LEAST_PERCENT * positive) // 100)
        high = (hard_negatives.MOST_PERCENT * positive) // 100
        for score in range(-300, 300):
            assert (30 * positive <= 100 * score <= 90 * positive) == (low <= score <= high)


def test_query_against_sql(spark, sf_dir):
    name = "op11_hard_negatives"
    got = queries.QUERIES[name](spark, sf_dir)
    result = compare.duck(sf_dir).execute(queries.SQL[name])
    names = [c[0] for c in result.description]
    want = compare.rows_of(names, result.fetchall())
    assert sorted(names) == sorted(got.columns) and want
    assert compare.rows_of(got.columns, got.collect()) == want
