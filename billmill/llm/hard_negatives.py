"""Hard negatives: rows of another label that score high, but not too high, against an anchor."""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billmill.llm.common import staged

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LEAST_PERCENT, MOST_PERCENT = 30, 90  # of the positive's score

# A tree holds about so many rows; more rows give more trees, each made and searched by one task.
ROWS_PER_TREE = 8192
# Anchors go to the tasks in blocks of about so many; more anchors give more blocks.
ANCHORS_PER_BLOCK = 16384
ANCHORS_AT_ONCE = 512
LEAF = 64
NARROWER = 0.85  # radius of a level against the one above
LEAST_PER_CHILD = 8  # a node whose next level holds fewer rows a node than this is a leaf
FIRST_LEAVES = 4  # leaves an anchor looks into before its bound is used; four times as many each time


class Tree(NamedTuple):
    """A cover tree over rows put on one sphere: a further coordinate gives every row the same
    norm, so that a larger inner product means a smaller angle, whatever the row's own norm.

    Nodes are listed from the root down, level by level: place of the parent, the row in the
    centre, the angle that covers all rows of the node. Leaves name their rows by `first` and
    `last` in `rows`; inner nodes have first = last.
    """

    parent: np.ndarray
    centre: np.ndarray
    angle: np.ndarray
    first: np.ndarray
    last: np.ndarray
    rows: np.ndarray


def on_sphere(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vectors with the further coordinate, and the norm they stand for."""
    squares = np.einsum("ij,ij->i", vectors, vectors)
    most = float(squares.max(initial=0.0))
    norm = np.sqrt(most) or 1.0
    further = np.sqrt(np.maximum(most - squares, 0.0))
    return np.hstack([vectors, further[:, None]]) / norm, norm


def cover_tree(units: np.ndarray) -> Tree:
    """Each node's rows are dealt to centres that lie further apart than the next level's
    radius, the node's own centre first; each centre takes the rows within that radius that
    are left. Where that would leave a few rows a centre, as among rows that are all far from
    each other, the node stays a leaf."""
    parent, centre, angle, first, last, rows = [], [], [], [], [], []
    level = [(-1, 0, np.arange(len(units)))] if len(units) else []
    held = 0
    while level:
        below = []
        for above, middle, members in level:
            node = len(parent)
            away = np.arccos(np.clip(units[members] @ units[middle], -1.0, 1.0))
            radius = float(away.max())
            children = []
            if len(members) > LEAF:
                children = _dealt(units, members, middle, away, radius * NARROWER) or _cut(members[np.argsort(away, kind="stable")])
            parent.append(above)
            centre.append(middle)
            angle.append(radius)
            first.append(held)
            if children:
                below += [(node, *child) for child in children]
            else:
                rows.append(members)
                held += len(members)
            last.append(held)
        level = below
    return Tree(
        np.array(parent, np.int64),
        np.array(centre, np.int64),
        np.array(angle),
        np.array(first, np.int64),
        np.array(last, np.int64),
        np.concatenate(rows) if rows else np.zeros(0, np.int64),
    )


def _dealt(units: np.ndarray, members: np.ndarray, middle: int, away: np.ndarray, radius: float) -> list:
    children, left, most = [], members, len(members) // LEAST_PER_CHILD
    if radius < 1e-6:  # copies of one row
        return []
    while len(left):
        if len(children) >= most:
            return []
        near = away <= radius
        children.append((middle, left[near]))
        left = left[~near]
        if len(left):
            middle = int(left[0])
            away = np.arccos(np.clip(units[left] @ units[middle], -1.0, 1.0))
            away[0] = 0.0
    return children if len(children) > 1 else []


def _cut(members: np.ndarray) -> list:
    return [(int(members[start]), members[start : start + LEAF]) for start in range(0, len(members), LEAF)]


class Bounds:
    """Least and greatest inner product of each query with any row of each leaf, level by level:
    a row of a node is no nearer to the query than the centre's angle less the node's, and a
    child is bound by its parent too."""

    def __init__(self, tree: Tree, units: np.ndarray, norm: float, queries: np.ndarray):
        lengths = np.linalg.norm(queries, axis=1)
        flat = np.hstack([queries, np.zeros((len(queries), 1))]) / np.where(lengths > 0, lengths, 1.0)[:, None]
        away = np.arccos(np.clip(flat @ units[tree.centre].T, -1.0, 1.0))
        scale = (lengths * norm)[:, None]
        slack = 1e-7 * scale + 0.5  # rounding of angles; scores are whole numbers
        above = np.cos(np.maximum(away - tree.angle, 0.0)) * scale + slack
        below = np.cos(np.minimum(away + tree.angle, np.pi)) * scale - slack
        for node in range(1, len(tree.parent)):
            np.minimum(above[:, node], above[:, tree.parent[node]], out=above[:, node])
            np.maximum(below[:, node], below[:, tree.parent[node]], out=below[:, node])
        self.leaves = np.flatnonzero(tree.last > tree.first)
        self.above, self.below = above[:, self.leaves], below[:, self.leaves]


class Best:
    """The best `most` rows of each query met so far: score, then smaller id."""

    def __init__(self, queries: int, most: int):
        self.most = most
        self.query = np.zeros(0, np.int64)
        self.score, self.row_id = self.query, self.query
        self.least = np.full(queries, -np.inf)  # a row below this can't be among them

    def take(self, query: list[np.ndarray], score: list[np.ndarray], row_id: list[np.ndarray]) -> None:
        query = np.concatenate([self.query, *query])
        score, row_id = np.concatenate([self.score, *score]), np.concatenate([self.row_id, *row_id])
        order = np.lexsort((row_id, -score, query))
        query, score, row_id = query[order], score[order], row_id[order]
        start = np.searchsorted(query, query)
        rank = np.arange(len(query)) - start
        kept = rank < self.most
        self.query, self.score, self.row_id = query[kept], score[kept], row_id[kept]
        full = rank == self.most - 1
        self.least[query[full]] = score[full]


class Queries(NamedTuple):
    """Anchors of a block; with positives (id and score of each, -1 where there is none) in the
    second search."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    positive_ids: np.ndarray
    positive_scores: np.ndarray
    positives: np.ndarray  # how many each anchor has


def search(
    tree: Tree,
    bounds: Bounds,
    vectors: np.ndarray,
    labels: np.ndarray,
    ids: np.ndarray,
    queries: Queries,
    lowest: np.ndarray,
    highest: np.ndarray,
    same: bool,
    most: int,
) -> Best:
    """For each query and each of its windows (columns of lowest and highest) the best `most`
    rows of its own label (`same`) or of other labels, without rows of its own id, that score
    within the window. Query q's window w is q * windows + w in the result.

    Best-first: each query goes through its leaves in falling order of what they may hold
    inside a window still open, a few at first, and ends with the first leaf that can hold
    nothing better. Leaves outside all windows are skipped. What is left is scored exactly.
    """
    count, windows = lowest.shape
    best = Best(count * windows, most)
    may = np.full(bounds.above.shape, -np.inf)
    for w in range(windows):
        low, high = lowest[:, w, None], highest[:, w, None]
        inside = (bounds.above >= low) & (bounds.below <= high) & (low <= high)
        may = np.maximum(may, np.where(inside, np.minimum(bounds.above, high), -np.inf))
    order = np.argsort(-may, axis=1, kind="stable")
    done, width = 0, FIRST_LEAVES
    while done < order.shape[1]:
        chosen = order[:, done : done + width]
        wanted = np.zeros(may.shape, bool)
        np.put_along_axis(wanted, chosen, True, axis=1)
        least = np.maximum(lowest, best.least.reshape(count, windows))
        open_ = np.zeros(may.shape, bool)
        for w in range(windows):
            low, high = least[:, w, None], highest[:, w, None]
            open_ |= (bounds.above >= low) & (bounds.below <= high) & (low <= high)
        wanted &= open_
        hits = ([], [], [])
        for leaf in np.flatnonzero(wanted.any(axis=0)):
            node = bounds.leaves[leaf]
            rows = tree.rows[tree.first[node] : tree.last[node]]
            asked = np.flatnonzero(wanted[:, leaf])
            scores = queries.vectors[asked] @ vectors[rows].T
            fits = (queries.labels[asked, None] == labels[rows]) == same
            fits &= queries.ids[asked, None] != ids[rows]
            for w in range(windows):
                low, high = least[asked, w, None], highest[asked, w, None]
                q, r = np.nonzero(fits & (scores >= low) & (scores <= high))
                if len(q):
                    hits[0].append(asked[q] * windows + w)
                    hits[1].append(scores[q, r].astype(np.int64))
                    hits[2].append(ids[rows[r]])
        if hits[0]:
            best.take(*hits)
        done, width = done + width, width * 4
    return best


def whole_components(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable_rows(rows: DataFrame, vector: str = "embedding", relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label and whole-number vector of the rows that take part: without a null in id,
    label or vector and with finite components only. Where vec_id is divisible by
    `relabel_every` the label is moved on by one. Of several different rows with one vec_id
    the smallest (label, vector) takes part; equal rows count once."""
    label = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    taken = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector).alias("vector"))
    taken = taken.filter(F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False)))
    smallest = F.min(F.struct("label", whole_components(F.col("vector")).alias("vector")))
    return taken.groupBy("vec_id").agg(smallest.alias("row")).select("vec_id", "row.label", "row.vector")


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix; a shorter list is filled with zeros."""
    out = np.zeros((len(vectors), width))
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
    values = np.asarray(lists.flatten()).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = values
    return out


def _block_of(block: pa.Table, width: int, most: int) -> Queries:
    """A block of anchors; positives, where the table has them, by falling score."""
    count = len(block)
    ids, scores, held = np.full((count, most), -1, np.int64), np.full((count, most), -1, np.int64), np.zeros(count, np.int64)
    if "positives" in block.column_names:
        for k, found in enumerate(block.column("positives").to_pylist()):
            held[k] = len(found)
            for j, positive in enumerate(found):
                ids[k, j], scores[k, j] = positive["id"], positive["score"]
    label = block.column("label").to_numpy()
    return Queries(block.column("vec_id").to_numpy(), label, _matrix(block.column("vector"), width), ids, scores, held)


def _searched(trees: DataFrame, queries: Queries, width: int, second: bool) -> DataFrame:
    """The best rows of each tree for a block of anchors: (anchor, positive place, id, score)."""
    shared = trees.sparkSession.sparkContext.broadcast(tuple(queries))

    def one_tree(rows: pa.Table) -> pa.Table:
        whole = Queries(*shared.value)
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        vectors = _matrix(rows.column("vector"), width)
        units, norm = on_sphere(vectors)
        tree = cover_tree(units)
        out = []
        for start in range(0, len(whole.ids), ANCHORS_AT_ONCE):
            part = Queries(*(column[start : start + ANCHORS_AT_ONCE] for column in whole))
            if second:
                lowest = -((-LEAST_PERCENT * part.positive_scores) // 100).astype(np.float64)
                highest = ((MOST_PERCENT * part.positive_scores) // 100).astype(np.float64)
                there = np.arange(part.positive_ids.shape[1]) < part.positives[:, None]
                highest[~there], lowest[~there] = -np.inf, np.inf
            else:
                lowest, highest = np.full((len(part.ids), 1), -np.inf), np.full((len(part.ids), 1), np.inf)
            bounds = Bounds(tree, units, norm, part.vectors)
            best = search(tree, bounds, vectors, labels, ids, part, lowest, highest, not second, NEGATIVES if second else POSITIVES)
            windows = lowest.shape[1]
            out.append(np.stack([part.ids[best.query // windows], best.query % windows, best.row_id, best.score]))
        found = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
        return pa.table(dict(zip(("anchor_id", "place", "id", "score"), map(pa.array, found))))

    return trees.groupBy("tree").applyInArrow(one_tree, "anchor_id long, place long, id long, score long")


def _best(found: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """The best `most` (score, id) of each key. Each tree gives no more than that for a key, so
    a key's group grows with the number of trees only."""
    kept = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "id"))), 1, most)
    return found.groupBy(*keys).agg(F.transform(kept, lambda x: F.struct(x["id"].alias("id"), (-x["order"]).alias("score"))).alias(name))


def mine(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `rows` as from usable_rows; anchors are the rows for which is_anchor holds. An anchor's
    positives are its first POSITIVES other rows of the same label by score, then vec_id; for
    each the first NEGATIVES rows of another label whose score lies within LEAST_PERCENT and
    MOST_PERCENT of the positive's are returned, by the same order. Scores are inner products
    of whole numbers, exact up to 2**53; a shorter vector counts as filled up with zeros. An
    anchor without positives and a positive without negatives give no row; so does an empty
    table.

    Rows are dealt by the hash of their id to trees of bounded size, so neither a frequent
    label nor copies of a row gather. Anchors go to them in blocks of bounded size, twice:
    for the positives, and for the windows these open.
    """
    rows = staged(rows, "usable-rows")
    count, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    anchors = rows.filter(is_anchor)
    wanted = anchors.count()
    trees = max(-(-count // ROWS_PER_TREE), 1)
    blocks = max(-(-wanted // ANCHORS_PER_BLOCK), 1)
    dealt = rows.withColumn("tree", F.pmod(F.xxhash64("vec_id"), F.lit(trees)))
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks))
    width, mined = width or 0, None
    for number in range(blocks):
        here = anchors.filter(block == number)
        first = _searched(dealt, _block_of(here.toArrow(), width, POSITIVES), width, False)
        positives = staged(_best(first, ["anchor_id"], POSITIVES, "positives"), "positives")
        asking = here.join(positives, here["vec_id"] == positives["anchor_id"]).select("vec_id", "label", "vector", "positives")
        second = _searched(dealt, _block_of(asking.toArrow(), width, POSITIVES), width, True)
        negatives = _best(second, ["anchor_id", "place"], NEGATIVES, "negatives")
        opened = positives.selectExpr("anchor_id", "posexplode(positives) AS (place, positive)")
        joined = negatives.join(opened, ["anchor_id", "place"]).selectExpr("anchor_id", "positive", "posexplode(negatives) AS (at, negative)")
        part = staged(joined, "negatives")
        mined = part if mined is None else mined.unionAll(part)
    return mined.selectExpr(
        "anchor_id", "positive.id AS positive_id", "CAST(at + 1 AS int) AS rank", "negative.id AS negative_id",
        "positive.score AS positive_score", "negative.score AS negative_score",
    )
