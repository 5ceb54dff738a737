"""Stretches of words that repeat with a period: Lyndon roots by grouping, extended both ways."""

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billmill.llm.common import text_blocks
from billmill.llm.words import mixed

LEAST_LENGTH = 6
LEAST_REPEATS = 4
RUNS = "array<struct<start: long, length: long, period: long>>"
BASE = 0x5851F42D4C957F2D


def lyndon_array(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each position; smaller ranks come first.

    Suffixes are held in groups, each the suffixes known to start with one Lyndon word, in
    order. Groups are taken from the highest down. A member's word follows, in the text, the
    nearest position to the left that is in a lower group: that position's word grows by as
    many copies of the member's word as point to it, and its suffix moves to a group just
    above its old one, more copies higher. When a group is taken its word is final.
    """
    size = len(ranks)
    letters = max(ranks, default=-1) + 1
    group = [-1, *ranks]  # positions count from 1; 0 stands left of the text
    members: list[list[int]] = [[] for _ in range(letters)]
    for at, rank in enumerate(ranks, 1):
        members[rank].append(at)
    length = [1] * letters
    lower = list(range(-1, letters - 1))
    higher = list(range(1, letters + 1))
    left = list(range(size + 1))  # itself, or where to look further left once its group is taken
    found = [0] * (size + 1)

    def opened(below: int, grown: int) -> int:
        """A new group just above another one."""
        new, above = len(length), higher[below]
        length.append(length[below] + grown)
        members.append([])
        lower.append(below)
        higher.append(above)
        higher[below] = new
        lower[above] = new
        return new

    current = letters - 1
    lower.append(current)  # stands above the highest group
    higher.append(-1)
    length.append(0)
    members.append([])
    while current >= 0:
        live = [at for at in members[current] if group[at] == current]
        word = length[current]
        for at in live:
            found[at] = word
            left[at] = at - 1
        copies: dict[int, int] = {}
        for at in live:
            before = left[at]
            while left[before] != before:
                left[before] = before = left[left[before]]
            left[at] = before
            if before:
                copies[before] = copies.get(before, 0) + 1
        if len(copies) == 1:
            ((before, times),) = copies.items()
            new = opened(group[before], times * word)
            members[new].append(before)
            group[before] = new
        elif copies:
            moves: dict[tuple[int, int], list[int]] = {}
            for before, times in copies.items():
                moves.setdefault((group[before], times), []).append(before)
            for (below, times), moved in sorted(moves.items(), reverse=True):
                new = opened(below, times * word)
                members[new] = moved
                for before in moved:
                    group[before] = new
        members[current] = []
        current = lower[current]
    return found[1:]


class Common:
    """Lengths of common extensions of positions of one sequence, through hashes of its parts."""

    def __init__(self, ids: np.ndarray):
        self.size = len(ids)
        up = np.full(self.size + 1, BASE, np.uint64)
        down = np.full(self.size + 1, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, self.down = np.cumprod(up), np.cumprod(down)
        values = mixed((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1])])

    def part(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items from a on equal those from b on, a < b."""
        return self._extended(b, lambda got, step: (a + got, b + got), self.size - b)

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items before a equal those before b, a < b."""
        return self._extended(b, lambda got, step: (a - got - step, b - got - step), a)

    def _extended(self, b: np.ndarray, places: Callable, room: np.ndarray) -> np.ndarray:
        got = np.zeros(len(b), np.int64)
        step = 1 << max(int(room.max(initial=1)).bit_length(), 1)
        while step:
            fits = np.flatnonzero(got + step <= room)
            if len(fits):
                one, two = (place[fits] for place in places(got, step))
                same = self.part(one, np.int64(step)) == self.part(two, np.int64(step))
                got[fits[same]] += step
            step >>= 1
        return got


def _by_comparing(ids: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """First item and end of the stretch around `at` that keeps the period."""
    differs = np.flatnonzero(ids[:-period] != ids[period:])
    after = np.searchsorted(differs, at)
    start = int(differs[after - 1]) + 1 if after else 0
    return start, (int(differs[after]) if after < len(differs) else len(ids) - period) + period


def _rooted(ids: np.ndarray, roots: np.ndarray, common: Common) -> tuple[np.ndarray, ...]:
    """Lyndon words that occur twice in a row, the first of each stretch: place and length of
    the word, start and end of the stretch that keeps its period."""
    at = np.flatnonzero(np.arange(len(ids)) + 2 * roots <= len(ids))
    period = roots[at]
    here = common.part(at, period)
    again = common.part(at + period, period) == here
    earlier = (at >= period) & (common.part(np.maximum(at - period, 0), period) == here)
    at, period = at[again & ~earlier], period[again & ~earlier]
    return at, period, at - common.left(at, at + period), at + period + common.right(at, at + period)


def runs_of(ids: np.ndarray, limits: int = 0) -> np.ndarray:
    """Rows (start, length, period) of all runs of long enough length, by start and period.
    Ids below `limits` occur once each and end every run."""
    if len(ids) < LEAST_LENGTH:
        return np.zeros((0, 3), np.int64)
    values, ranks = np.unique(ids, return_inverse=True)
    low, top = int(np.searchsorted(values, limits)), len(values) - 1
    common, found = Common(ranks), []
    for order in (ranks, np.where(ranks < low, ranks, top + low - ranks)):
        roots = np.array(lyndon_array(order.tolist()), np.int64)
        at, period, start, end = _rooted(ranks, roots, common)
        whole = end - start >= np.maximum(LEAST_LENGTH, LEAST_REPEATS * period)
        for root, p, a, b in zip(*(column[whole].tolist() for column in (at, period, start, end))):
            if not np.array_equal(ranks[a : b - p], ranks[a + p : b]):  # two parts had one hash
                a, b = _by_comparing(ranks, root, p)
            found.append((a, b - a, p))
    kept = {run for run in found if run[1] >= max(LEAST_LENGTH, LEAST_REPEATS * run[2])}
    return np.array(sorted(kept, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def stretches(ids: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches in which all runs lie. Every three words in a row of a
    run occur three times in it, so what no such three words cover is in no run; the same is
    asked of each stretch again until nothing more goes."""
    places = np.arange(len(ids))
    while True:
        if len(places) < LEAST_LENGTH:
            return places[:0], places[:0]
        here = ids[places].astype(np.uint64)
        inside = parts[2:] == parts[:-2]
        words = here[:-2] + mixed(here[1:-1] + mixed(here[2:] + mixed(parts[2:].astype(np.uint64))))
        keys, at, times = np.unique(words[inside], return_inverse=True, return_counts=True)
        first = np.flatnonzero(inside)[times[at] >= 3]
        joined = np.zeros(len(places), bool)  # with the next word
        joined[first] = joined[first + 1] = True
        begins = np.flatnonzero(joined & ~np.concatenate([[False], joined[:-1]]))
        ends = np.flatnonzero(~joined & np.concatenate([[False], joined[:-1]])) + 1
        if len(ends) < len(begins):
            ends = np.append(ends, len(places))
        whole = ends - begins >= LEAST_LENGTH
        begins, ends = begins[whole], ends[whole]
        sizes = ends - begins
        if sizes.sum() == len(places) or not len(begins):
            return places[begins], places[ends - 1] + 1 if len(begins) else begins
        offsets = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        places = places[np.arange(sizes.sum()) + offsets]
        parts = np.repeat(np.arange(len(sizes)), sizes)


def runs_in_block(ids: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The runs of each text of a block; text k has the words from starts[k] to starts[k + 1]."""
    begins, ends = stretches(ids, np.repeat(np.arange(len(starts) - 1), np.diff(starts)))
    sizes = ends - begins
    # The stretches one after the other, each ended by an item of its own.
    ahead = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)
    joined = np.zeros(ahead[-1], np.int64)
    if len(begins):
        inner = np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)
        joined[inner] = ids[np.arange(sizes.sum()) + np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)] + len(sizes)
        joined[ahead[1:] - 1] = np.arange(len(sizes))
    runs = runs_of(joined, len(sizes))
    which = np.searchsorted(ahead, runs[:, 0], "right") - 1
    runs[:, 0] += (begins[which] if len(begins) else 0) - ahead[which]
    texts = np.searchsorted(starts, runs[:, 0], "right") - 1
    runs[:, 0] -= starts[texts]
    cuts = np.searchsorted(texts, np.arange(len(starts)))
    return [runs[cuts[k] : cuts[k + 1]] for k in range(len(starts) - 1)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist())


Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def find(docs: DataFrame, prepare: Prepare | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words) and the collapsed text of every
    row of docs.

    A run is a stretch of words that keeps a smallest period, at least LEAST_REPEATS times the
    period and LEAST_LENGTH words long, and that no neighbouring word extends. Words are what
    white space ([\\x20\\x09-\\x0D]) parts; they are compared as they stand. `prepare` may change
    a row's words first. A null or empty text has no words, no runs and an empty collapsed
    text; a repeated row is answered again, a null doc_id stays null. Other columns are not
    read, whatever their names. Texts are worked off in blocks of bounded bytes; a longer text
    is a block of its own.
    """

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch):
                doc_ids = block.column("doc_id").to_pylist()
                texts = [(text or "").encode().split() for text in block.column("text").to_pylist()]
                if prepare:
                    texts = [prepare(doc_id, words) for doc_id, words in zip(doc_ids, texts)]
                numbers: dict[bytes, int] = {}
                ids = np.array([numbers.setdefault(word, len(numbers)) for words in texts for word in words], np.int64)
                starts = np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)
                runs = runs_in_block(ids, starts)
                flat = np.concatenate(runs)
                items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id").cast(pa.int64()),
                        pa.array(np.diff(starts)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32()), items),
                        pa.array([collapsed(words, found).decode() for words, found in zip(texts, runs)], pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(searched, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One row in ten, by the crc32 of its id, with its later words replaced by repetitions of
    the first of them; a row without an id stays as it is."""
    code = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if code % 10 or not words:
        return words
    seed, size = code // 10, len(words)
    start = seed % size
    period = 1 + (size - start) // (3 + seed % 8)
    repeats = -(-(size - start) // period)
    return words[:start] + (words[start : start + period] * repeats)[: size - start]


def strongest(runs: str) -> Column:
    """Of an array of runs the first with the greatest length / period, compared exactly."""
    first = F.get(runs, F.lit(0))
    return F.aggregate(runs, first, lambda best, run: F.when(run.length * best.period > best.length * run.period, run).otherwise(best))


def digested(docs: DataFrame, prepare: Prepare | None = looped) -> DataFrame:
    """Number of runs, the strongest one and digests of the runs and of the collapsed text."""
    best = F.col("best")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    return find(docs, prepare).withColumn("best", strongest("runs")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best.start.alias("start"),
        best.length.alias("length"),
        best.period.alias("period"),
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
