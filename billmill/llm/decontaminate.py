"""Test items inside training texts: a BM25 index of the items, queried by every passage."""

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billmill.llm.common import Shared, text_blocks
from billmill.llm.words import hashed_words, shingles

K1, B = 1.2, 0.75
THRESHOLD = 0.5  # of the score that an item gives itself
OVERLAP = 0.6  # of a question's runs of words, and of an answer's words
ANSWER_PART = 4  # the last word in so many belongs to the answer
WORDS = 5
LEAST_STRIDE = 32
ITEMS_PER_BLOCK = 4
ITEMS_PER_INDEX = 500
INDEXES_PER_PASS = 8
LEAK = "item_id long, score double, question_overlap double, answer_overlap double"
_SEEN_BITS = 20


@dataclass
class Collection:
    """What BM25 needs of all items: how many, their mean length, and items per word."""

    items: int
    mean_length: float
    longest: int
    items_of: dict[int, int] = field(repr=False, default_factory=dict)


def aligned(question: np.ndarray, words: np.ndarray) -> float:
    """Share of a question that stands in order somewhere in a passage: its words less the
    fewest words inserted, left out or replaced (bit-parallel, a bit for each word asked)."""
    size = len(question)
    full, last = (1 << size) - 1, 1 << (size - 1)
    at: dict[int, int] = {}
    for k, word in enumerate(question.tolist()):
        at[word] = at.get(word, 0) | 1 << k
    up, down, edits, best = full, 0, size, size
    for word in words.tolist():
        same = at.get(word, 0)
        flat = (((same & up) + up) ^ up) | same | down
        right, left = down | (full & ~(flat | up)), up & flat
        edits += bool(right & last) - bool(left & last)
        best = min(best, edits)
        right, left = (right << 1) & full, (left << 1) & full
        up, down = left | (full & ~(flat | right)), right & flat
    return 1 - best / size


class Index:
    """Postings of the items' words with the impact of each, as a share of the score that the
    item gives itself; blocks of ITEMS_PER_BLOCK items with the highest impact of each word.

    With `near`, an item's impacts are raised so that its whole question, and the item without
    any one of its words, reach the threshold; `raised` says by how much."""

    def __init__(self, items: list[tuple[int, np.ndarray]], collection: Collection, threshold: float = THRESHOLD, near: bool = False):
        self.near, self.raised = near, np.ones(len(items))
        self.ids = [i for i, _ in items]
        self.words = np.unique(np.concatenate([*(w for _, w in items), np.zeros(0, np.uint64)]))
        self.seen = np.zeros(1 << _SEEN_BITS, bool)
        blocks = -(-len(items) // ITEMS_PER_BLOCK)
        self.block_max = np.zeros((len(self.words), blocks), np.float32)
        self.questions, self.asked, self.answers = [], [], []
        postings: list[list[tuple[int, float]]] = [[] for _ in self.words]
        for number, (_, words) in enumerate(items):
            terms, times = np.unique(words, return_counts=True)
            found = np.array([collection.items_of[w] for w in terms.tolist()], float)
            idf = np.log(1 + (collection.items - found + 0.5) / (found + 0.5))
            length = 1 - B + B * len(words) / collection.mean_length
            impact = idf * times * (K1 + 1) / (times + K1 * length)
            impact /= impact.sum() or 1.0
            last = max(1, len(words) // ANSWER_PART)
            question = words[: len(words) - last]
            if near and len(question) > 2:  # of less, nothing but the item is like it
                least = 1 - impact.max()
                if len(question) >= WORDS:
                    least = min(least, impact[np.isin(terms, question)].sum())
                self.raised[number] = max(1.0, threshold / max(least * (1 - 1e-6), 1e-6))
                impact *= self.raised[number]
            for term, value in zip(np.searchsorted(self.words, terms), impact, strict=True):
                postings[term].append((number, float(value)))
                self.block_max[term, number // ITEMS_PER_BLOCK] = max(self.block_max[term, number // ITEMS_PER_BLOCK], value)
            self.questions.append(question)
            self.asked.append(np.unique(shingles(words, np.array([0, len(words) - last]), WORDS)[0]))
            self.answers.append(np.unique(words[len(words) - last :]))
        self.block_max *= np.float32(1.00001)  # rounding must not lower a bound
        self.items = [[i for i, _ in own] for own in postings]
        self.impacts = [[value for _, value in own] for own in postings]
        # The words in most items, as many as can't give half the threshold to any block, are
        # left out of the first look at a text.
        spread = np.argsort([-len(own) for own in postings], kind="stable")
        sums = np.cumsum(self.block_max[spread], axis=0).max(axis=1, initial=0)
        common = spread[: int(np.searchsorted(sums, threshold / 2, side="right"))]
        self.slack = self.block_max[common].sum(axis=0)
        self.telling = np.setdiff1d(np.arange(len(self.words)), common)
        self.seen[self.words[self.telling] >> np.uint64(64 - _SEEN_BITS)] = True

    def terms(self, words: np.ndarray) -> np.ndarray:
        """Places of the words that the index has, each once."""
        words = np.unique(words)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return at[self.words[at] == words]

    def retrieve(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Items (their numbers) whose score for a passage of these words reaches the
        threshold. Blocks whose maxima don't add up to it are passed over as wholes."""
        bound = self.block_max[terms].sum(axis=0)
        return [hit for block in np.flatnonzero(bound >= threshold) for hit in self._wand(terms, int(block), threshold)]

    def _wand(self, terms: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND in a block: lists are kept in order of their next item; the first list
        at which the block's maxima add up to the threshold gives the pivot item; if all lists
        before it are there already the item is scored, else they move up to it."""
        end = min((block + 1) * ITEMS_PER_BLOCK, len(self.ids))
        lists, found = [], []
        for term in terms[self.block_max[terms, block] > 0].tolist():
            own = self.items[term]
            at = bisect_left(own, block * ITEMS_PER_BLOCK)
            lists.append([own[at], at, own, self.impacts[term], float(self.block_max[term, block])])

        def forward(entry: list, item: int) -> None:
            own, at = entry[2], entry[1]
            while at < len(own) and own[at] < item:
                at += 1
            entry[:2] = own[at] if at < len(own) else end, at

        while True:
            lists = sorted((e for e in lists if e[0] < end), key=itemgetter(0))
            total, pivot = 0.0, None
            for at, entry in enumerate(lists):
                total += entry[4]
                if total >= threshold:
                    pivot = at
                    break
            if pivot is None:
                return found
            item = lists[pivot][0]
            if lists[0][0] == item:
                here = [e for e in lists if e[0] == item]
                score = sum(e[3][e[1]] for e in here)
                if score >= threshold:
                    found.append((item, score))
                for entry in here:
                    forward(entry, item + 1)
            else:
                for entry in lists[:pivot]:
                    forward(entry, item)

    def verify(self, item: int, words: np.ndarray) -> tuple[float, float]:
        """Shares of the item's question (runs of words; with `near`, or words in order if more)
        and answer (words) in a passage."""
        question, own, answer = self.questions[item], self.asked[item], self.answers[item]
        runs = shingles(words, np.array([0, len(words)]), max(1, min(WORDS, len(question))))[0]
        asked = np.isin(own, runs).mean() if len(own) else 1.0
        if self.near and asked < 1:
            asked = max(asked, aligned(question, words))
        return float(asked), float(np.isin(answer, words).mean())

    def leaked(self, item: int, asked: float, answered: float, overlap: float) -> bool:
        whole = self.near and asked >= 1 and len(self.questions[item]) >= WORDS
        return whole or (asked >= overlap and answered >= overlap)


def _passages(index: Index, hashes: np.ndarray, starts: np.ndarray, stride: int, threshold: float):
    """Text, first and last word and index words of the passages whose block maxima reach the
    threshold in some block. Passages are two strides long and start at every stride, so that
    whatever is no longer than a stride lies whole in one of them."""
    telling = index.words[index.telling]
    at = np.flatnonzero(index.seen[hashes >> np.uint64(64 - _SEEN_BITS)])
    if not len(at) or not len(telling):
        return
    place = np.minimum(np.searchsorted(telling, hashes[at]), len(telling) - 1)
    real = telling[place] == hashes[at]
    at, term = at[real], place[real].astype(np.int64)
    text = np.searchsorted(starts, at, side="right") - 1
    per_text = -(-np.diff(starts) // stride)
    first = np.concatenate([[0], np.cumsum(per_text)])
    chunk = first[text] + (at - starts[text]) // stride
    # A passage is a chunk and the next one of its text; a word counts once in it.
    also = (at - starts[text]) >= stride
    pairs = np.unique(np.concatenate([chunk, chunk[also] - 1]) * len(telling) + np.concatenate([term, term[also]]))
    if not len(pairs):
        return
    number, term = np.divmod(pairs, len(telling))
    begin = np.flatnonzero(np.diff(number, prepend=-1))
    bound = np.add.reduceat(index.block_max[index.telling[term]], begin) + index.slack
    text_of = np.repeat(np.arange(len(per_text)), per_text)
    for passage in number[begin[np.flatnonzero(bound.max(axis=1) >= threshold)]]:
        own = text_of[passage]
        a = starts[own] + (passage - first[own]) * stride
        b = min(a + 2 * stride, starts[own + 1])
        yield own, a, b, index.terms(hashes[a:b])


def _leaks(texts: pa.Array, indexes: list[Index], stride: int, threshold: float, overlap: float) -> list[dict[int, tuple]]:
    """For each text, the verified items with score and overlaps (the best passage of each)."""
    hashes, starts = hashed_words(texts, letters_only=True)
    found: list[dict[int, tuple]] = [{} for _ in range(len(texts))]
    for index in indexes:
        for text, a, b, terms in _passages(index, hashes, starts, stride, threshold):
            for item, score in index.retrieve(terms, threshold):
                asked, answered = index.verify(item, hashes[a:b])
                if index.leaked(item, asked, answered, overlap):
                    own = (round(score / index.raised[item], 6), round(asked, 6), round(answered, 6))
                    found[text][index.ids[item]] = max(own, found[text].get(index.ids[item], own))
    return found


def collection(items: DataFrame) -> tuple[DataFrame, Collection]:
    """Items as hashed words, and the statistics of all of them without the words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch):
                hashes, starts = hashed_words(block.column("text"), letters_only=True)
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([block.column("item_id").cast(pa.int64()), lists], names=["item_id", "words"])

    words = items.select("item_id", "text").mapInArrow(read, "item_id long, words array<long>")
    words = words.filter("size(words) > 0 AND item_id IS NOT NULL").dropDuplicates(["item_id", "words"])
    row = words.agg(F.count("*"), F.coalesce(F.avg(F.size("words")), F.lit(1.0)), F.coalesce(F.max(F.size("words")), F.lit(1))).first()
    return words, Collection(row[0], float(row[1]), int(row[2]))


def matched(
    docs: DataFrame, items: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD, overlap: float = OVERLAP, near: bool = False
) -> DataFrame:
    """Every row of docs as `row` (a struct of all its columns, or of `keep`) with `leaks`: the
    items (item_id, text) found in its text, with score and overlaps, in order of item_id.

    Words are letters and digits, A-Z in lower case. Every passage of a text (two strides of
    words, a stride being the longest item's length) is a BM25 query against the items; all
    items are retrieved that reach `threshold` of their own score. They are verified: `overlap`
    of the runs of five words of the item's question (all but its last quarter) and of the
    words of its answer (the last quarter) must stand in the passage. A question of fewer words is
    one run.

    With `near`, near copies of short items count too: of the question, words in order are taken
    where they are a larger share than runs, and a whole question of five words or more needs no
    answer. The threshold is lower for items that would not reach it by their whole question, or
    without one of their words.

    Items are read ITEMS_PER_INDEX at a time and INDEXES_PER_PASS indexes go over the texts at
    once, so what is broadcast is bounded however many items there are. A null, empty or
    wordless text has no leaks; such items, and items without an id, are never found. Of items
    that share an id each text counts. Repeated rows get equal answers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*(docs[c] for c in keep or docs.columns)).alias("row"), F.col("text"))
    rows = rows.withColumn("leaks", F.array().cast(f"array<struct<{LEAK.replace(' ', ':').replace(',:', ',')}>>"))
    words, whole = collection(items)
    stride = max(LEAST_STRIDE, whole.longest)
    parts = max(1, -(-whole.items // (ITEMS_PER_INDEX * INDEXES_PER_PASS)))
    part = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    per_word = words.select("item_id", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("items"))
    for number in range(parts if whole.items else 0):
        own = words.filter(part == number)
        ask = own.select(F.explode("words").alias("word")).distinct().join(per_word, "word")
        whole.items_of = dict(Counter({r.word & (2**64 - 1): r["items"] for r in ask.toLocalIterator()}))
        listed = [(r.item_id, np.array(r.words, np.int64).view(np.uint64)) for r in own.orderBy("item_id", "words").toLocalIterator()]
        indexes = [Index(listed[i : i + ITEMS_PER_INDEX], whole, threshold, near) for i in range(0, len(listed), ITEMS_PER_INDEX)]
        rows = _pass(rows, Shared(spark, indexes), stride, threshold, overlap)
    return rows.select("row", F.array_sort("leaks").alias("leaks"))


def _pass(rows: DataFrame, shared, stride: int, threshold: float, overlap: float) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), *((n, pa.float64()) for n in ("score", "question_overlap", "answer_overlap"))]))
        for batch in batches:
            for block in text_blocks(batch):
                found = _leaks(block.column("text"), shared.value, stride, threshold, overlap)
                lists = [
                    (before or []) + [dict(zip(("item_id", "score", "question_overlap", "answer_overlap"), (i, *own), strict=True)) for i, own in new.items()]
                    for before, new in zip(block.column("leaks").to_pylist(), found, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([block.column("row"), block.column("text"), pa.array(lists, kind)], names=["row", "text", "leaks"])

    return rows.mapInArrow(read, rows.schema)


def contaminated(docs: DataFrame, items: DataFrame, near: bool = False) -> DataFrame:
    """doc_id and item_id of every document that holds a test item, with score and overlaps."""
    return matched(docs, items, ["doc_id"], near=near).select("row.doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
