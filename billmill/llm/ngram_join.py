"""Exact Jaccard join of texts on word shingles, by filters in several token orders."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billmill.llm.common import staged, text_blocks
from billmill.llm.components import components_of_groups
from billmill.llm.words import hashed_words, mixed, shingles

WORDS = 5
PERCENT = 75
LOW = np.uint64(2**64 * 3 // 10)  # tokens below it are seen in the first order
ORDERS = (0x2545F4914F6CDD1D, 0x8CB92BA72F3D8DD7)  # seeds of two more orders
SLOTS = 1 << 20
TOKENS = "doc_id long, need int, tokens array<long>"
SHORT = 48  # bits of a token that is exchanged; those above hold in how many texts it is
MOST_TEXTS = (1 << 63 - SHORT) - 1


def token_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The set of shingle hashes of each text, sorted."""
    hashes, starts = shingles(*hashed_words(texts), words)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield np.unique(hashes[a:b])


def _short(tokens: np.ndarray) -> np.ndarray:
    """The upper bits of tokens. Two that agree in them only let more pairs be compared."""
    return (tokens >> np.uint64(64 - SHORT)).view(np.int64)


def spare(size: int | np.ndarray, percent: int = PERCENT):
    """How many tokens of a set may be missing from a set that it links with."""
    return size - (size * percent + 99) // 100


def _sets(percent: int, words: int):
    """doc_id, number of tokens and a 128-bit digest of the set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch):
                sizes, a, b = [], [], []
                for tokens in token_sets(block.column("text"), words):
                    sizes.append(len(tokens))
                    a.append(mixed(tokens ^ np.uint64(ORDERS[0])).sum(dtype=np.uint64))
                    b.append(mixed(tokens ^ np.uint64(ORDERS[1])).sum(dtype=np.uint64))
                numbers = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sizes, a, b)]
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id").cast(pa.int64()), *numbers], names=["doc_id", "n_shingles", "set_a", "set_b"]
                )

    return read


def _first_order(percent: int, words: int):
    """doc_id, need and tokens: the part of a set that is seen in the order of the hashes.

    All sets show their tokens below LOW. A link leaves at most `spare` tokens of a set
    unshared, so of more tokens than that, at least `need` = their number - spare are shared.
    A set with no more than `spare` tokens there shows its first spare + 1 tokens instead (the
    usual prefix); one of them is shared, so it needs one.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch):
                shown, need = [], []
                for tokens in token_sets(block.column("text"), words):
                    may = int(spare(len(tokens), percent))
                    low = int(np.searchsorted(tokens, LOW))
                    shown.append(tokens[: max(low, may + 1)])
                    need.append(max(low - may, 1))
                ends = np.cumsum([0, *map(len, shown)]).astype(np.int32)
                flat = _short(np.concatenate([*shown, np.zeros(0, np.uint64)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id").cast(pa.int64()),
                        pa.array(np.array(need, np.int32)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    ],
                    names=["doc_id", "need", "tokens"],
                )

    return read


def _all_tokens(percent: int, words: int):
    """doc_id, a hash of the set and all tokens."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch):
                sets = list(token_sets(block.column("text"), words))
                sizes = np.array([len(s) for s in sets])
                flat = _short(np.concatenate([*sets, np.zeros(0, np.uint64)]))
                which = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id").cast(pa.int64()),
                        pa.array(which),
                        pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(flat)),
                    ],
                    names=["doc_id", "which", "tokens"],
                )

    return read


def links(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets link: first their prefixes must share a token in each further order,
    then the whole sets are counted."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    for seed in ORDERS:
        x, y = mixed(a ^ np.uint64(seed)), mixed(b ^ np.uint64(seed))
        p, q = int(spare(len(a), percent)), int(spare(len(b), percent))
        x, y = np.partition(x, p)[: p + 1], np.partition(y, q)[: q + 1]
        if not len(np.intersect1d(x, y, assume_unique=True)):
            return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(percent: int, words: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            for block in text_blocks(batch):
                a = list(zip(block.column("a").to_pylist(), block.column("which_a").to_pylist()))
                kept = []
                for i, other in enumerate(token_sets(block.column("text"), words)):
                    if a[i] != last:
                        last, last_set = a[i], next(token_sets(block.column("text_a").slice(i, 1), words))
                    kept.append(links(last_set, other, percent))
                yield block.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return check


def _only(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) without most rows that are not in `ids`: a filter of at most SLOTS
    numbers, whatever the data, goes to all tasks, so that their texts need no exchange."""
    slot = lambda name: F.pmod(F.xxhash64(name), F.lit(SLOTS)).cast("int")
    marks = np.zeros(SLOTS, bool)
    for batch in ids.select(slot("doc_id").alias("slot")).distinct().toLocalIterator():
        marks[batch.slot] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            yield batch.select(["doc_id", "text"]).filter(pa.array(marks[batch.column("slot").to_numpy()]))

    return docs.select("doc_id", "text", slot("doc_id").alias("slot")).mapInArrow(kept, "doc_id long, text string")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose token is in several rows, and in how many (texts). The rows are read and
    exchanged once; those of one token, a few numbers each, are counted in one task."""
    return rows.withColumn("texts", F.count("*").over(Window.partitionBy("token"))).filter("texts > 1")


def join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest doc_id reachable over
    links, where two texts link when percent of the union of their shingles is common.

    Sets that are equal are one from the start. Others must pass filters in several orders of
    all tokens. In the order of the hashes a set shows the tokens that could matter, and must
    find as many of them in other texts as a link needs. What is left is put in the order of how
    many of the texts left have a token, rarest first, and each set is known by as many of its
    first tokens as may be missing from a partner, and one more, within the part of its length
    and the next. With a partner no smaller than itself a set shares still more, so fewer tokens
    can be the first that both have; those it owns. Sets that meet are compared by groups (see
    components_of_groups), if the tokens that each shares with any text are enough for sets of
    their sizes. Before the count, the prefixes in two further orders must meet.

    A null or empty text, or one without words, has no shingles and links with nothing. Rows
    of one doc_id should have one text; if texts differ, all count for that id, and link what
    they link with to each other. A null doc_id is never linked, and its component is null. An empty table gives no rows. Other columns
    are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = staged(docs.mapInArrow(_sets(percent, words), "doc_id long, n_shingles long, set_a long, set_b long"), "sets")
    digest = ["n_shingles", "set_a", "set_b"]
    whole = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    firsts = staged(whole.groupBy(*digest).agg(F.min("doc_id").alias("rep")), "firsts")

    shown = docs.mapInArrow(_first_order(percent, words), TOKENS).filter("doc_id IS NOT NULL")
    shown = shown.select("doc_id", "need", F.explode("tokens").alias("token"))
    met = _shared(shown).groupBy("doc_id", "need").count().filter(F.col("count") >= F.col("need"))
    met = staged(met.select("doc_id").join(firsts.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "met")

    texts = _only(met, docs).join(met, "doc_id", "left_semi")
    held = texts.mapInArrow(_all_tokens(percent, words), "doc_id long, which long, tokens array<long>")
    # an id that is there once needs nothing more to name its text
    repeated = not sets.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").isEmpty()
    held = held.dropDuplicates(["doc_id", "which"]) if repeated else held.withColumn("which", F.lit(0).cast("long"))
    held = held.select("doc_id", "which", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    need = F.expr(f"(size * {percent} + 99) div 100").cast("int")
    part = F.floor(F.log(F.col("need").cast("double")) / F.log(F.lit(105 / percent))).cast("int")
    more_needed = F.ceil(F.col("size") * (2 * percent) / (100 + percent)).cast("int")
    rarest_first = F.shiftleft(F.least("texts", F.lit(MOST_TEXTS)), SHORT).bitwiseOR(F.col("token"))
    rows = (
        _shared(held)
        .groupBy("doc_id", "which", "size")
        .agg(F.array_sort(F.collect_list(rarest_first)).alias("tokens"))
        .withColumn("need", need)
        .filter(F.size("tokens") >= F.col("need"))
        .select(
            F.col("doc_id").alias("rep"),
            "size",
            F.size("tokens").alias("shared"),
            part.alias("part"),
            (F.size("tokens") - more_needed + 1).alias("owned"),
            F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - F.col("need") + 1)).alias("place", "token"),
        )
        .select(
            "rep", "size", "shared", (F.col("shared") - F.col("place")).alias("rest"), (F.col("place") < F.col("owned")).alias("own"),
            F.inline(F.array(
                F.struct(F.xxhash64("token", "part").alias("token"), F.lit(False).alias("up")),
                F.struct(F.xxhash64("token", F.col("part") + 1).alias("token"), F.lit(True).alias("up")),
            )),
        )
    )

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
        texts = _only(ids, docs).withColumn("which", F.xxhash64("text"))
        texts = texts.dropDuplicates(["doc_id", "which"]) if repeated else texts
        sided = pairs.join(texts.select(F.col("doc_id").alias("b"), "text"), "b")
        sided = sided.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"), F.col("which").alias("which_a")), "a")
        return sided.select("a", "which_a", "b", "text", "text_a").mapInArrow(_verified(percent, words), "a long, b long")

    # Sets of one id, where it has several, are linked by it.
    named = whole.join(firsts, digest).select("doc_id", "rep")
    lowest = named.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("high")).filter("a < high")
    same_id = staged(named.join(lowest, "doc_id").filter("a < rep").select("a", F.col("rep").alias("b")).distinct(), "links-of-ids")
    labels = components_of_groups(
        rows,
        verified,
        # the first token that two sets have in common leaves enough after it in both
        may_link=f"NOT (up AND pivot_up) AND least(rest, pivot_rest) * {100 + percent} >= {percent} * (size + pivot_size)",
        may_stay=f"shared * {100 + percent} >= {percent} * (size + least_size)",
        known=same_id,
        central=("size - shared",),  # the fewest tokens of its own: what the others were made from
        may_meet="max(own) AND NOT min(up)",
        same=("rep", "size", "shared", "up"),
        first="-sum(rest)",
    )
    merged = firsts if labels is None else (
        firsts.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("rep", F.coalesce("component", "rep"))
    )
    return sets.join(merged.select(*digest, "rep"), digest, "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("component_id")
    )
