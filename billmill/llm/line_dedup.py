"""Lines that are equal or nearly equal: an edit-distance join on segments of lines."""

from functools import reduce
from string import ascii_lowercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billmill.llm.common import settled, staged
from billmill.llm.components import components_of_groups

EDITS = 2
LEAST_CHARS = 24
SLOTS = 1 << 20
LETTERS = ascii_lowercase + " "


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0) and line of every line of every text; a null text has none."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _segment(length: Column, number: int, edits: int) -> tuple[Column, Column]:
    """First place (from 1) and length of a segment (from 1) of lines of that length: edits + 1
    even parts, the last ones longer by one where it doesn't come out even."""
    parts = edits + 1
    short, rest = F.floor(length / parts).cast("int"), F.pmod(length, F.lit(parts))
    longer_before = F.greatest(F.lit(0), F.lit(number - 1) - (F.lit(parts) - rest))
    return (number - 1) * short + longer_before + 1, short + F.when(F.lit(number) > parts - rest, 1).otherwise(0)


def segment_keys(line: Column, length: Column, edits: int) -> list[Column]:
    """The index keys of a line: its length, and number and text of each segment."""
    keys = []
    for number in range(1, edits + 2):
        start, size = _segment(length, number, edits)
        keys.append(F.xxhash64(length, F.lit(number), F.substring(line, start, size)))
    return keys


def probe_keys(line: Column, length: Column, edits: int, least: int) -> list[Column]:
    """Keys under which lines of equal or shorter length may be found. A partner shorter by
    `less` has some segment unchanged in this line, shifted by no more than what the edits
    before and after it allow; only those places are looked up."""
    keys = []
    for less in range(edits + 1):
        other = length - less
        for number in range(1, edits + 2):
            start, size = _segment(other, number, edits)
            for shift in range(max(1 - number, less - (edits + 1 - number)), min(number - 1, less + (edits + 1 - number)) + 1):
                at = start + shift
                inside = (at >= 1) & (at + size - 1 <= length) & (other >= least)
                keys.append(F.when(inside, F.xxhash64(other, F.lit(number), F.substring(line, at, size))))
    return keys


def odd_letters(line: Column) -> Column:
    """A bit for each letter (and the space) that a line holds an odd number of times. An edit
    changes two bits at most."""
    size = F.octet_length(line)
    odd = [(size - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(1)) for c in LETTERS]
    return reduce(lambda bits, i: bits.bitwiseOR(F.shiftleft(odd[i], i)), range(1, len(odd)), odd[0])


def _common(a: Column, b: Column, most: Column, part) -> Column:
    """The largest n, up to `most`, at which part(a, n) = part(b, n), bit by bit."""
    bits = F.array(*(F.lit(1 << k) for k in range(30, -1, -1)))
    return F.aggregate(bits, F.lit(0), lambda n, bit: F.when((bit <= most - n) & (part(a, n + bit) == part(b, n + bit)), n + bit).otherwise(n))


def within(pairs: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b, line_a, line_b) whose lines are at most `edits` edits apart.

    What both begin and end with is left out. The rest is compared by an automaton of
    2 * edits + 1 diagonals, one bit each: after some characters of one line, word e holds the
    diagonals that e edits reach. A character keeps the diagonals where it equals the other
    line's, and an edit leads from word e to e + 1 by a diagonal up, down or straight on.
    """
    band = 2 * edits + 1
    full = (1 << band) - 1
    head = _common(F.col("line_a"), F.col("line_b"), F.least(F.length("line_a"), F.length("line_b")), lambda s, n: F.substring(s, F.lit(1), n))
    cut = settled(pairs.filter(F.abs(F.length("line_a") - F.length("line_b")) <= edits), head=head)
    cut = settled(cut.select("a", "b", "line_a", "line_b", "head"), **{f"rest_{c}": F.expr(f"substring(line_{c}, head + 1)") for c in "ab"})
    tail = _common(F.col("rest_a"), F.col("rest_b"), F.least(F.length("rest_a"), F.length("rest_b")), lambda s, n: F.right(s, n))
    cut = settled(cut.select("a", "b", "rest_a", "rest_b"), tail=tail)
    cut = settled(cut, **{f"n_{c}": F.expr(f"length(rest_{c}) - tail") for c in "ab"})
    cut = settled(cut, **{f"chars_{c}": F.split(F.expr(f"substring(rest_{c}, 1, n_{c})"), "") for c in "ab"})

    start = [1 << edits]
    for _ in range(edits):
        start.append((start[-1] | start[-1] << 1) & full)

    def step(words: Column, at: Column) -> Column:
        own = F.get(F.col("chars_a"), at)
        same = F.lit(0)
        for diagonal in range(band):
            same = same + F.when(own == F.get(F.col("chars_b"), at + (diagonal - edits)), 1 << diagonal).otherwise(0)
        after = [F.get(words, 0).bitwiseAND(same)]
        for e in range(1, edits + 1):
            before = F.get(words, e - 1)
            moved = before.bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(after[-1], 1))
            after.append(F.get(words, e).bitwiseAND(same).bitwiseOR(moved).bitwiseAND(F.lit(full)))
        return F.array(*after)

    places = F.when(F.col("n_a") > 0, F.sequence(F.lit(0), F.col("n_a") - 1)).otherwise(F.array().cast("array<int>"))
    done = settled(cut.select("a", "b", "n_a", "n_b", "chars_a", "chars_b"), words=F.aggregate(places, F.array(*map(F.lit, start)), step))
    bit = F.call_function("shiftright", F.get("words", edits), F.col("n_b") - F.col("n_a") + edits).bitwiseAND(F.lit(1))
    return done.filter(bit == 1).select("a", "b")


def deduplicated(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, line_no, class_doc, class_line, class_lines and kept of every line.

    Lines of at least `least` characters link when they are at most `edits` edits apart (code
    points inserted, deleted or replaced), shorter ones when they are equal. A class is what is
    reachable over links; it is named by its first line in order of doc_id (nulls last) and
    line_no, which alone is kept, and class_lines says how many lines it has. Blank lines are in
    no class (null) and kept. Repeated rows repeat their lines; of those one is first, the kept
    flag counts rows of one doc_id and line_no as one. A null text has no lines, an empty one a
    blank line. Other columns are not read.

    Equal lines are one before anything is compared (told apart by a 64-bit hash and length).
    A line is put under its edits + 1 segments; lines of its length and up to `edits` longer
    look under the substrings that an unchanged segment could have become. Lines that meet are
    compared by groups if no more letters differ in whether their number is odd than the edits
    can change, then verified. Only the lines to verify are looked up by text, through a
    semi-join with at most SLOTS numbers.
    """
    lines = lines_of(docs)
    blank = ~F.regexp_like("line", F.lit("\\S"))
    ident = F.xxhash64("line", F.length("line"))
    slim = staged(lines.select("doc_id", "line_no", F.when(~blank, ident).alias("h")), "lines")

    long = lines.filter(F.length("line") >= least).filter(~blank).groupBy("line").agg(F.count("*").alias("n")).select(ident.alias("h"), "line")
    long = settled(long, chars=F.length("line"), odd=odd_letters(F.col("line")))  # finding the length of a line takes a walk over it
    line, chars = F.col("line"), F.col("chars")
    index = long.select("h", "odd", F.explode(F.array(*segment_keys(line, chars, edits))).alias("token"))
    probe = long.select("h", "odd", F.explode(F.array_compact(F.array(*probe_keys(line, chars, edits, least)))).alias("token"))
    held = index.groupBy("token").agg(F.min("h").alias("one"), F.count("*").alias("n"))
    met = probe.join(held, "token").filter("one <> h OR n > 1").select("token", F.col("h").alias("rep"), "odd")
    met = staged(met, "met")
    owners = index.withColumnRenamed("h", "rep").join(met.select("token").distinct(), "token", "left_semi")
    sides = met.withColumn("own", F.lit(False)).unionByName(owners.select("token", "rep", "odd", F.lit(True).alias("own")))
    rows = sides.groupBy("token", "rep", "odd").agg(F.max("own").alias("own"), F.lit(0).alias("size"))
    rows = staged(rows, "rows")

    def verified(pairs: DataFrame) -> DataFrame:
        slot = lambda c: F.pmod(F.col(c), F.lit(SLOTS)).cast("int")
        slots = pairs.select(slot("a").alias("slot")).union(pairs.select(slot("b").alias("slot"))).distinct()
        near = lines.filter(F.length("line") >= least).select("line", ident.alias("h")).withColumn("slot", slot("h"))
        texts = near.join(F.broadcast(slots), "slot", "left_semi").groupBy("line").agg(F.first("h").alias("h"))  # at most SLOTS numbers
        sided = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("line_a")), "a")
        return within(sided.join(texts.select(F.col("h").alias("b"), F.col("line").alias("line_b")), "b"), edits)

    labels = components_of_groups(rows, verified, f"bit_count(odd ^ pivot_odd) <= {2 * edits}", same=("rep", "own"))
    if labels is not None:
        slim = slim.join(labels.withColumnRenamed("node", "h"), "h", "left").withColumn("h", F.coalesce("component", "h"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "line_no")
    firsts = slim.filter("h IS NOT NULL").groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("class_lines"))
    return slim.join(firsts, "h", "left").select(
        "doc_id",
        F.col("line_no").cast("long").alias("line_no"),
        F.col("first.doc_id").alias("class_doc"),
        F.col("first.line_no").cast("long").alias("class_line"),
        "class_lines",
        (F.col("first").isNull() | (F.col("first") == place)).alias("kept"),
    )
