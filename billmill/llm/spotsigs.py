"""Fingerprints of documents: chains of content words after common words."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billmill.llm.common import staged

# Anchors, and other common words that a chain passes over.
ANCHORS = ("the a an is was are le la les un une est der die das ist ein eine el los las una es").split()
COMMON = (
    "of and to in that it for on as with by be this from or at not have he i des de du et en que dans pour sur qui par "
    "und zu den von mit sich auf für dem nicht auch y por con para del se lo su al como no"
).split()
CHAIN = 3
ROWS_PER_CELL = 2_000
MOST_CELLS = 8_192


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the signature set of column `text` as `name`, sorted: a hash of each anchor and of
    the CHAIN content words that follow it (fewer at the end of the text; none at all, no
    signature).

    Words are runs of letters and digits in lower case; content words are neither anchors nor
    common. A text without any signature but with a visible character has one, of the whole
    text. A null, empty or blank text has none.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    passed = lambda w: w.isin(*ANCHORS, *COMMON)
    words = df.withColumn("_words", F.array_remove(F.split(F.lower(whole), "[^\\p{L}\\p{N}]+"), ""))
    lists = words.withColumn("_content", F.filter("_words", lambda w: ~passed(w))).withColumn(
        "_places", F.array_compact(F.transform("_words", lambda w, i: F.when(passed(w), i)))
    )
    # The j-th passed word (from 0), at place p, comes after p - j content words.
    spots = F.transform(
        "_places",
        lambda p, j: F.when(
            F.get("_words", p).isin(*ANCHORS) & (p - j < F.size("_content")),
            F.xxhash64(F.get("_words", p), F.array_join(F.slice("_content", p - j + 1, F.lit(CHAIN)), " ")),
        ),
    )
    found = lists.withColumn(name, F.array_sort(F.array_distinct(F.array_compact(spots))))
    alone = F.when(F.regexp_like(whole, F.lit("\\S")), F.array(F.xxhash64(whole))).otherwise(F.array().cast("array<bigint>"))
    return found.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(alone)).drop("_words", "_content", "_places")


def printed(signature_set: Column) -> Column:
    """A set as text: its members as hexadecimal numbers, in order."""
    return F.array_join(F.transform(signature_set, F.hex), " ")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets, 0 where their lengths alone keep it below `least` or one is empty;
    two empty sets are alike."""
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return (
        F.when(long == 0, F.lit(1.0))
        .when((short == 0) | (short < F.lit(least) * long), F.lit(0.0))
        .otherwise(common / (short + long - common))
    )


def length_part(size: Column, threshold: float) -> Column:
    """The part of a set length: sets that can reach the threshold are in one part or in two
    that follow each other."""
    return F.when(size > 0, F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)).otherwise(F.lit(-1)).cast("int")


def _place(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above the value, found by halving in a loop over a
    constant array; all for a null."""
    if not bounds:
        return F.lit(0)
    listed = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def step(at: Column, more: Column) -> Column:
        reached = F.coalesce(F.get(listed, at + more - 1) <= value, F.lit(True))
        return F.when((at + more <= len(bounds)) & reached, at + more).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def followed(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row with `next_text`, that of the next row in order of doc_id
    (nulls last, then by text); the last row is followed by the first.

    Rows are dealt by ranges of doc_id into cells, so a text moves once. The first row of each
    cell also stands at the end of the cell before.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    count = docs.count()
    cells = max(1, min(-(-count // ROWS_PER_CELL), MOST_CELLS))
    shares = [k / cells for k in range(1, cells)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares or [0.5], 10 * MOST_CELLS)).first()[0] or []
    bounds = sorted(set(bounds)) if shares else []
    cell = _place(F.col("doc_id"), bounds)
    rows = docs.withColumn("cell", cell.cast("int")).withColumn("last", F.lit(False))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text")
    firsts = rows.groupBy("cell").agg(F.min_by("text", order).alias("text"))
    # One row per cell: at most MOST_CELLS.
    before = Window.orderBy("cell")
    firsts = firsts.withColumn("cell", F.coalesce(F.lag("cell").over(before), F.max("cell").over(Window.partitionBy())))
    ends = firsts.select(F.lit(None).cast("long").alias("doc_id"), "text", "cell", F.lit(True).alias("last"))
    inside = Window.partitionBy("cell").orderBy("last", F.col("doc_id").asc_nulls_last(), "text")
    return rows.unionByName(ends).withColumn("next_text", F.lead("text").over(inside)).filter("NOT last").drop("cell", "last")


def edited(docs: DataFrame) -> DataFrame:
    """Adds n_chars and edited_text: the last quarter of the text's code points replaced by as
    many (or all) of the next text's first ones. Nulls are empty texts."""
    text, following = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "next_text"))
    count = F.length(text)
    quarter = F.floor(count / 4).cast("int")
    made = F.concat(F.substring(text, F.lit(1), count - quarter), F.substring(following, F.lit(1), quarter))
    return docs.withColumn("n_chars", count.cast("long")).withColumn("edited_text", made)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next of every row: its signature set, that of the edited text, and the likeness of its
    set to that one and to the next row's.

    Equal texts have equal fingerprints. Null, empty and blank texts have an empty fingerprint
    and are alike. Repeated rows are next to each other and so alike. An empty table gives no
    rows. Other columns are not read.
    """
    rows = edited(followed(docs))
    for text, name in (("text", "_own"), ("edited_text", "_edited"), ("next_text", "_next")):
        rows = with_signatures(rows, text, name)
    own, changed, following = F.col("_own"), F.col("_edited"), F.col("_next")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        printed(own).alias("fingerprint"),
        printed(changed).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"),
        likeness(own, following).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs (a, b, likeness) of different signature sets that are alike by `threshold`, each
    set standing for the smallest doc_id that has it, and nothing for sets that are empty.

    A set is put under its rarest signatures, as many as may be missing from a partner and one
    more, and there under the part of its length and the next longer one. Sets that meet are
    compared, those whose lengths rule it out before any signature is looked at.
    """
    sets = with_signatures(docs.select("doc_id", "text"), "text", "sigs").filter("size(sigs) > 0 AND doc_id IS NOT NULL")
    sets = staged(sets.groupBy("sigs").agg(F.min("doc_id").alias("id")), "signature-sets")
    held = sets.select("id", F.explode("sigs").alias("sig"))
    counts = held.groupBy("sig").agg(F.count("*").alias("n"))
    ordered = held.join(counts, "sig").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "sig"))).alias("order"))
    size = F.size("order")
    shown = ordered.select("id", size.alias("size"), F.explode(F.slice("order", F.lit(1), size - F.ceil(size * threshold).cast("int") + 1)).alias("s"))
    shown = staged(shown.filter("s.n > 1").select("id", "size", F.col("s.sig").alias("sig"), length_part(F.col("size"), threshold).alias("part")), "shown")
    other = shown.select(F.col("id").alias("b"), F.col("size").alias("size_b"), "sig", F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    met = shown.select(F.col("id").alias("a"), "size", "sig", "part").join(other, ["sig", "part"])
    met = met.filter("(size < size_b OR (size = size_b AND a < b))").filter(F.col("size") >= threshold * F.col("size_b")).select("a", "b").distinct()
    first, second = (sets.select(F.col("id").alias(n), F.col("sigs").alias(f"sigs_{n}")) for n in "ab")
    return (
        met.join(first, "a").join(second, "b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("sigs_a"), F.col("sigs_b"), threshold).alias("likeness"))
        .filter(F.col("likeness") >= threshold)
    )
