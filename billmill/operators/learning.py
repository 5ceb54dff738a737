"""Labels learned from corrections, and their use on later receipts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billmill.functions import labels, money
from billmill.functions.text import normalize_label
from billmill.model import LEARNED_FIELDS, SHARED_LABEL_VENDORS
from billmill.operators.registry import insert_if_absent, vendor_key
from billmill.operators.skew import spread

def by_field(rows: DataFrame, keys: list[str], into: str) -> DataFrame:
    """subtotal, tax and total as rows (field, amount); null ones are left out."""
    pairs = ", ".join(f"'{f}', {f}" for f in LEARNED_FIELDS)
    stacked = f"stack({len(LEARNED_FIELDS)}, {pairs}) AS (field, {into})"
    return rows.selectExpr(*keys, stacked).filter(F.col(into).isNotNull())


def parts_of(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """A text's lines, split where several labelled amounts stand on one."""
    lines = texts.select(*keys, F.posexplode(F.split(text, r"\r\n|[\n\r]")).alias("line_no", "_line"))
    return lines.select(
        *keys, "line_no", F.posexplode(labels.split_labelled(F.col("_line"))).alias("part_no", "part")
    )


def changed_amounts(read: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrected amounts the reader missed or got wrong, by position in the file."""
    was = by_field(read, ["file_id", "seq"], "was")
    now = by_field(corrections, ["file_id", "seq", "vendor_key"], "amount")
    joined = now.join(was, ["file_id", "seq", "field"], "left")
    return joined.filter(F.col("was").isNull() | (F.col("was") != F.col("amount"))).drop("was")


def lessons(texts: DataFrame, read: DataFrame, corrections: DataFrame, vendors: DataFrame):
    """What corrections teach: (vendor_key, field, label). A lesson needs exactly one label
    in front of the amount in the file's text, and one that means nothing yet.

    "Exactly one" is smallest = largest, so no set of labels is gathered.
    """
    keyed = vendor_key(corrections, "vendor", vendors).filter("vendor_key IS NOT NULL")
    wanted = changed_amounts(read, keyed)
    ids = wanted.select("file_id").distinct()
    parts = parts_of(texts.join(ids, "file_id", "left_semi"), ["file_id"])
    told = parts.select(
        "file_id",
        labels.label_before(F.col("part")).alias("label"),
        F.explode(F.array_distinct(money.amounts_in(F.col("part")))).alias("amount"),
    ).filter("label IS NOT NULL")
    hits = wanted.join(told, ["file_id", "amount"])
    one = hits.groupBy("file_id", "seq", "vendor_key", "field").agg(
        F.min("label").alias("label"), F.max("label").alias("_other")
    )
    fresh = one.filter(F.col("label") == F.col("_other"))
    unknown = fresh.filter(labels.builtin_field(F.col("label")).isNull())
    return unknown.select("vendor_key", "field", "label").distinct()


def learn(texts, read, corrections, vendors, existing: DataFrame) -> DataFrame:
    """New rows for the table of learned labels."""
    found = lessons(texts, read, corrections, vendors)
    return insert_if_absent(found, existing, ["vendor_key", "field", "label"])


def shared_labels(known: DataFrame, vendors_needed: int = SHARED_LABEL_VENDORS) -> DataFrame:
    """Labels taught for enough vendors are used for every receipt."""
    pairs = known.select("vendor_key", "field", "label").distinct()
    counts = pairs.groupBy("field", "label").agg(F.count("*").alias("vendors"))
    return counts.filter(F.col("vendors") >= vendors_needed)


def wanting(receipts: DataFrame) -> DataFrame:
    """Receipts with text and a gap among subtotal, tax and total."""
    gap = F.col("subtotal").isNull() | F.col("tax").isNull() | F.col("total").isNull()
    return receipts.filter((F.coalesce("text", F.lit("")) != "") & gap)


def starts_of(plain: Column, longest: int) -> Column:
    """The starts of a text, up to a length, that a label can be: what follows is no letter or
    digit."""
    ends = F.sequence(F.lit(1), F.least(F.length(plain), F.lit(longest)))
    after = lambda n: F.substring(plain, n + 1, F.lit(1))
    return F.array_compact(
        F.transform(ends, lambda n: F.when(~after(n).rlike(r"[\p{L}\p{N}]"), F.substring(plain, F.lit(1), n)))
    )


def matches(receipts: DataFrame, known: DataFrame, vendors: DataFrame) -> DataFrame:
    """(id, vendor_key, field, label, amount): the first line of each gap's field that starts
    with a learned label and holds an amount. Each line is known by the few starts of it that
    a label can be, and meets labels by equality on the whole label, so a first word that many
    labels share brings no rows together; of the labels that fit the longest counts."""
    wanted = wanting(receipts)
    keyed = spread(vendor_key(wanted, "vendor", vendors), "id", F.length("text"), of=wanted)
    gaps = F.filter(
        F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in LEARNED_FIELDS]),
        lambda f: f.isNotNull(),
    )
    parts = parts_of(keyed.withColumn("_gaps", gaps), ["id", "vendor_key", "_gaps", "text"])
    parts = parts.drop("text").withColumn("_plain", normalize_label(F.col("part")))
    longest = known.agg(F.max(F.length("label"))).first()[0] or 1  # one number
    filled = F.when(F.col("part").rlike("[0-9]") & (F.col("_plain") != ""), starts_of(F.col("_plain"), longest))
    parts = parts.withColumn("label", F.explode(filled))
    # The vendor's own labels and the shared ones, in one join: with two the texts are read twice.
    own = known.select(F.col("vendor_key").alias("_by"), F.lit(True).alias("_own"), "field", "label").distinct()
    shared = shared_labels(known).select(F.lit("").alias("_by"), F.lit(False).alias("_own"), "field", "label")
    by = F.array(F.struct(F.col("vendor_key").alias("_by"), F.lit(True).alias("_own")),
                 F.struct(F.lit("").alias("_by"), F.lit(False).alias("_own")))
    asked = parts.select("*", F.inline(by))
    both = asked.join(own.unionByName(shared), ["_by", "_own", "label"]).select(*parts.columns, "field")
    fitting = both.filter(F.array_contains("_gaps", F.col("field")))
    rank = F.struct(
        -F.length("label"),
        F.array_position(F.array(*[F.lit(f) for f in LEARNED_FIELDS]), F.col("field")),
    )
    best = fitting.groupBy("id", "vendor_key", "line_no", "part_no", "part").agg(
        F.min_by(F.struct("field", "label"), rank).alias("m")
    )
    rest = labels.rest_after(F.col("part"), labels.value_pattern_column(F.col("m.label")))
    valued = best.withColumn("amount", money.last_amount(rest)).filter("amount IS NOT NULL")
    place = F.struct("line_no", "part_no")
    return valued.groupBy("id", "vendor_key", F.col("m.field").alias("field")).agg(
        F.min_by("m.label", place).alias("label"), F.min_by("amount", place).alias("amount")
    )


def apply_learned(receipts: DataFrame, known: DataFrame, vendors: DataFrame) -> DataFrame:
    """Receipts with gaps filled from learned labels, and the confidence scaled by what
    filling them adds."""
    found = matches(receipts, known, vendors)
    filled = found.groupBy("id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("amount"))).alias(f"_{f}") for f in LEARNED_FIELDS]
    )

    def sure(total: Column) -> Column:
        return money.confidence_of(
            F.col("vendor"), F.col("receipt_date"), total, F.col("receipt_number"), F.col("items")
        )

    joined = receipts.join(filled, "id", "left")
    any_filled = F.coalesce(*[F.col(f"_{f}") for f in LEARNED_FIELDS]).isNotNull()
    after = F.coalesce("total", "_total")
    base = sure(F.col("total"))
    scaled = F.when(base == 0, sure(after)).otherwise(sure(after) * F.try_divide("confidence", base))
    new = F.when(any_filled, F.round(F.least(scaled, F.lit(1.0)), 3)).otherwise(F.col("confidence"))
    return joined.withColumn("confidence", new).withColumns(
        {f: F.coalesce(f, f"_{f}") for f in LEARNED_FIELDS}
    ).select(*receipts.columns)


def count_uses(known: DataFrame, found: DataFrame) -> DataFrame:
    """Learned labels with times_used raised by the receipts the vendor's own label filled."""
    uses = (
        found.select("id", "vendor_key", "label").distinct()
        .groupBy("vendor_key", "label").agg(F.count("*").alias("_uses"))
    )
    joined = known.join(uses, ["vendor_key", "label"], "left")
    total = F.col("times_used") + F.coalesce("_uses", F.lit(0)).cast("int")
    return joined.withColumn("times_used", total).select(*known.columns)
