"""Recognised words to printed lines, and how sure the recognition was."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billmill.functions import text
from billmill.model import SCHEMAS

# A word is held against the first word of so many lines, the latest first.
LINES_LOOKED_AT = 3
# Share of the lower of two boxes, off its top and bottom, where a centre doesn't count.
EDGE = 0.25
STATE = "struct<recent: array<struct<line: int, twice: double, height: double, edge: double>>, lines: int, line_of: array<int>>"


def _sizes(box: Column) -> dict[str, Column]:
    """Of a box: twice its centre, its height, and twice the edge of one so high (1 at least)."""
    height = box["bottom"] - box["top"]
    return {"twice": box["top"] + box["bottom"], "height": height, "edge": F.greatest(height, F.lit(1.0)) * (2 * EDGE)}


def _side_by_side(a: Column, b: dict[str, Column]) -> Column:
    """Whether the centre of one box lies well within the height of the other: in the higher one's,
    less the lower one's edge. The other way round is less, so both are tried."""
    apart = F.abs(a["twice"] - b["twice"])
    return (apart <= a["height"] - b["edge"]) | (apart <= b["height"] - a["edge"])


def _placed(state: Column, word: Column) -> Column:
    """The state after one more word: it joins the latest line whose first word it stands
    beside, or starts a line. Earlier lines are looked at only if it doesn't join a later one."""
    sizes, line = _sizes(word), F.lit(None).cast("int")
    for i in reversed(range(LINES_LOOKED_AT)):
        first = F.get(state["recent"], F.lit(i))
        line = F.when(_side_by_side(first, sizes), first["line"]).otherwise(line)

    def after(state: Column, line: Column) -> Column:
        first = F.struct(state["lines"].alias("line"), *[size.alias(name) for name, size in sizes.items()])
        opened = F.slice(F.concat(F.array(first), state["recent"]), 1, LINES_LOOKED_AT)
        return F.struct(
            F.when(line.isNull(), opened).otherwise(state["recent"]).alias("recent"),
            (state["lines"] + line.isNull().cast("int")).alias("lines"),
            F.array_append(state["line_of"], F.coalesce(line, state["lines"])).alias("line_of"),
        )

    # A fold over the one line, as text.let would copy the whole state for each word.
    return F.aggregate(F.array(line), state, after)


def words_to_lines(words: DataFrame) -> DataFrame:
    """Lines (file_id, page, line_no, text) from word boxes: one exchange by page, where the
    words, by centre and from the left, are folded into lines; within a line, a stretch of the
    words sorted once more, they are joined from the left. Words of one place are joined in the
    order of their texts."""
    page = ["file_id", "page"]
    centre = ((F.col("top") + F.col("bottom")) / 2).alias("centre")
    box = F.struct(centre, *[F.col(c).cast("double").alias(c) for c in ("left", "top", "bottom")], "text")
    pages = words.groupBy(*page).agg(F.sort_array(F.collect_list(box)).alias("words"))
    none = F.lit(None).cast(STATE)
    start = F.struct(
        F.coalesce(none["recent"], F.array()).alias("recent"), F.lit(0).alias("lines"),
        F.coalesce(none["line_of"], F.array()).alias("line_of"),
    )
    placed = pages.withColumn("state", F.aggregate("words", start.cast(STATE), _placed))
    own = lambda w, i: F.struct(w["line_of"].alias("line"), w["words"]["left"].alias("left"), i.alias("at"), w["words"]["text"].alias("text"))
    from_left = F.sort_array(F.transform(F.arrays_zip("words", F.col("state.line_of").alias("line_of")), own))
    ordered = placed.select(
        *page, F.transform(from_left, lambda w: w["text"]).alias("texts"),
        F.sort_array("state.line_of").alias("line_of"), F.sequence(F.lit(0), F.col("state.lines") - 1).alias("lines"),
    )
    starts = F.transform("lines", lambda n: (F.array_position("line_of", n) - 1).cast("int"))
    started = ordered.withColumn("starts", starts)

    def line(n: Column) -> Column:
        last = F.coalesce(F.get("starts", n + 1), F.size("texts")) - 1
        said = F.transform(F.sequence(F.get("starts", n), last), lambda at: F.get("texts", at))
        return F.struct(n.alias("line_no"), F.array_join(said, " ").alias("text"))

    lines = started.select(*page, F.inline(F.transform("lines", line)))
    return lines.withColumn("text", text.tidy_ocr(F.col("text")))


def page_scores(words: DataFrame) -> DataFrame:
    """Per page: the mean score weighted by text length (0 without text), and the words."""
    size = F.length("text")
    mean = F.try_divide(F.sum(F.col("score") * size), F.sum(size))
    return words.groupBy("file_id", "page").agg(
        F.coalesce(mean, F.lit(0.0)).alias("score"), F.count("*").alias("words")
    )


def read_files(files: DataFrame, reader) -> DataFrame:
    """Receipts of files through a reader the user supplies: a function from (file_id,
    content) to lines. Lines leave Python at once; everything after is DataFrames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (row.file_id, page, number, line)
                for row in batch.itertuples()
                for page, number, line in reader(row.file_id, row.content)
            ]
            yield pd.DataFrame(rows, columns=["file_id", "page", "line_no", "text"])

    return files.select("file_id", "content").mapInPandas(run, SCHEMAS["lines"])
