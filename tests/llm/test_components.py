import random

from pyspark.sql import functions as F

from billmill.llm import components


def labels_of(frame):
    return sorted((r.node, r.component) for r in frame.collect())


def test_further_links_give_the_same_components(spark):
    source = random.Random(3)
    for _ in range(3):
        links = [(source.randrange(60), source.randrange(60)) for _ in range(45)]
        frames = [spark.createDataFrame(part, "a long, b long") for part in (links[:25], links[25:])]
        whole = components.components(frames[0].union(frames[1]))
        first = components.components(frames[0])
        loops = {a for a, b in links if a == b}
        found = dict(labels_of(components.extended(first, frames[1])))
        for node, component in labels_of(whole):
            assert found.get(node, node) == component or node in loops
    assert labels_of(components.extended(first, frames[0])) == labels_of(first)


def test_groups_with_the_same_rows_are_looked_at_once(spark):
    rows = [(token, rep, 9 - token, token < 3, 5) for token in (1, 2, 3) for rep in (10, 11, 12)]
    rows += [(4, 10, 1, True, 5), (4, 11, 1, True, 5), (5, 12, 1, True, 5), (6, 10, 1, False, 5), (6, 12, 1, False, 5)]
    frame = spark.createDataFrame(rows, "token long, rep long, rest int, own boolean, size int")
    kept = components.different_groups(frame, "max(own)", ("rep", "size"), "-sum(rest)")
    # 1 to 3 hold the same rows and 1 comes first in them, 5 has one row, and nobody owns 6
    assert sorted({r.token for r in kept.collect()}) == [1, 4]


def test_near_copies_meet_in_few_groups(spark, monkeypatch):
    """A family that shares 100 tokens is compared in one group, not in 100."""
    rows = spark.range(100).withColumnRenamed("id", "token").crossJoin(spark.range(30).withColumnRenamed("id", "rep"))
    rows = rows.withColumns({"own": F.lit(True), "size": F.lit(100)})
    sizes, staged = [], components.staged

    def counted(df, name):
        out = staged(df, name)
        if name == "open-groups":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(components, "staged", counted)
    labels = components.components_of_groups(rows, lambda pairs: pairs)
    assert labels_of(labels) == [(rep, 0) for rep in range(30)]
    assert sizes == [30, 0]
