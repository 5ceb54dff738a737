"""Connected components of links, and of links that are found group by group."""

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billmill.llm.common import staged

FIRST_PIVOTS, MORE_PIVOTS = 1, 8


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of links (a, b), every node once.

    Each round a node takes the smallest label of its neighbours and then its label's own
    label, so the distance to the smallest node halves. Every round is written, and one number
    comes back to the driver.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("low"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "low").alias("component"), F.col("component").alias("was"))
        roots = labels.select(F.col("node").alias("root"), F.col("component").alias("up"))
        jumped = lower.join(roots, lower["component"] == roots["root"]).select("node", F.least("component", "up").alias("component"), "was")
        jumped = staged(jumped, "labels")
        labels = jumped.select("node", "component")
        if jumped.filter("component <> was").isEmpty():
            return labels


def extended(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, component) after further links (a, b): only what they name is worked out
    again, as links between components."""
    if labels is None:
        return components(links)
    for end in "ab":
        named = labels.select(F.col("node").alias(end), F.col("component").alias("up"))
        links = links.join(named, end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
    links = staged(links.filter("a <> b").distinct(), "links-of-components")
    if links.isEmpty():
        return labels
    changed = components(links)
    up = changed.select(F.col("node").alias("component"), F.col("component").alias("up"))
    renamed = labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return staged(renamed.unionByName(changed.join(labels, "node", "left_anti")), "labels")


def different_groups(rows: DataFrame, may_meet: str, same: tuple[str, ...], first: str) -> DataFrame:
    """The rows of groups (token) of several rows for which `may_meet` holds. Of groups whose rows
    agree in the columns `same`, only that with the smallest `first` stays; both are aggregates.
    Such groups are told apart by their number of rows and 100 bits of hashes. Near copies share
    most of their tokens, and would meet once for each."""
    rows = rows.repartition("token")  # once, for the groups and for their rows
    own = F.xxhash64(*same)
    groups = rows.groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(own).alias("x"), F.sum(F.shiftrightunsigned(own, 28)).alias("s"),
        F.expr(first).alias("first"), F.expr(may_meet).alias("meet"),
    ).filter("n > 1 AND meet")
    kept = groups.groupBy("n", "x", "s").agg(F.min(F.struct("first", "token")).alias("kept"))
    return rows.join(kept.select("kept.token"), "token")  # each token once; a semi-join would go below the exchange


def components_of_groups(
    rows: DataFrame,
    verified: Callable[[DataFrame], DataFrame],
    may_link: str = "true",
    may_stay: str = "true",
    known: DataFrame | None = None,
    central: tuple[str, ...] = ("rep",),
    may_meet: str = "max(own)",
    same: tuple[str, ...] = ("rep",),
    first: str = "min(token)",
) -> DataFrame | None:
    """Components over all links between members of one group, where `rows` (token, rep, own,
    size) says which members a group has, and `verified` keeps the pairs (a, b) that link. Two
    members are compared if one that is no larger than the other owns the group, and if the
    condition `may_link` holds, which sees all columns of one and those of the other as pivot_*.
    A member for which `may_stay` fails links with no member of its group, by the group's
    smallest size, least_size; it leaves the group. Groups for which the aggregate `may_meet` fails
    hold no pair to compare, and groups whose rows agree in the columns `same` hold the same pairs;
    the one with the smallest aggregate `first` is looked at. `known` are links (a, b) to begin with. None
    if there are no links.

    Each round compares every group's first members by `central` (its pivots) with all others that
    are not yet in their component, and takes the pivots out. Groups of one component are done.
    So each pair that shares a group is compared or connected, but a group of copies costs one
    comparison each, not one for each pair. There are eight times as many pivots each round.
    """
    rows = staged(different_groups(rows, may_meet, same, first), "rows")
    tried, pivots = None, FIRST_PIVOTS
    labels = None if known is None or known.isEmpty() else components(known)
    while True:
        now = rows.withColumn("component", F.col("rep")) if labels is None else (
            rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
            .withColumn("component", F.coalesce("component", "rep"))
        )
        several = now.groupBy("token").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.expr(may_meet).alias("meet"),
            F.min("size").alias("least_size"),
        ).filter("low < high AND meet")
        now = now.join(several.select("token", "least_size"), "token").filter(may_stay).drop("least_size")
        now = staged(now, "open-groups")
        if now.isEmpty():
            return labels
        by_center = Window.partitionBy("token").orderBy(*map(F.expr, central), "rep")
        pivot = now.withColumn("pivot_number", F.row_number().over(by_center)).filter(F.col("pivot_number") <= pivots)
        pivot = pivot.select("token", F.col("rep").alias("pivot"), *(F.col(c).alias(f"pivot_{c}") for c in now.columns if c not in ("token", "rep")))
        pairs = (
            now.join(pivot, "token")
            .filter("pivot <> rep AND pivot_component <> component")
            .filter("(pivot_own AND pivot_size <= size) OR (own AND size <= pivot_size)")
            .filter(may_link)
            .select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b"))
            .distinct()
        )
        pairs = staged(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        done = pivot.select("token", F.col("pivot").alias("rep"), F.col("pivot_size").alias("size"))
        rows = staged(now.drop("component").join(done, ["token", "rep", "size"], "left_anti"), "rows")
        pivots *= MORE_PIVOTS
        if pairs.isEmpty():
            continue
        new = staged(verified(pairs).select("a", "b"), "new-links")
        if not new.isEmpty():
            labels = extended(labels, new)
