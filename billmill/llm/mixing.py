"""Rates at which documents are drawn, so that the domains' expected tokens meet targets."""

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billmill.llm.common import settled, staged

SAMPLE_PER_DOMAIN = 2_000
WORDS_PER_DOMAIN = 40
LEAST_DOCUMENTS = 5
CHANCE_WORDS = 0.01  # words that chance alone may give, of all that are tried
SEED = 8
CLEAR = 0.5  # posterior above which a document of a dropped domain goes
STEPS = 60
CLOSE = 1e-4  # of all target tokens
STILL = 1e-5  # of all tokens: no more is moved by a step


@dataclass
class Classifier:
    """A Bernoulli model: the words it looks for, and the score of each domain without and with
    each of them."""

    domains: list[str]
    words: list[str]
    base: list[float]
    present: list[list[float]]  # word x domain


def tokens_of(text: Column) -> Column:
    """Runs of letters and runs of other visible characters, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("\\p{L}+|[^\\p{L}\\s]+"), F.lit(0))


def _significance(own: Column, size: float, others: Column, rest: float) -> Column:
    """Root of the likelihood ratio of two shares (own of size, others of rest) against one, with
    the sign of their difference. It holds for few documents too, where the normal z is too large."""
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    pooled = (own + others) / F.lit(float(size + rest))
    ratio = sum((part(n, m * pooled) + part(m - n, m * (1 - pooled)) for n, m in ((own, F.lit(float(size))), (others, F.lit(float(rest))))), F.lit(0.0))
    return F.signum(own / F.lit(float(size)) - others / F.lit(float(rest))) * F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))


def fit(docs: DataFrame, labels: DataFrame, per_domain: int = SAMPLE_PER_DOMAIN) -> Classifier:
    """Learn domains from a table of labels (doc_id, domain).

    The sample is the first `per_domain` labelled documents of each domain in the order of a
    hash of the id. For each domain the WORDS_PER_DOMAIN words are kept whose share of its
    documents is most significantly above that of the others' (ties by the word); equal texts of
    a domain count as one. How significant it must be follows from the number of words tried, so
    that small tables have words too. Rows without doc_id or domain are not used; without any label there is one domain, `all`.
    """
    first = Window.partitionBy("domain").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        labels.filter("doc_id IS NOT NULL AND domain IS NOT NULL")
        .select("doc_id", "domain")
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= per_domain)
        .drop("rank")
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # per_domain rows of each domain
    sample = sample.withColumn("h", F.xxhash64("text")).dropDuplicates(["domain", "h"])  # equal texts say a thing once
    sample = staged(sample.select("domain", F.array_distinct(tokens_of(F.col("text"))).alias("tokens")), "labelled")
    sizes = {r.domain: r["n"] for r in sample.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(sizes)
    if len(domains) < 2:
        return Classifier(domains or ["all"], [], [0.0], [])
    size, whole = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair)), float(sum(sizes.values()))
    counts = sample.select("domain", F.explode("tokens").alias("word")).groupBy("word").pivot("domain", domains).count().na.fill(0)
    total = sum((F.col(f"`{d}`") for d in domains), F.lit(0))
    long = counts.filter(total >= LEAST_DOCUMENTS).select(
        "word",
        *(F.col(f"`{d}`").alias(f"n{k}") for k, d in enumerate(domains)),
        F.explode(F.array(*(
            F.struct(
                F.lit(d).alias("domain"),
                _significance(F.col(f"`{d}`"), sizes[d], total - F.col(f"`{d}`"), whole - sizes[d]).alias("z"),
            )
            for d in domains
        ))).alias("own"),
    )
    least = NormalDist().inv_cdf(1 - CHANCE_WORDS / max(long.count(), 1))
    rank = Window.partitionBy("own.domain").orderBy(F.col("own.z").desc(), "word")
    best = long.withColumn("rank", F.row_number().over(rank)).filter((F.col("rank") <= WORDS_PER_DOMAIN) & (F.col("own.z") > least))
    rows = {r.word: [r[f"n{k}"] for k in range(len(domains))] for r in best.collect()}
    words = sorted(rows)
    share = np.array([[(rows[w][k] + 0.5) / (sizes[d] + 1) for k, d in enumerate(domains)] for w in words]).reshape(-1, len(domains))
    prior = np.log([sizes[d] / whole for d in domains])
    return Classifier(domains, words, (prior + np.log1p(-share).sum(axis=0)).tolist(), (np.log(share) - np.log1p(-share)).tolist())


def classified(docs: DataFrame, model: Classifier, keep: str = "doc_id") -> DataFrame:
    """Column `keep`, n_tokens and posterior (an array in the order of the model's domains, to
    three places)."""
    base = F.array(*map(F.lit, model.base))
    tokens = settled(docs.select(F.col(keep).alias("kept"), tokens_of(F.col("text")).alias("tokens")), n_tokens=F.size("tokens").cast("long"),
                     known=F.array_intersect("tokens", F.array(*map(F.lit, model.words)).cast("array<string>")))
    scores = base
    if model.words:
        table = F.create_map(*(x for w, own in zip(model.words, model.present, strict=True) for x in (F.lit(w), F.array(*map(F.lit, own)))))
        scores = F.aggregate("known", base, lambda sums, word: F.zip_with(sums, F.element_at(table, word), lambda a, b: a + b))
    found = settled(tokens.select("kept", "n_tokens", "known"), scores=scores)
    found = settled(found, top=F.array_max("scores"))
    found = settled(found, raw=F.transform("scores", lambda s: F.exp(s - F.col("top"))))
    found = settled(found, total=F.aggregate("raw", F.lit(0.0), lambda a, b: a + b))
    found = settled(found, posterior=F.transform("raw", lambda p: F.round(p / F.col("total"), 3)))
    return found.select(F.col("kept").alias(keep), "n_tokens", "posterior")


def _rate(posterior: Column, history: list[list[float]], most: float | None = None) -> Column:
    """The rate after all steps: from 1, less the step of each round, never below 0 or above `most`."""
    if not history:
        return F.lit(1.0)
    steps = F.array(*(F.array(*map(F.lit, step)) for step in history))
    dot = lambda step: F.aggregate(F.zip_with(posterior, step, lambda p, s: p * s), F.lit(0.0), lambda a, b: a + b)
    held = lambda rate: F.greatest(F.lit(0.0), rate if most is None else F.least(F.lit(float(most)), rate))
    return F.aggregate(steps, F.lit(1.0), lambda rate, step: held(rate - dot(step)))


def fit_rates(found: DataFrame, domains: list[str], targets: dict[str, float] | None, total: float | None = None,
              drop: tuple[str, ...] = (), most: float | None = None) -> list[list[float]]:
    """Steps of projected-gradient least squares for the rates of classified documents.

    Minimised is the sum over domains of (expected tokens - target)^2, each divided by the
    domain's scale, over rates of 0 or more, up to `most` where it is given. Expected tokens of a domain are the sum over
    documents of rate * n_tokens * posterior. The gradient is taken in the metric of the
    tokens, so a document's rate depends on its posterior alone; documents are summed up by
    posterior once (three places, so there are at most about 1000^(domains - 1) / 2 of them),
    and each step is a sum over that table, of which one number per domain comes back. Targets
    are shares of `total` (all tokens if none); without targets each domain keeps what it has,
    but for those in `drop`, which get none.
    """
    cells = staged(found.groupBy("posterior").agg(F.sum("n_tokens").alias("tokens")), "mixing-cells")
    at = lambda k: F.element_at("posterior", k + 1)
    n = len(domains)
    mass = cells.agg(
        *(F.coalesce(F.sum(F.col("tokens") * at(k)), F.lit(0.0)) for k in range(n)),
        *(F.coalesce(F.sum(F.col("tokens") * at(j) * at(k)), F.lit(0.0)) for j in range(n) for k in range(n)),
    ).first()
    have, gram = np.array(mass[:n], float), np.array(mass[n:], float).reshape(n, n)
    whole = float(total if total is not None else have.sum())
    if targets is None:
        want = np.array([0.0 if d in drop else h for d, h in zip(domains, have, strict=True)])
    else:
        want = whole * np.array([targets.get(d, 0.0) for d in domains]) / (sum(targets.values()) or 1.0)
    scale = np.maximum(np.diag(gram), 1e-9)
    step = 1 / max(np.linalg.eigvalsh(gram / np.sqrt(np.outer(scale, scale))).max(), 1e-9)
    history: list[list[float]] = []
    for _ in range(STEPS):
        if np.abs(have - want).sum() <= CLOSE * max(want.sum(), 1.0):
            break
        history.append((step * (have - want) / scale).tolist())
        rate = _rate(F.col("posterior"), history, most)
        row = cells.select(*(F.col("tokens") * at(k) * rate for k in range(n))).toDF(*map(str, range(n)))
        before, have = have, np.array(row.agg(*(F.sum(str(k)) for k in range(n))).first(), float)
        if np.abs(have - before).sum() <= STILL * max(before.sum(), 1.0):
            break
    return history


def domain_of_labels() -> Column:
    """The domain of a row of the table of labels: toxic, or else good or junk by quality."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "junk")


def drawn(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float | None = None,
          drop: tuple[str, ...] = (), most: float | None = None) -> DataFrame:
    """Every row of docs as `row` (a struct of all its columns) with `copies`, a whole number. Rows
    are as for `mix`.

    A row has no copy if its posterior for the domains in `drop` together is above CLEAR. The
    others are drawn by their rate: its whole part, and one more by a hash of the text with the
    chance of the rest, so equal texts are drawn alike. `most` bounds the rates; with 1 no row is
    drawn twice. Without targets, where the domains keep what they have, and without `most`, they
    have the rounded rate and one copy at least.
    """
    model = fit(docs, labels)
    history = fit_rates(classified(docs, model), model.domains, targets, total, drop, most)
    both = F.struct(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.xxhash64("text", F.lit(SEED)).alias("drawn"))
    rated = classified(docs.select(both.alias("both"), F.col("text")), model, "both")
    dropped = sum((F.element_at("posterior", k + 1) for k, d in enumerate(model.domains) if d in drop), F.lit(0.0))
    chance = F.pmod(F.col("both.drawn"), F.lit(1 << 20)) / float(1 << 20)
    rate = _rate(F.col("posterior"), history, most)
    copies = F.greatest(F.round(rate), F.lit(1)) if targets is None and most is None else F.floor(rate + chance)
    return settled(rated, copies=F.when(dropped > CLEAR, 0).otherwise(copies).cast("int")).select("both.row", "copies")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None, total: float | None = None,
        drop: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, domain (the likeliest), posterior (by name) and rate of every row.

    A null or empty text has no tokens and the posterior of a text without any known word. A
    repeated row gets the same rate again, a null doc_id is kept. Where a domain with a target
    has no text at all, the nearest reachable totals are met. Empty tables give no rows. Other
    columns are not read.
    """
    model = fit(docs, labels)
    found = staged(classified(docs, model), "classified")
    history = fit_rates(found, model.domains, targets, total, drop)
    names = F.array(*map(F.lit, model.domains))
    likeliest = F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    rated = found.withColumn("rate", F.round(_rate(F.col("posterior"), history), 6)).withColumn("domain", likeliest)
    return rated.select("doc_id", "n_tokens", "domain", F.map_from_arrays(names, "posterior").alias("posterior"), "rate")
