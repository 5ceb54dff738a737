import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from billmill.llm import mixing, queries

TOXIC = "idiot stupid moron trash pathetic disgusting worthless clown loser scum".split()


@pytest.fixture(scope="module")
def mixed(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet").collect()}
    return docs, queries.QUERIES["op8_soft_membership_mixing"](spark, sf_dir.replace("0.001", "0.01")).collect()


def test_expected_tokens_meet_the_targets(mixed):
    docs, rows = mixed
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.rate >= 0 and abs(r.p_good + r.p_junk + r.p_toxic - 1) < 0.002 for r in rows)
    tokens = np.array([r.n_tokens for r in rows], float)
    post = np.array([[r.p_good, r.p_junk, r.p_toxic] for r in rows])
    totals = (np.array([r.rate for r in rows]) * tokens) @ post
    assert np.abs(totals / tokens.sum() - [0.9, 0.1, 0.0]).sum() < 0.02


def test_posteriors_tell_toxic_text(mixed):
    docs, rows = mixed
    plain = {r.doc_id: len(set(re.findall(r"\w+", docs[r.doc_id].lower())) & set(TOXIC)) for r in rows}
    many = [r for r in rows if plain[r.doc_id] >= 2]
    none = [r for r in rows if plain[r.doc_id] == 0]
    assert len(many) >= 10
    assert sum(r.domain == "toxic" for r in many) >= 0.9 * len(many)
    assert sum(r.domain == "toxic" for r in none) <= 0.02 * len(none)


def test_least_squares_against_numpy(spark):
    """Rates of given posteriors: the objective is that of projected gradient descent in numpy."""
    source = np.random.default_rng(4)
    post = source.dirichlet([0.3, 0.3, 0.3], 200).round(3)
    tokens = source.integers(1, 500, 200)
    found = spark.createDataFrame([(int(t), p.tolist()) for t, p in zip(tokens, post)], "n_tokens long, posterior array<double>")
    targets = {"a": 0.2, "b": 0.7, "c": 0.1}
    history = mixing.fit_rates(found, ["a", "b", "c"], targets, total=1.5 * tokens.sum())
    rates = np.array([r[0] for r in found.select(mixing._rate(F.col("posterior"), history)).collect()])
    want = 1.5 * tokens.sum() * np.array([0.2, 0.7, 0.1])
    assert (rates >= 0).all()
    assert np.abs((rates * tokens) @ post - want).sum() <= 2e-4 * want.sum()


def test_odd_rows(spark):
    rows = [(i, ("bad evil " if i % 3 == 0 else "kind good ") * (i + 1), 1.0) for i in range(30)]
    rows += [(50, None, 1.0), (51, "", 1.0), (None, "kind", 1.0), (3, "bad evil ", 1.0), (52, "bad " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate double")
    labels = spark.createDataFrame(
        [(i, "x" if i % 3 == 0 else "y", "z") for i in range(30)] + [(None, "x", "z"), (4, None, "z"), (99, "y", "z")], "doc_id long, domain string, text string"
    )
    got = mixing.mix(docs, labels, {"x": 0.0, "y": 1.0}).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[50].n_tokens == 0 and by[51].n_tokens == 0 and by[52].n_tokens == 50_000
    assert by[52].domain == "x" and by[52].rate < 0.1 < by[1].rate
    alone = mixing.mix(docs, labels.limit(0), None).collect()
    assert {r.domain for r in alone} == {"all"} and {r.rate for r in alone} == {1.0}
    assert mixing.mix(docs.limit(0), labels, {"x": 1.0}).collect() == []
    drawn = mixing.drawn(docs, labels, drop=("x",)).collect()
    assert len(drawn) == len(rows) and set(drawn[0].row.asDict()) == {"doc_id", "text", "rate"}
    assert all(r.copies == 0 for r in drawn if "bad" in (r.row.text or ""))
    assert all(r.copies == 1 for r in drawn if "kind" in (r.row.text or ""))


def test_drawn_leaves_out_toxic_and_keeps_clean_text(spark, sf_dir):
    """At sf0.1, by the ten words and by the labels, as other languages have other toxic words."""
    path = sf_dir.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    domains = labels.select("doc_id", mixing.domain_of_labels().alias("domain"))
    rows = mixing.drawn(spark.read.parquet(f"{path}/documents.parquet"), domains, drop=("toxic",)).collect()
    worded = {r.row.doc_id for r in rows if set(re.findall(r"\w+", (r.row.text or "").lower())) & set(TOXIC)}
    clean = [r for r in rows if r.row.doc_id not in worded and toxic.get(r.row.doc_id) == 0]
    assert sum(r.copies > 0 for r in rows if r.row.doc_id in worded) <= 0.06 * len(worded)
    assert sum(r.copies == 0 for r in clean) <= 0.002 * len(clean)


def test_bounded_rates_against_numpy(spark):
    """Rates of at most 1: the steps of projected gradient descent in numpy."""
    source = np.random.default_rng(5)
    post, tokens = source.dirichlet([0.3, 0.3, 0.3], 200).round(3), source.integers(1, 500, 200)
    found = spark.createDataFrame([(int(t), p.tolist()) for t, p in zip(tokens, post)], "n_tokens long, posterior array<double>")
    history = mixing.fit_rates(found, ["a", "b", "c"], None, drop=("c",), most=1)
    rates = np.array([r[0] for r in found.select(mixing._rate(F.col("posterior"), history, 1)).collect()])
    want, gram = tokens @ post * [1, 1, 0], (post * tokens[:, None]).T @ post
    scale = np.diag(gram)
    step, expected = 1 / np.linalg.eigvalsh(gram / np.sqrt(np.outer(scale, scale))).max(), np.ones(200)
    for _ in range(len(history)):
        expected = np.clip(expected - post @ (step * ((expected * tokens) @ post - want) / scale), 0, 1)
    assert len(history) > 1 and np.abs(rates - expected).max() < 1e-6


def test_pipeline_draws_by_the_fitted_rates(spark, sf_dir):
    """Which documents stay follows from the rates, below the cut for clearly toxic ones too."""
    path = sf_dir.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", mixing.domain_of_labels().alias("domain"))
    model = mixing.fit(docs, labels)
    found = mixing.classified(docs, model)
    history = mixing.fit_rates(found, model.domains, None, drop=("toxic",), most=1)
    rated = found.withColumn("rate", mixing._rate(F.col("posterior"), history, 1)).join(docs, "doc_id")
    chance = F.pmod(F.xxhash64("text", F.lit(mixing.SEED)), F.lit(1 << 20)) / float(1 << 20)
    at = model.domains.index("toxic")
    rows = rated.select("doc_id", "posterior", "rate", chance.alias("chance")).collect()
    unclear = [r for r in rows if r.posterior[at] <= mixing.CLEAR]
    stay = {r.doc_id for r in unclear if r.rate + r.chance >= 1}
    kept = [r.doc_id for r in corpus_pipeline.mixing_sources(spark, docs, path).collect()]
    assert sorted(kept) == sorted(stay)
    assert {r.doc_id for r in unclear if r.rate == 0} - stay and len(stay) < len(unclear) <= 1.02 * len(stay)
