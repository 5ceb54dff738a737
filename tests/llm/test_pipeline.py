import re

import corpus_pipeline
import pytest
from test_decontaminate import words
from test_ngram_join import brute

from billmill.llm.common import staged, table


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(staged(stage(spark, kept[-1], sf_dir), f"test-{name}"))
    return kept


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_return_documents(stages):
    assert [len(corpus_pipeline.STAGES)] == [5]
    for frame in stages[:-1]:
        assert frame.columns == stages[0].columns
    last = stages[-1].collect()
    assert sorted(r.doc_id for r in last) == sorted(texts(stages[-2]))
    assert {r.shard for r in last} <= set(range(16))


def test_language_keeps_texts_with_letters(stages):
    before, after = texts(stages[0]), texts(stages[1])
    lost = set(before) - set(after)
    assert all(not re.search(r"[^\W\d_]", before[i]) or len(before[i]) < 60 for i in lost)
    assert len(lost) <= 0.02 * len(before)


def test_one_of_each_group_stays(stages):
    before = texts(stages[1])
    assert set(texts(stages[2])) == {i for i, _, group in brute(list(before.items())) if group == i}


def test_no_test_item_stays(spark, stages, sf_dir):
    before, after = texts(stages[2]), texts(stages[3])
    flat = {i: f" {' '.join(words(t))} " for i, t in before.items()}
    items = [f" {' '.join(words(r.text))} " for r in table(spark, sf_dir, "benchmark").collect()]
    leaked = {i for i, t in flat.items() if any(item in t for item in items)}
    assert not leaked & set(after)
    assert len(set(before) - set(after) - leaked) <= 0.01 * len(before)


def test_toxic_text_goes_and_clean_text_stays(stages):
    toxic = set("idiot stupid moron trash pathetic disgusting worthless clown loser scum".split())
    before, after = texts(stages[3]), texts(stages[4])
    clean = {i for i, t in before.items() if not toxic & set(re.findall(r"\w+", t.lower()))}
    assert len(clean - set(after)) <= 0.02 * len(clean)


def test_mixing_leaves_out_labelled_toxic_text_of_a_small_table(spark, stages, sf_dir):
    before, after = texts(stages[3]), texts(stages[4])
    toxic = {r.doc_id for r in table(spark, sf_dir, "labels").filter("toxic = 1").collect()} & set(before)
    assert len(toxic - set(after)) >= 0.5 * len(toxic) > 0


def test_run_is_the_stages_one_after_the_other(spark, stages, sf_dir):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_empty_and_odd_documents(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    empty = docs.limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", "en", "s", 5)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        for rows in (empty, odd):
            assert stage(spark, rows, sf_dir).count() <= 4, name
