import numpy as np
import pytest
from pyspark.sql import functions as F

from billmill.llm import language, queries


@pytest.fixture(scope="module")
def predicted(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_language_id"](spark, sf_dir).collect()
    return docs, rows


def test_held_out_accuracy(predicted):
    docs, rows = predicted
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert held and all(0 <= r.score <= 1 for r in rows)
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right >= 0.95 * len(held)


def brute(text):
    flat = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    return {flat[i : i + n] for n in (1, 2, 3) for i in range(len(flat) - n + 1)} - {" "}


TEXTS = ["abc", "A b--c é", "aaa aaa", "x1y2", "c" * 9, "日本語 の文", "日本", "本日", "Ωμέγα 𐐨𐐩", "漢字仮名"]


def test_grams_are_those_of_the_text():
    for text in TEXTS:
        assert len(language.present(text)) == len(brute(text)), text
    assert len(language.present("")) == len(language.present(" 12 ")) == 0
    for one in TEXTS:
        for other in TEXTS:
            both = np.intersect1d(language.present(one), language.present(other))
            assert len(both) == len(brute(one) & brute(other)), (one, other)


def test_steps_lose_no_gram(monkeypatch):
    text = "ab, cde f-gh ij"
    whole = sorted(language.present(text))
    monkeypatch.setattr(language, "STEP", 3)
    assert sorted(language.present(text)) == whole


def test_languages_of_many_letters(spark):
    """Two languages told apart only by which of some thousand letters they use."""
    source = np.random.default_rng(7)
    letters = {"one": range(0x4E00, 0x5600, 2), "two": range(0x4E01, 0x5600, 2)}
    rows = [(i, "".join(chr(c) for c in source.choice(letters[lang], 300)), lang) for i in range(120) for lang in letters]
    docs = spark.createDataFrame([(i, text, lang) for i, (_, text, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    found = language.identify(docs, F.col("doc_id") < 160).join(docs, "doc_id").filter("doc_id >= 160").collect()
    assert sum(r.lang_pred == r.lang for r in found) == len(found) == 80


def test_odd_rows(spark):
    rows = [(i, w * 20, lang, 1) for i, (w, lang) in enumerate([("thing and ", "en"), ("being der ", "de")] * 5)]
    rows += [(50, None, "en", 1), (51, "", "en", 1), (52, "12 !?", None, 1), (53, "thing and " * 30_000, None, 1), (None, "der being", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    found = {r.doc_id: r for r in language.identify(docs, F.lit(True)).collect()}
    assert len(found) == len(rows)
    assert [found[i].lang_pred for i in (0, 1, 50, 51, 52, 53, None)] == ["en", "de", "und", "und", "und", "en", "de"]
    assert found[50].score == 0
    unlabelled = language.identify(docs.filter("lang IS NULL"), F.lit(True)).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert language.identify(docs.limit(0), F.lit(True)).collect() == []


def test_all_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "abc", "en", 0.5, "s")], "doc_id long, text string, lang string, score double, row string")
    got = language.predict(docs, language.fit(docs)).collect()[0]
    assert got.row.asDict() == {"doc_id": 1, "text": "abc", "lang": "en", "score": 0.5, "row": "s"} and got.lang_pred == "en"
