import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from billmill.llm import token_counts

FILE = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def pieces():
    return token_counts.vocabulary(FILE)


def tokenizer(pieces):
    made = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces], 0, False))
    made.pre_tokenizer = pre_tokenizers.Metaspace()
    return made


CASES = [None, "", " ", "  a  b ", "the\nthntion 漢字x漢", "▁x", "<unk>", "a\t\tb\t", "\u0000퟿\U0001f600\U0001f601 z",
         "Engäbe " * 5000]


def test_cases_against_the_tokenizer(spark, pieces):
    rows = [(i, text, "x") for i, text in enumerate(CASES)] + [(None, "a b", "y"), (1, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    whole = tokenizer(pieces)
    got = token_counts.count_tokens(docs, pieces).collect()
    assert len(got) == len(rows)
    want = sorted((i if i is not None else -1, len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    assert sorted((r[0] if r[0] is not None else -1, r[1]) for r in got) == want


def test_documents_against_the_tokenizer(spark, sf_dir, pieces):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = tokenizer(pieces)
    want = {r.doc_id: len(whole.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    got = token_counts.count_tokens(docs, pieces).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc é", max_size=30))
def test_ties_like_the_tokenizer(text):
    """Equal scores everywhere: the segmentation is decided by the tie rule."""
    pieces = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -3.0), ("bc", -1.0), ("▁", -1.0), ("▁a", -2.0), ("ca", -2.0)]
    counter = token_counts.Counter(pieces, most=3)
    assert counter.of(text)[0] == len(tokenizer(pieces).encode(text, add_special_tokens=False).ids)


def test_empty_table(spark, pieces):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(empty, pieces).collect() == []
