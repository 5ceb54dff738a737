"""Language of a text by a string kernel: shared n-grams with landmarks, and ridge regression."""

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billmill.llm.common import Shared, first_of_key, text_blocks

SAMPLE_PER_LANGUAGE = 200
LANDMARKS_PER_LANGUAGE = 40
RIDGE = 1e-2
UNKNOWN = "und"
STEP = 1 << 20
CODES = 0x110000  # code points there are: a run of three has a number below 2^63
DOCS_PER_PRODUCT = 128
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)]))
    return _LETTER[0]


def steps(text: str) -> Iterator[np.ndarray]:
    """Letters of a text as code points in lower case, every run of others as one 0, with a 0
    before and after; in steps that overlap by two, so that no n-gram is lost."""
    tail = np.zeros(1, np.uint32)
    for at in range(0, len(text), STEP):
        piece = text[at : at + STEP].lower().encode("utf-32-le", "replace")
        codes = np.frombuffer(piece, np.uint32)
        codes = np.concatenate([tail, np.where(_letters()[codes], codes, 0)])
        if at + STEP >= len(text):
            codes = np.append(codes, np.uint32(0))
        codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]
        yield codes
        tail = codes[-2:]


def grams(codes: np.ndarray) -> np.ndarray:
    """Numbers of the runs of one, two and three code points. The three kinds have ranges of
    their own, so different runs have different numbers, whatever the script."""
    codes = codes.astype(np.int64)
    two = codes[:-1] * CODES + codes[1:]
    return np.concatenate([codes, two + CODES, two[:-1] * CODES + codes[2:] + CODES + CODES * CODES])


def present(text: str) -> np.ndarray:
    """The different n-grams of a text, a gap alone left out."""
    found = np.zeros(0, np.int64)
    for codes in steps(text):
        found = pd.unique(np.concatenate([found, pd.unique(grams(codes))]))
    return found[found != 0]


@dataclass
class Model:
    """Landmarks' n-grams and the weights of each language over the landmarks."""

    languages: list[str]
    vocabulary: np.ndarray  # the n-grams that any landmark has, ascending
    landmarks: np.ndarray  # vocabulary x landmarks: presence over the root of the landmark's n-grams
    weights: np.ndarray  # landmarks x languages


def common(vocabulary: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Places in the vocabulary of those n-grams that it has."""
    at = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
    return at[vocabulary[at] == found]


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit("\\p{L}")), F.lit(False))


def sample(docs: DataFrame, per_language: int) -> list[tuple[str, str]]:
    """lang and text of the first `per_language` labelled rows with a letter of each language,
    in the order of a hash of id and text."""
    labelled = docs.filter(F.col("lang").isNotNull() & has_letter(F.col("text")))
    slim = labelled.select("lang", F.xxhash64("doc_id", "text").alias("order"))
    chosen = first_of_key(slim, "lang", ["order"], per_language)
    wanted = F.broadcast(chosen.select("order").distinct())  # per_language rows of each language
    rows = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("order")).join(wanted, "order")
    best: dict[tuple[str, int], str] = {(r.lang, r.order): r.text for r in rows.collect()}
    return [(lang, best[lang, order]) for lang, order in sorted(best)]


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, landmarks: int = LANDMARKS_PER_LANGUAGE) -> Model | None:
    """Learn from docs (doc_id, text, lang): a sample of `per_language` rows of each language.

    The first `landmarks` of them are landmarks. Kernel values with them are mapped to Nyström
    features (whitened by the landmarks' own kernel), over which ridge regression separates
    each language from the rest. None where no row is labelled.
    """
    rows = sample(docs, per_language)
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    found = [present(text) for _, text in rows]
    order = {lang: 0 for lang in languages}
    chosen = []
    for i, (lang, _) in enumerate(rows):
        if order[lang] < landmarks:
            chosen.append(i)
        order[lang] += 1
    vocabulary = np.unique(np.concatenate([found[i] for i in chosen]))
    presence = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, own in enumerate(found):
        presence[i, common(vocabulary, own)] = 1 / np.sqrt(len(own))
    marks = np.ascontiguousarray(presence[chosen].T)
    values, vectors = np.linalg.eigh((presence[chosen] @ marks).astype(np.float64))
    kept = values > 1e-6 * values.max()
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    features = (presence @ marks).astype(np.float64) @ whiten
    target = np.array([[1.0 if lang == other else -1.0 for other in languages] for lang, _ in rows])
    ridge = features.T @ features + RIDGE * len(rows) * np.eye(features.shape[1]) / features.shape[1]
    weights = whiten @ np.linalg.solve(ridge, features.T @ target)
    return Model(languages, vocabulary, marks, weights.astype(np.float32))


def _scores(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    for at in range(0, len(texts), DOCS_PER_PRODUCT):
        found = {i: present(texts[i] or "") for i in range(at, min(at + DOCS_PER_PRODUCT, len(texts)))}
        rows = [i for i, own in found.items() if len(own)]
        if not rows:
            continue
        presence = np.zeros((len(rows), len(model.vocabulary)), np.float32)
        for place, i in enumerate(rows):
            presence[place, common(model.vocabulary, found[i])] = 1 / np.sqrt(len(found[i]))
        values = (presence @ model.landmarks) @ model.weights
        for i, value in zip(rows, values, strict=True):
            best = int(np.argmax(value))
            names[i] = model.languages[best]
            scores[i] = round(min(max((float(value[best]) + 1) / 2, 0.0), 1.0), 6)
    return names, scores


def predict(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs as `row` (a struct of all its columns, or of `keep`), with lang_pred
    and score.

    A text's kernel values with all landmarks, and the scores of the languages over them, are
    two matrix products per block of texts. The best language wins (the first of equal ones);
    score is its regression value moved from -1..1 to 0..1. A null text or one without a letter
    is `und` with score 0, and so is every text where nothing could be learned. Repeated rows
    get equal predictions.
    """
    shared = Shared(docs.sparkSession, model)
    rows = docs.select(F.struct(*(docs[c] for c in keep or docs.columns)).alias("row"), F.col("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for block in text_blocks(batch):
                texts = block.column("text").to_pylist()
                names, scores = _scores(model, texts) if model else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                yield pa.RecordBatch.from_arrays(
                    [block.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["row", "lang_pred", "score"],
                )

    schema = rows.select("row").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(scored, schema)


def identify(docs: DataFrame, learn_from: Column) -> DataFrame:
    """doc_id, lang_pred and score of every row, learned from the rows of `learn_from`."""
    model = fit(docs.filter(learn_from).select("doc_id", "text", "lang"))
    return predict(docs, model, ["doc_id"]).select("row.doc_id", "lang_pred", "score")
