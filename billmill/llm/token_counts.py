"""Token counts under a unigram vocabulary, without making the tokens."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from billmill.llm.common import text_blocks

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_UNITS = 500_000
SCHEMA = "doc_id long, n_tokens long, score double"


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = (model.is_byte, model.is_control, model.is_unknown, model.is_unused)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not any(is_a(i) for is_a in special)
    ]


class Counter(dict):
    """Units (what follows a mark, up to the next one) to their number of pieces and score.

    An automaton over all pieces lists, for each end in a unit, the pieces that end there. The
    best path to an end is the best of (path to the piece's start + its score); of equal ones
    the piece that starts first stays. Where no piece of one character starts, the character
    may be taken as unknown, for the lowest score less a penalty; unknown characters in a row
    count once. These are the rules of a unigram tokenizer. The table of units seen is emptied
    when it is full, so memory is bounded.
    """

    def __init__(self, pieces: list[tuple[str, float]], most: int = CACHED_UNITS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min([score for _, score in pieces], default=0.0) - UNKNOWN_PENALTY
        self.most = most

    def __missing__(self, unit: str) -> tuple[int, float]:
        if len(self) >= self.most:
            self.clear()
        found = self[unit] = self.best(MARK + unit)
        return found

    def best(self, unit: str) -> tuple[int, float]:
        size = len(unit)
        score, count, known = [None] * (size + 1), [0] * (size + 1), [True] * (size + 1)
        score[0] = 0.0

        def close(end: int) -> None:
            """Take the last character as unknown, if no piece of its own starts there."""
            if unit[end - 1] not in self.single and score[end - 1] is not None:
                total = score[end - 1] + self.unknown
                if score[end] is None or total > score[end]:
                    score[end], known[end] = total, False
                    count[end] = count[end - 1] + (known[end - 1] or end == 1)

        done = 0
        if self.single:
            for last, (length, value) in self.automaton.iter(unit):
                end = last + 1
                while done < end - 1:
                    done += 1
                    close(done)
                start = end - length
                total = score[start] + value
                if score[end] is None or total > score[end]:
                    score[end], count[end], known[end] = total, count[start] + 1, True
        while done < size:
            done += 1
            close(done)
        return count[size], score[size]

    def of(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = text.replace(" ", MARK)
        units = (marked if marked[0] == MARK else MARK + marked).split(MARK)[1:]
        tokens, total = 0, 0.0
        for n, score in map(self.__getitem__, units):
            tokens += n
            total += score
        return tokens, total


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], most: int = CACHED_UNITS) -> DataFrame:
    """doc_id, n_tokens and score (that of the best segmentation) of every text, unit by unit.

    A null or empty text has 0 tokens and score 0. A repeated row is counted again; a null
    doc_id stays null. Pieces never reach over a mark, so units are counted one by one, and
    each different unit of a task once. The vocabulary is fixed and small (a public file), and
    travels with the task. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value, most)
        for batch in batches:
            for block in text_blocks(batch):
                rows = [counter.of(text) for text in block.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id").cast(pa.int64()),
                        pa.array(np.array([r[0] for r in rows], np.int64)),
                        pa.array(np.array([r[1] for r in rows], np.float64)),
                    ],
                    names=["doc_id", "n_tokens", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(counted, SCHEMA)
