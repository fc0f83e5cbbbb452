"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An automaton lists the pieces that end at each position; dynamic programming carries the best score and its number
of pieces, never the pieces. The public files hold pieces in order of frequency but no unigram scores, so a piece
of rank r scores -round(1000 ln(r + 1)), its log frequency by Zipf's law in thousandths; integers add up without
rounding, so the order of additions does not matter. Ties fall as in unigram tokenizers: of equally good ways to
reach a position, the one whose last piece starts first stays. A character no piece covers costs ten less than the
worst score and counts as its UTF-8 bytes.

A text is cut where no piece can reach across, so a worker scores each different word once. Null text counts as
empty (no tokens, score 0); repeated rows are kept; an empty table gives an empty table; only the named columns
are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskweave.llm.piece_bpe import PieceVocabulary, WordCache, _broadcast_model

#: Score of an uncovered character below the worst piece's.
UNKNOWN_PENALTY = 10.0


def zipf_score(rank: int) -> float:
    """Score of the piece of a rank, counted from 1."""
    return float(-round(1000 * math.log(rank + 1)))


class UnigramCounter:
    """Counts the pieces of the best segmentation of texts."""

    def __init__(self, model: bytes):
        self.vocabulary = PieceVocabulary(model)
        self._score = {i: zipf_score(r) for r, i in enumerate(sorted(self.vocabulary.ids.values()), start=1)}
        self._sizes = {i: len(p) for p, i in self.vocabulary.ids.items()}
        self._floor = min(self._score.values()) - UNKNOWN_PENALTY
        self._cache = WordCache(lambda word: complex(*self.count_word(word)))  # both add up at once

    def count_word(self, word: str) -> tuple[float, int]:
        """Best score and piece count of one part."""
        score_of, sizes, floor = self._score, self._sizes, self._floor
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        matches = iter(self.vocabulary.automaton.iter(word))
        end, token = next(matches, (n, -1))
        for at in range(n):
            j, top, single = at + 1, None, False
            while end == at:  # longest first, so the earliest start keeps a tie
                size = sizes[token]
                score = best[j - size] + score_of[token]
                if top is None or score > top:
                    top, count[j] = score, count[j - size] + 1
                single = size == 1
                end, token = next(matches, (n, -1))
            if not single:
                score = best[at] + floor
                if top is None or score > top:
                    top, count[j] = score, count[at] + len(word[at].encode("utf-8", "surrogatepass"))
            best[j] = top
        return best[n], count[n]

    def count(self, text: str) -> tuple[float, int]:
        """Best score and piece count of a whole text."""
        total = sum(map(self._cache.__getitem__, self.vocabulary.cut(text)), 0j)
        return total.real, int(total.imag)


_LOADED: dict[int, UnigramCounter] = {}


def _counter(model) -> UnigramCounter:
    key = hash(model.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = UnigramCounter(model.value)
    return _LOADED[key]


def count_tokens(docs: DataFrame, model_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) of every whole text."""
    model = _broadcast_model(docs, model_path)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in batches:
            found = [counter.count(t or "") for t in batch.column(1).to_pylist()]
            columns = [
                batch.column(0),
                pa.array(np.array([c for _, c in found], dtype=np.int64)),
                pa.array(np.array([s for s, _ in found], dtype=np.float64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, score double")
