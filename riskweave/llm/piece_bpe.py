"""SentencePiece BPE encoding and decoding with a merge-type prefix table.

For every prefix of a word exactly one token can end its encoding. An automaton lists the pieces that end at a
position, longest first; the first whose left neighbour (the last token of the prefix before it) is compatible
is stored. Two tokens are compatible if the merges of their joined text give the two tokens again. Ids are then
recovered from the end of the table backwards.

A text is cut where no piece can reach across: in front of a space behind a non-space and around characters that
no longer piece contains, so a worker encodes each different word once and keeps it in a bounded cache. The
vocabulary file is read by the driver and sent to the workers (half a megabyte).

Null text counts as empty and encodes to the end id alone; repeated rows are kept; an empty table gives an empty
table; only the named columns are read.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from riskweave.llm.ship import shipped, tidy

SPACE = "▁"
#: Bytes of words and results a task remembers before it starts afresh (as estimated), and pairs of ids a worker knows.
CACHED_BYTES, CACHED_PAIRS = 64_000_000, 400_000
#: What a remembered word takes besides its characters and its result.
_ENTRY_BYTES = 250
_UNKNOWN = -1
#: More than there are ids: a pair of ids makes one key.
_IDS = 1 << 32

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class PieceVocabulary:
    """Pieces, scores and bytes of a vocabulary file, and where texts may be cut."""

    def __init__(self, model: bytes):
        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = reader.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores: list[float] = [reader.get_score(i) for i in range(n)]
        self.surface: list[bytes] = []
        self.byte_ids: list[int] = [0] * 256
        self.end_id = reader.eos_id()
        for i in range(n):
            piece = reader.id_to_piece(i)
            if reader.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif reader.is_control(i):
                self.surface.append(b"")
            elif reader.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.surface.append(piece.replace(SPACE, " ").encode())
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        longer = [p for p in self.ids if len(p) > 1]
        joined = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in longer)
        used = set("".join(longer))
        alone = "".join(c for c in "\n\r\t\v\f" if c not in used)
        cut = re.escape(alone)
        if joined:  # pieces run across spaces: only lone characters cut
            self.words = re.compile(f"[{cut}]|[^{cut}]+" if alone else r"(?s).+")
        else:
            self.words = re.compile((f"[{cut}]|" if alone else "") + f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+")

    def cut(self, text: str) -> list[str]:
        """The normalised text (one leading space added, spaces marked) in independent parts."""
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def unknown_bytes(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]


class WordCache(dict):
    """Results for words, computed when first asked for; very long words are not kept."""

    def __init__(self, compute: Callable[[str], object]):
        super().__init__()
        self._compute = compute
        self._bytes = 0

    def __missing__(self, word: str):
        found = self._compute(word)
        if len(word) <= 256:
            self._bytes += _ENTRY_BYTES + 4 * len(word) + 4 * len(word)  # a result has as many ids as characters at most
            if self._bytes > CACHED_BYTES:
                self.forget()
            self[word] = found
        return found

    def forget(self) -> None:
        self.clear()
        self._bytes = 0


class PieceBpe:
    """Encoder and decoder of a BPE vocabulary with byte fallback."""

    def __init__(self, model: bytes):
        self.vocabulary = PieceVocabulary(model)
        self._text = {i: p for p, i in self.vocabulary.ids.items()}
        self._sizes = {i: len(p) for p, i in self.vocabulary.ids.items()}
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._cache = WordCache(lambda word: array("i", self.encode_word(word)).tobytes())
        self._end = np.int32(self.vocabulary.end_id).tobytes()

    def forget_words(self) -> None:
        """Drop the words of a task; workers live on."""
        self._cache.forget()

    def _merge(self, text: str) -> list[str]:
        """Merges in order of score, leftmost first; only for joined pairs of pieces, so short."""
        ids, scores = self.vocabulary.ids, self.vocabulary.scores
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _is_whole(self, token: int) -> bool:
        found = self._whole.get(token)
        if found is None:
            found = self._whole[token] = self._merge(self._text[token]) == [self._text[token]]
        return found

    def _learn(self, key: int) -> bool:
        """Whether two neighbours, or a first token (behind ``_UNKNOWN``), stand in an encoding; kept by key."""
        left, right = divmod(key, _IDS)
        if left == _UNKNOWN:
            found = self._is_whole(right)
        else:
            a, b = self._text[left], self._text[right]
            found = self._merge(a + b) == [a, b]
        if len(self._fits) >= CACHED_PAIRS:
            self._fits.clear()
        self._fits[key] = found
        return found

    def encode_word(self, word: str) -> list[int]:
        """Ids of one part, by its prefix table."""
        fits, sizes = self._fits, self._sizes
        n = len(word)
        last = [_UNKNOWN] * (n + 1)
        for end, token in self.vocabulary.automaton.iter(word):  # by end, longest first
            j = end + 1
            if last[j] == _UNKNOWN:
                key = last[j - sizes[token]] * _IDS + token
                ok = fits.get(key)
                if ok or ok is None and self._learn(key):
                    last[j] = token
        out: list[int] = []
        j = n
        while j:
            token = last[j]
            if token == _UNKNOWN:
                out.extend(reversed(self.vocabulary.unknown_bytes(word[j - 1])))
                j -= 1
            else:
                out.append(token)
                j -= sizes[token]
        out.reverse()
        return out

    def encode(self, text: str, end: bool = True) -> np.ndarray:
        """Ids of a whole text as int32, with the end id."""
        parts = list(map(self._cache.__getitem__, self.vocabulary.cut(text)))
        if end:
            parts.append(self._end)
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; controls vanish, bytes that are no UTF-8 become replacement characters one by one."""
        surface = self.vocabulary.surface
        raw = b"".join(map(surface.__getitem__, ids))
        # the space put before the text goes, if it is there: the mark of the first piece
        first = next((i for i in ids if surface[i]), None)
        return (raw[1:] if self._text.get(first, "")[:1] == SPACE else raw).decode("utf-8", "each_byte")


_LOADED: dict[int, PieceBpe] = {}


def _codec(model) -> PieceBpe:
    """One codec for each worker and vocabulary."""
    key = hash(model.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceBpe(model.value)
    return _LOADED[key]


def _broadcast_model(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return shipped(df).sparkSession.sparkContext.broadcast(f.read())  # the vocabulary: fixed size


def _encoded(codec: PieceBpe, texts: list[str | None]) -> pa.ListArray:
    ids = [codec.encode(t or "") for t in texts]
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))


def _decoded(codec: PieceBpe, lists: pa.ListArray) -> pa.Array:
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    texts = [
        codec.decode(flat[a:b].tolist()) if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], lists.is_valid().to_pylist())
    ]
    return pa.array(texts, pa.string())


def _by_parts(model, work: Callable[[PieceBpe, pa.RecordBatch], pa.RecordBatch]):
    """Work on few texts of a batch at a time; a task's words are forgotten at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield work(codec, batch.slice(at, 256))
        codec.forget_words()

    return tidy(run)


def encode_texts(docs: DataFrame, model_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text, the end id last."""
    model = _broadcast_model(docs, model_path)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))

    def work(codec: PieceBpe, part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), _encoded(codec, part.column(1).to_pylist())], ["doc_id", "ids"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_by_parts(model, work), f"doc_id {kind}, ids array<int>")


def encode_and_decode(docs: DataFrame, model_path: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ``decode_ids`` of ``encode_texts`` in one worker a task instead of two."""
    model = _broadcast_model(docs, model_path)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))

    def work(codec: PieceBpe, part: pa.RecordBatch) -> pa.RecordBatch:
        ids = _encoded(codec, part.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([part.column(0), ids, _decoded(codec, ids)], ["doc_id", "ids", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_by_parts(model, work), f"doc_id {kind}, ids array<int>, decoded string")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """The rows of ``encode_texts`` with ``decoded``, the text of the ids (null ids: null)."""
    model = _broadcast_model(encoded, model_path)
    rows = encoded.select("doc_id", "ids")

    def work(codec: PieceBpe, part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns, _decoded(codec, part.column(1))], ["doc_id", "ids", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_by_parts(model, work), f"doc_id {kind}, ids array<int>, decoded string")
