"""Words of whole texts as 64-bit hashes, a few megabytes of text at a time.

A word is a run of bytes other than space and U+0009 to U+000D; no character of UTF-8 has such a byte inside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text makes a slice of its own.
SLICE_BYTES = 800_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARKS = _SPACE.copy()
_MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@dataclass
class Words:
    """Words of some texts: ``first[i]`` to ``first[i + 1]`` are those of text ``i``."""

    first: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    sums: np.ndarray

    def prefix_hashes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash) of the first ``size`` bytes of the words that are longer than that."""
        at = np.flatnonzero(self.end - self.start > size)
        start = self.start[at]
        _, down = _powers(max(16, len(self.data).bit_length()))
        return at, mix(mix((self.sums[start + size] - self.sums[start]) * down[start]) ^ np.uint64(size))

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``most`` bytes of text."""
    if batch.num_rows == 0:
        return
    column = batch.column(text)
    sizes = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()  # workers live on; what a batch took goes back


def split(texts: pa.Array, lower: bool = False, marks: bool = False) -> Words:
    """Words of texts (null: none), with A-Z lower-cased if asked for; ``marks``: ASCII punctuation parts words too."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    whole = texts.buffers()[2]
    if whole is None or offsets[-1] == offsets[0]:
        none = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(n + 1, dtype=np.int64), none.astype(np.uint64), none, none, none.astype(np.uint8), np.zeros(1, dtype=np.uint64))
    data = np.frombuffer(whole, dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if texts.null_count:  # a null may have bytes below it
        keep = np.asarray(texts.is_valid())
        if np.any(np.diff(offsets)[~keep]):
            return split(texts.fill_null(""), lower, marks)
    space = (_MARKS if marks else _SPACE)[data]
    word = ~space
    first_byte = np.zeros(len(data) + 1, dtype=bool)
    first_byte[offsets] = True
    opens = word.copy()
    opens[1:] &= space[:-1] | first_byte[1:-1]
    closes = word
    closes[:-1] &= space[1:] | first_byte[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _powers(max(16, int(len(data)).bit_length()))
    values = _BYTE[_LOWER[data] if lower else data]
    values *= up[: len(data)]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    hashes = mix(mix((sums[end] - sums[start]) * down[start]) + (end - start).astype(np.uint64))
    return Words(np.searchsorted(start, offsets), hashes, start, end, data, sums)
