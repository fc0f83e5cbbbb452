"""Product codes of vectors, with nearest entries from memoised grid cells.

A vector of integers is cut into equal parts; each part is coded by the nearest entry of its position's codebook,
which a fixed number of rounds of assignment and averaging has fitted. To find the nearest entry, a part's coarse
grid cell is hashed. For a cell seen for the first time the entries are compared by their least and greatest distance
to the cell's box: an entry whose least distance exceeds another one's greatest is nowhere nearest in that box. The
entries left are cached, and only those are evaluated exactly. The cell width changes the work, never a code; unless
given, a worker takes the one that needs fewest evaluations on the first vectors it sees.

Rounds read the vectors where they lie; a task sends one sum and count per entry and component, so what meets in one
place, and on the driver, is as large as the codebooks. Errors of equal labels are added with a combine before the
shuffle and return to the rows by a broadcast where their count allows, else by a join on label and salt.

Rows whose vector is null or holds null or non-finite components are dropped; so are vectors of another than the most
frequent length (of equally frequent ones the longest), as they cannot be cut alike. A length that is no multiple of
the parts is filled up with zeros, which changes no distance. Integers stop at a bound that keeps every error within a
long (``largest``; for 64 components 134,217,727, a component of 32,767). Repeated rows are rows of their own; the first
entries come from the smallest ids (null last, equal ids by their components), fewer rows make fewer entries; an empty
table gives an empty table; only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.ship import shipped
from riskweave.session import cut_lineage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors worked on at a time; bytes of cached cells a position may hold before it starts anew.
BLOCK, CACHE_BYTES = 4_096, 8_000_000
#: Parts on which a worker chooses the cell width.
TRIED = 512
#: Label sums that may be broadcast (16 bytes each); more are joined with this many salts.
BROADCAST_LABELS, SALTS = 500_000, 32


def largest(size: int) -> int:
    """Greatest magnitude of an integer component such that a vector's error fits a long."""
    return math.isqrt((1 << 62) // max(size, 1)) // 2 - 1


class GridCells:
    """Nearest entries of one position, by memoised coarse cells."""

    def __init__(self, entries: np.ndarray, width: int | None = None):
        self.entries = entries.astype(np.int64)
        k, self.size = self.entries.shape
        self.width = width or 0
        self.most_cells = max(1, CACHE_BYTES // (k + 8 * self.size + 64))
        self._rows: dict[bytes, int] = {}
        self._masks = np.zeros((0, k), dtype=bool)

    def _choose_width(self, x: np.ndarray) -> int:
        """Of some fractions of the entries' spread the width with fewest evaluations on some parts; a box that is new
        costs two distances per entry, a part one per candidate."""
        spread = int((self.entries.max(axis=0) - self.entries.min(axis=0)).max()) if self.size else 0
        costs = {}
        for fraction in (1, 2, 4, 8, 16):
            self.width = max(1, spread // fraction)
            cells, times = np.unique(x // self.width, axis=0, return_counts=True) if self.size else (x[:1], np.array([len(x)]))
            costs[self.width] = 2 * len(self.entries) * len(cells) + int((self.candidates(cells).sum(axis=1) * times).sum())
        return min(costs, key=lambda w: (costs[w], w))

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """Entries not dominated across the box of each cell, as flags."""
        low = (cells * self.width)[:, None, :]
        high = low + (self.width - 1)
        below, above = low - self.entries, self.entries - high  # positive where the entry lies outside
        near = np.maximum(np.maximum(below, above), 0)
        far = np.maximum(np.abs(self.entries - low), np.abs(self.entries - high))
        least, greatest = (near * near).sum(axis=2), (far * far).sum(axis=2)
        return least <= greatest.min(axis=1, keepdims=True)

    def _masks_of(self, cells: np.ndarray) -> np.ndarray:
        """Flags of distinct cells, from the cache or worked out now."""
        if len(self._rows) + len(cells) > self.most_cells:
            self._rows.clear()
            self._masks = self._masks[:0]
        keys = [c.tobytes() for c in cells]
        fresh = [i for i, key in enumerate(keys) if key not in self._rows]
        if fresh:
            start = len(self._masks)
            self._masks = np.concatenate([self._masks, self.candidates(cells[fresh])])
            self._rows.update((keys[i], start + j) for j, i in enumerate(fresh))
        return self._masks[[self._rows[key] for key in keys]]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part (ties: the lowest), and its squared distance."""
        if not len(x):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if not self.width:
            self.width = self._choose_width(x[:TRIED])
        cells = x // self.width
        order = np.lexsort(cells.T) if self.size else np.arange(len(x))
        ordered = cells[order]
        opens = np.ones(len(x), dtype=bool)
        opens[1:] = np.any(ordered[1:] != ordered[:-1], axis=1)
        masks = self._masks_of(np.ascontiguousarray(ordered[opens]))
        mask = np.empty((len(x), len(self.entries)), dtype=bool)
        mask[order] = masks[np.cumsum(opens) - 1]
        row, entry = np.nonzero(mask)
        gap = x[row] - self.entries[entry]
        distance = np.full(mask.shape, np.iinfo(np.int64).max)
        distance[row, entry] = np.einsum("ij,ij->i", gap, gap)
        best = distance.argmin(axis=1)  # the first of equal ones
        return best, distance[np.arange(len(x)), best]


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, entry and component."""

    entries: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _integers(column: pa.Array, length: int, size: int, scale: int) -> np.ndarray:
    """Vectors as rows of scaled integers, filled up to ``size`` components."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), length)
    bound = largest(size)
    out = np.zeros((len(column), size), dtype=np.int64)
    out[:, :length] = np.clip(np.floor(flat * scale), -bound, bound).astype(np.int64)
    return out


class _Coder:
    """Codes blocks of vectors by the grid cells of every position."""

    def __init__(self, books: np.ndarray, width: int | None):
        self.parts, _, self.part_size = books.shape
        self.cells = [GridCells(book, width) for book in books]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [g.nearest(x[:, p * self.part_size : (p + 1) * self.part_size]) for p, g in enumerate(self.cells)]
        return np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


@dataclass(frozen=True)
class Cut:
    """How vectors become parts."""

    length: int
    parts: int = PARTS
    scale: int = SCALE

    @property
    def size(self) -> int:
        return -(-self.length // self.parts) * self.parts


def whole_vectors(rows: DataFrame, row_id: str, vector: str, label: str) -> tuple[DataFrame, int]:
    """(vec_id, v, label) of the rows that take part, and the vectors' length."""
    used = rows.select(rows[row_id].alias("vec_id"), rows[vector].cast("array<double>").alias("v"), rows[label].alias("label"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    used = used.filter(F.col("v").isNotNull() & ~F.exists("v", bad))
    sizes = used.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    length = sizes[0]["n"] if sizes else 0
    return used.filter(F.size("v") == length), length


def first_entries(used: DataFrame, cut: Cut, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the vectors with the smallest ids."""
    rows = used.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    lists = pa.array([r["v"] for r in rows], pa.list_(pa.float64()))
    x = _integers(lists, cut.length, cut.size, cut.scale)
    return x.reshape(len(x), cut.parts, cut.size // cut.parts).transpose(1, 0, 2).copy()


def next_entries(used: DataFrame, cut: Cut, books: np.ndarray, width: int | None = None) -> np.ndarray:
    """One round: every entry becomes the componentwise floor of its parts' mean; unused entries stay."""
    parts, k, part_size = books.shape
    spot = np.arange(parts) * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(books, width)
        counts = np.zeros(parts * k, dtype=np.int64)
        sums = np.zeros((parts * k, part_size), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _integers(batch.column(0).slice(at, BLOCK), cut.length, cut.size, cut.scale)
                where = (coder.codes(x)[0] + spot).ravel()
                counts += np.bincount(where, minlength=parts * k)
                for i, component in enumerate(x.reshape(-1, part_size).T):  # below 2**53 in a block, so doubles are exact
                    sums[:, i] += np.bincount(where, component, parts * k).astype(np.int64)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met]), pa.array(sums[met].tolist(), pa.list_(pa.int64()))], ["spot", "n", "total"])

    sent = shipped(used.select("v")).mapInArrow(run, "spot long, n long, total array<long>")
    exact = "decimal(38,0)"
    counts = sent.groupBy("spot").agg(F.sum(F.col("n").cast(exact)).alias("n"))
    totals = sent.select("spot", F.posexplode("total").alias("at", "x")).groupBy("spot", "at").agg(F.sum(F.col("x").cast(exact)).alias("x"))
    out = books.copy()
    for row in totals.join(counts, "spot").collect():  # one row per component of the codebooks
        part, entry = divmod(row["spot"], k)
        out[part, entry, row["at"]] = int(row["x"]) // int(row["n"])
    return out


def fit_codebooks(used: DataFrame, cut: Cut, *, entries: int = ENTRIES, rounds: int = ROUNDS, width: int | None = None) -> Codebooks:
    """Codebooks after all rounds over every vector."""
    books = first_entries(used, cut, entries)
    for _ in range(rounds if books.size else 0):
        books = next_entries(used, cut, books, width)
    return Codebooks(books)


def encode(used: DataFrame, cut: Cut, books: Codebooks, width: int | None = None) -> DataFrame:
    """(vec_id, label, codes, error) of every vector."""
    kinds = {f.name: f.dataType.simpleString() for f in used.schema}
    names = ["vec_id", "label", "codes", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _Coder(books.entries, width)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                codes, errors = coder.codes(_integers(part.column(2), cut.length, cut.size, cut.scale))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), cut.parts).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, pa.array(errors.sum(axis=1))], names)

    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<long>, error long"
    return shipped(used.select("vec_id", "label", "v")).mapInArrow(run, schema)


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` (a stored table) with ``label_error``, the sum of errors of its label; nulls are one label.

    A sum beyond a long is null.
    """
    total = F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS long)")
    sums = cut_lineage(coded.groupBy("label").agg(total.alias("label_error"))).withColumnRenamed("label", "_label")
    if sums.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(sums), coded["label"].eqNullSafe(sums["_label"]), "left").drop("_label")
    salted = sums.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "codes", "error"), F.lit(SALTS)).cast("int"))
    same = dealt["label"].eqNullSafe(salted["_label"]) & (dealt["_salt"] == salted["_salt_r"])
    return dealt.join(salted, same, "left").drop("_label", "_salt", "_salt_r")


def compress(
    rows: DataFrame, *, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, width: int | None = None,
) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, codes, error, label_error) of every vector, and the codebooks."""
    used, length = whole_vectors(rows, row_id, vector, label)
    cut = Cut(length, parts, scale)
    books = fit_codebooks(used, cut, entries=entries, rounds=rounds, width=width)
    return label_errors(cut_lineage(encode(used, cut, books, width))), books
