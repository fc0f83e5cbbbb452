"""Importance resampling towards a target corpus.

A pre-tokeniser that needs no training, a regular-expression split over the text with A-Z lower-cased, gives words
with their offsets. Windows of one to ``most`` consecutive offset pairs are the features; each falls into the bucket
of its CRC-32. Histograms of all documents and of all target texts give a bucket's gain, the logarithm of its
smoothed frequencies' ratio in thousandths; a document weighs the sum of its features' gains. Its score adds a Gumbel
variate that depends on its id alone, so the highest scores are a draw without replacement by weight, the same
however often a task runs.

Bucket numbers of a document are stored once, packed, and read again with the gains; what reaches the driver is one
count per bucket. Ranks come from one range-partitioned sort of narrow rows: no group of equal scores meets in a task.

A null or empty text has no features and weighs 0; a null id draws as the empty string and sorts last; repeated rows
are documents of their own (equal in all, they take the ranks between them in any order); a very long text is one
value of one task and its packed buckets are two bytes a word; an empty table gives an empty table, an empty target
only smoothed gains; only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import math
from binascii import crc32
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import PreTokenizer, Split

from riskweave.llm import words
from riskweave.llm.ship import shipped
from riskweave.session import cut_lineage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Different features whose buckets a worker remembers; beyond, it starts anew.
REMEMBERED = 100_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Featuriser:
    """Buckets of the features of texts."""

    def __init__(self, most: int, buckets: int):
        self.most, self.buckets = most, buckets
        self.kind = np.uint16 if buckets <= 1 << 16 else np.uint32
        self.split: PreTokenizer = Split(Regex(WORD), "removed", invert=True)
        self._known: dict[str, int] = {}

    def _bucket(self, feature: str) -> int:
        found = self._known.get(feature)
        if found is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            found = crc32(feature.encode("utf-8")) % self.buckets
            if len(feature) <= 64:
                self._known[feature] = found
        return found

    def features(self, text: str) -> tuple[int, list[str]]:
        """Words of a text and its features: windows of offset pairs, words joined by one space."""
        lower = text.encode("utf-8").translate(_LOWER).decode("utf-8")
        pairs = self.split.pre_tokenize_str(lower)
        found = [word for word, _ in pairs]
        for size in range(2, self.most + 1):
            for (_, (start, _)), (_, (_, end)), i in zip(pairs, pairs[size - 1 :], range(len(pairs))):
                whole = lower[start:end]
                # neighbours one space apart stand in the text as the feature does
                one_apart = all(pairs[j][1][1] + 1 == pairs[j + 1][1][0] and lower[pairs[j][1][1]] == " " for j in range(i, i + size - 1))
                found.append(whole if one_apart else " ".join(word for word, _ in pairs[i : i + size]))
        return len(pairs), found

    def buckets_of(self, text: str | None) -> tuple[int, np.ndarray]:
        n, found = self.features(text) if text else (0, [])
        return n, np.fromiter(map(self._bucket, found), dtype=self.kind, count=len(found))


def bucket_features(texts: DataFrame, most: int, buckets: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, packed): the bucket of every feature of every whole text, packed as small integers."""
    rows = texts.select(texts[doc_id].alias("doc_id"), texts[text].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featuriser = Featuriser(most, buckets)
        for batch in batches:
            for part in words.slices(batch, 1):
                found = [featuriser.buckets_of(t) for t in part.column(1).to_pylist()]
                counts = pa.array(np.array([n for n, _ in found], dtype=np.int64))
                packed = pa.array([b.tobytes() for _, b in found], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, packed], ["doc_id", "n_words", "packed"])

    return shipped(rows).mapInArrow(run, f"doc_id {kind}, n_words long, packed binary")


def _unpacked(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All bucket numbers of a batch, and where each document's begin."""
    kind = np.dtype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    values = column.to_pylist()
    first = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum([len(v) // kind.itemsize for v in values], out=first[1:])
    return np.frombuffer(b"".join(values), dtype=kind), first


def histogram(bucketed: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket; every task sends one count per bucket it met, which are added before the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(_unpacked(batch.column(0), buckets)[0], minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["bucket", "n"])

    parts = bucketed.select("packed").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # as many rows as buckets at most
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths."""
    buckets = len(source)
    all_source, all_target = int(source.sum()) + buckets, int(target.sum()) + buckets
    ratio = ((t + 1) * all_source / ((s + 1) * all_target) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weigh(bucketed: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of a document's features."""
    kind = bucketed.schema["doc_id"].dataType.simpleString()
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, first = _unpacked(batch.column(2), buckets)
            sums = np.zeros(len(found) + 1, dtype=np.int64)
            np.cumsum(gain[found], out=sums[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]])],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return bucketed.select("doc_id", "n_words", "packed").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate fixed by the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))).cast("long")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``rank``, 1 upwards in the given order.

    A range-partitioned sort numbers the rows of each partition; only one count per partition meets in one place.
    Fully equal rows are told apart by their place in the stored input, so that they can be cut too.
    """
    stored = cut_lineage(rows).withColumn("_place", F.monotonically_increasing_id())
    at = cut_lineage(stored.orderBy(*order, "_place").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the sort
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = at.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return joined.withColumn("rank", rank).drop("_part", "_before", "_at", "_place")


def resample(
    docs: DataFrame, target: DataFrame, *, most: int = 1, buckets: int = BUCKETS, seed: int = SEED,
    least_words: int = LEAST_WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document; the undrawn have no rank.

    Of the documents with ``least_words`` words, ``percent`` of a hundred are drawn, highest scores first, ties to
    the smaller id.
    """
    if not 0 <= percent <= 100 or buckets < 1 or most < 1:
        raise ValueError("percent lies in 0 to 100; buckets and most are at least 1")
    bucketed = cut_lineage(bucket_features(docs, most, buckets, doc_id=doc_id, text=text))
    aim = target.select(F.lit(0).alias("doc_id"), target[target_text].alias("text"))
    gain = gains(histogram(bucketed, buckets), histogram(bucket_features(aim, most, buckets), buckets))
    scored = cut_lineage(weigh(bucketed, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    able = F.col("n_words") >= least_words
    drawn = scored.filter(able).count() * percent // 100
    listed = ranked(scored.filter(able), F.desc("score"), F.asc_nulls_last("doc_id"))
    listed = listed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return listed.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
