"""Lists of any size against tables of any size: a Bloom filter of the list first, then an exact join of likely hits.

The filter is one bit array, built by an aggregation over its 64-bit words and broadcast as a single row, so it is
tested where the table is scanned. Rows that fail are on no list and are not shuffled; rows that pass are joined with
the whole list, so a false positive costs a shuffled row and never a wrong flag. The filter's size is bounded: a list
too long for the bound gets a weaker filter, not another result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: Bits of a filter at most (eight megabytes), and the share of false positives aimed at below that.
MOST_BITS, FALSE_SHARE = 1 << 26, 0.01
#: Keys among which rows without a match are spread.
SALTS = 4_096


@dataclass(frozen=True)
class ListFilter:
    """A Bloom filter: one row with the array ``words`` of 64-bit words."""

    row: DataFrame
    bits: int
    hashes: int

    def maybe(self, words: Column, item: Column) -> Column:
        """Whether an item may be on the list; false for null."""
        out = item.isNotNull()
        for i in range(self.hashes):
            at = _position(item, i, self.bits)
            out = out & (F.get(words, F.shiftright(at, 6).cast("int")).bitwiseAND(_mask(at)) != 0)
        return F.coalesce(out, F.lit(False))


def _position(item: Column, turn: int, bits: int) -> Column:
    # as text, so that list and table may have other integer types
    return F.pmod(F.xxhash64(item.cast("string"), F.lit(turn)), F.lit(bits))


def _mask(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


def list_filter(listing: DataFrame, column: str | None = None, *, most_bits: int = MOST_BITS, false_share: float = FALSE_SHARE) -> ListFilter:
    """The filter of a list's (first) column. Repeated and null items do no harm.

    Words are aggregated map-side by ``bit_or``; the driver sees two numbers.
    """
    item = F.col(column or listing.columns[0])
    n = max(1, listing.agg(F.approx_count_distinct(item, 0.05)).first()[0])
    wanted = math.ceil(1.1 * -n * math.log(false_share) / math.log(2) ** 2)
    bits = min(most_bits, max(64, 64 * math.ceil(wanted / 64)))
    hashes = max(1, min(16, round(bits / n * math.log(2))))
    places = listing.filter(item.isNotNull()).select(F.explode(F.array(*[_position(item, i, bits) for i in range(hashes)])).alias("_at"))
    words = places.groupBy(F.shiftright("_at", 6).cast("int").alias("_word")).agg(F.bit_or(_mask(F.col("_at"))).alias("_bits"))
    # words without a bit are added as rows, so that the array can be looked up by place; most_bits / 64 entries at most
    blank = listing.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("_word"), F.lit(0).cast("long").alias("_bits"))
    every = words.unionByName(blank).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    ordered = F.array_sort(F.collect_list(F.struct("_word", "_bits")))
    row = every.agg(F.transform(ordered, lambda x: x["_bits"]).alias("words"))
    return ListFilter(cut_lineage(row), bits, hashes)


def flag_members(df: DataFrame, lists: Mapping[str, tuple[str, DataFrame]], **kw) -> DataFrame:
    """Add a boolean per entry ``name -> (column, listing)``: whether the value is in the listing's first column.

    Rows no filter lets through get their flags in the scan. The others, true hits and few false ones, are joined
    with each list by its distinct items. Null values are on no list; repeated rows stay rows of their own.
    """
    if not lists:
        return df
    plain = [c for c in df.columns if c not in lists]
    filters = {name: list_filter(listing, **kw) for name, (_, listing) in lists.items()}
    tested = df.select(*plain)
    for i, (name, (column, _)) in enumerate(lists.items()):
        # a single row
        words = F.broadcast(filters[name].row.withColumnRenamed("words", f"_w{i}"))
        tested = tested.join(words, F.lit(True), "cross").withColumn(f"_m{i}", filters[name].maybe(F.col(f"_w{i}"), F.col(column))).drop(f"_w{i}")
    likely = F.lit(False)
    for i in range(len(lists)):
        likely = likely | F.col(f"_m{i}")
    misses = tested.filter(~likely).select(*plain, *[F.lit(False).alias(n) for n in lists])
    hits = tested.filter(likely)
    simple = [f.name for f in df.schema if f.name in plain and isinstance(f.dataType, T.AtomicType)]
    spread = F.concat(F.lit("-"), F.pmod(F.xxhash64(*simple), F.lit(SALTS)).cast("string"))
    for i, (name, (column, listing)) in enumerate(lists.items()):
        items = listing.select(F.concat(F.lit("="), F.col(listing.columns[0]).cast("string")).alias("_item"))
        marks = items.filter("_item IS NOT NULL").distinct().withColumn(name, F.lit(True))
        # rows that only another list let through match nothing here, and are spread
        key = F.when(F.col(f"_m{i}"), F.concat(F.lit("="), F.col(column).cast("string"))).otherwise(spread)
        hits = hits.withColumn("_key", key).join(marks, F.col("_key") == F.col("_item"), "left").drop("_key", "_item")
        hits = hits.withColumn(name, F.coalesce(name, F.lit(False)))
    return misses.unionByName(hits.select(*plain, *lists))


def likely_hits(df: DataFrame, column: str, listing: DataFrame, **kw) -> DataFrame:
    """The rows a list's filter lets through: all on the list and few others."""
    found = list_filter(listing, **kw)
    return df.join(F.broadcast(found.row), F.lit(True), "cross").filter(found.maybe(F.col("words"), F.col(column))).drop("words")
