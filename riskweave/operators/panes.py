"""Velocity from panes: activity is added up once per entity and hour, and windows are put together from those rows.

A pane holds count, amount and an HLL sketch of each distinct-counted column. For a window of W panes time is cut
into blocks of W panes: a window is the end of one block and the beginning of the next, so two running unions per
pane give every window, whatever its length, and raw events are read once. A group of the running unions holds one
block of one entity, at most 2 W rows however busy the entity is. Counts and amounts are exact, distinct counts
estimated (exactly right while they are small); ``velocity.velocity_grid`` is the exact, per-event form.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import micros
from ..functions.columns import MICROS_PER_SECOND

HOUR = 3600
#: Base-two logarithm of the sketches' size: 4,096 bytes at most.
SKETCH_BITS = 12
_EXACT = "decimal(38,6)"


def distinct_error(bits: int = SKETCH_BITS) -> float:
    """Relative standard error of a distinct count that is not small."""
    return 1.04 / 2 ** (bits / 2)


def activity_panes(
    df: DataFrame, entity: str = "user_id", *, distincts: Mapping[str, str] | None = None, amount: str | None = "amount",
    ts: str = "timestamp", seconds: int = HOUR, bits: int = SKETCH_BITS,
) -> DataFrame:
    """(entity, pane, n, amount, a sketch per entry of ``distincts``): what an entity did in each pane it was seen in.

    ``pane`` numbers the panes since the epoch. Rows without entity or time are left out; panes of new events can be
    added to stored ones by ``add_panes``.
    """
    pane = F.floor(micros(ts) / F.lit(float(seconds * MICROS_PER_SECOND))).cast("long")
    rows = df.withColumn("pane", pane).filter(F.col(entity).isNotNull() & F.col("pane").isNotNull())
    sums = [F.coalesce(F.sum(F.col(amount).cast(_EXACT)), F.lit(0).cast(_EXACT)).cast(_EXACT).alias("amount")] if amount else []
    counted = [F.hll_sketch_agg(F.col(c), F.lit(bits)).alias(n) for n, c in (distincts or {}).items()]
    return rows.groupBy(entity, "pane").agg(F.count(F.lit(1)).alias("n"), *sums, *counted)


def _union(df: DataFrame, keys: list[str], sketches: list[str]) -> DataFrame:
    sums = [F.sum(c).cast(t).alias(c) for c, t in (("n", "long"), ("amount", _EXACT)) if c in df.columns]
    return df.groupBy(*keys).agg(*sums, *[F.hll_union_agg(c).alias(c) for c in sketches])


def _sketches(panes: DataFrame) -> list[str]:
    return [f.name for f in panes.schema if f.dataType.simpleString() == "binary"]


def add_panes(stored: DataFrame, fresh: DataFrame, entity: str = "user_id") -> DataFrame:
    """Stored panes and those of events not counted yet, as one table."""
    return _union(stored.unionByName(fresh), [entity, "pane"], _sketches(stored))


def pane_windows(panes: DataFrame, length: int, entity: str = "user_id") -> DataFrame:
    """(entity, pane, n, amount, an estimate per sketch): the ``length`` panes that end with each pane, itself included."""
    if length < 1:
        raise ValueError("a window holds one pane at least")
    sketches = _sketches(panes)
    values = [c for c in ("n", "amount") if c in panes.columns]
    block = lambda at: F.floor(at / F.lit(length)).cast("long")

    def running(df: DataFrame, ascending: bool) -> DataFrame:
        order = F.col("_at").asc() if ascending else F.col("_at").desc()
        # equal places (a pane and a question at it) come together
        w = Window.partitionBy(entity, "_block").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        sums = [F.sum(c).over(w).alias(c) for c in values]
        return df.select(entity, "pane", "_asked", *sums, *[F.hll_union_agg(c).over(w).alias(c) for c in sketches])

    own = panes.withColumns({"_at": F.col("pane"), "_block": block(F.col("pane"))})
    beginning = running(own.withColumn("_asked", F.lit(True)), True)
    # where a window begins inside the block before, a question row there collects the rest of that block
    start = F.col("pane") - F.lit(length - 1)
    asked = panes.select(
        entity, "pane", start.alias("_at"), block(start).alias("_block"), F.lit(True).alias("_asked"),
        *[F.lit(None).cast(panes.schema[c].dataType).alias(c) for c in (*values, *sketches)],
    ).filter(F.col("_block") < block(F.col("pane")))
    rest = running(asked.unionByName(own.withColumn("_asked", F.lit(False)).select(asked.columns)), False)
    whole = _union(beginning.filter("_asked").unionByName(rest.filter("_asked")).drop("_asked"), [entity, "pane"], sketches)
    return whole.withColumns({c: F.coalesce(F.hll_sketch_estimate(c), F.lit(0)) for c in sketches})
