"""User statistics that merge: a state per task, states merged in a tree.

A statistic is four functions. ``start()`` gives an empty state, ``step(state, batch)`` adds an Arrow batch of its
columns, ``merge(a, b)`` joins two states, ``finish(state)`` gives the number (or None). States are pickled between
tasks and should stay small whatever the number of rows: one is sent per task, ``FAN`` groups merge them, and one
merges theirs.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of tasks whose states are merged first.
FAN = 64


@dataclass(frozen=True)
class MergedStatistic:
    """A number made of some columns, which should lie between two bounds, either of which may be open."""

    name: str
    columns: Sequence[str]
    start: Callable[[], object]
    step: Callable[[object, pa.RecordBatch], object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], float | None]
    low: float | None = None
    high: float | None = None
    severity: str = "warning"

    def passed(self, value: Column) -> Column:
        """A number there is none of, or that is not a number, is outside."""
        inside = value.isNotNull() & ~F.isnan(value)
        if self.low is not None:
            inside = inside & (value >= self.low)
        if self.high is not None:
            inside = inside & (value <= self.high)
        return F.coalesce(inside, F.lit(False))


def merged_value(df: DataFrame, statistic: MergedStatistic) -> DataFrame:
    """One row ``value``: the statistic over all rows; of an empty table that of the empty state."""
    start, step, merge, finish = statistic.start, statistic.step, statistic.merge, statistic.finish

    # functions of this scope, so that workers get them by value
    def each_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            state = step(state, batch)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    def joined(table: pa.Table) -> object:
        states = [pickle.loads(x) for x in table.column("state").to_pylist()]
        out = states[0]
        for state in states[1:]:
            out = merge(out, state)
        return out

    def some(table: pa.Table) -> pa.Table:
        return pa.table({"state": pa.array([pickle.dumps(joined(table))], pa.binary())})

    def last(table: pa.Table) -> pa.Table:
        return pa.table({"value": pa.array([finish(joined(table))], pa.float64())})

    states = df.select(*statistic.columns).mapInArrow(each_task, "state binary")
    fewer = states.groupBy((F.spark_partition_id() % FAN).alias("_g")).applyInArrow(some, "state binary")
    value = fewer.groupBy(F.lit(0).alias("_g")).applyInArrow(last, "value double")
    empty = finish(start())
    return value.agg(F.coalesce(F.max("value"), F.lit(empty).cast("double")).alias("value"))


def correlation(a: str, b: str, **bounds) -> MergedStatistic:
    """Pearson correlation of two numeric columns over rows that have both; None without spread."""

    def step(state, batch):
        import numpy

        x, y = (numpy.asarray(batch.column(i).cast("float64").to_numpy(zero_copy_only=False)) for i in (0, 1))
        keep = numpy.isfinite(x) & numpy.isfinite(y)
        x, y = x[keep], y[keep]
        if not len(x):
            return state
        mx, my = x.mean(), y.mean()
        return merge(state, (len(x), mx, my, ((x - mx) ** 2).sum(), ((y - my) ** 2).sum(), ((x - mx) * (y - my)).sum()))

    def merge(p, q):
        n = p[0] + q[0]
        if not p[0] or not q[0]:
            return q if q[0] else p
        dx, dy, w = q[1] - p[1], q[2] - p[2], p[0] * q[0] / n
        return (n, p[1] + dx * q[0] / n, p[2] + dy * q[0] / n, p[3] + q[3] + dx * dx * w, p[4] + q[4] + dy * dy * w, p[5] + q[5] + dx * dy * w)

    def finish(state):
        return float(state[5] / (state[3] * state[4]) ** 0.5) if state[3] > 0 and state[4] > 0 else None

    return MergedStatistic(f"correlation with {b}", [a, b], lambda: (0, 0.0, 0.0, 0.0, 0.0, 0.0), step, merge, finish, **bounds)


def trimmed_mean(column: str, first: float, last: float, *, share: float = 0.05, bins: int = 1_000, **bounds) -> MergedStatistic:
    """Mean of a column without the lowest and highest ``share`` of its values.

    Values are counted and added up in ``bins`` equal classes of [first, last) and one beyond each end, so the state has
    a fixed size; of a class that is cut through, values count with the class's mean.
    """

    def step(state, batch):
        import numpy

        x = numpy.asarray(batch.column(0).cast("float64").to_numpy(zero_copy_only=False))
        x = x[numpy.isfinite(x)]
        at = numpy.clip(numpy.floor((x - first) * bins / (last - first)), -1, bins).astype(numpy.int64) + 1
        more = numpy.bincount(at, minlength=bins + 2), numpy.bincount(at, x, minlength=bins + 2)
        return more if state is None else merge(state, more)

    def merge(p, q):
        return (q if p is None else p) if p is None or q is None else (p[0] + q[0], p[1] + q[1])

    def finish(state):
        import numpy

        if state is None or not state[0].sum():
            return None
        counts, sums = state
        upto = numpy.cumsum(counts)
        cut = share * upto[-1]
        kept = numpy.minimum(upto, upto[-1] - cut) - numpy.maximum(upto - counts, cut)
        kept = numpy.maximum(kept, 0)
        return float((sums / numpy.maximum(counts, 1) * kept).sum() / kept.sum()) if kept.sum() > 0 else None

    return MergedStatistic("trimmed_mean", [column], lambda: None, step, merge, finish, **bounds)
