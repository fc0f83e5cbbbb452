"""Label reconciliation and dashboard windows on streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from ..functions import micros
from ..functions.columns import MICROS_PER_DAY
from ..operators.labels import MAX_AGE_DAYS
from ..operators.outcomes import LABEL_FIELDS, PENDING, PREDICTION_FIELDS, event_log, outcomes
from .velocity import _batches, _listed

#: Batches after which the open predictions are written as one table and the steps before it may go.
SNAPSHOT_EVERY = 16
_FIELDS = [*PREDICTION_FIELDS, *LABEL_FIELDS]


class _State:
    """Tables of a reconciliation, one folder per batch below each name.

    ``open``: predictions that a batch left pending, by day; every ``SNAPSHOT_EVERY`` batches all that are. ``closed``:
    which of them a batch ended. ``held``: events not yet final. ``mark``: the time up to which events are final.
    ``found``: all outcomes of a batch, from which the others are written.
    A batch reads folders of earlier batches only and replaces its own, so it may run again.
    """

    def __init__(self, spark: SparkSession, path: str, log: StructType):
        self.spark, self.path = spark, path
        opened = StructField("opened", LongType())
        self.schemas = {
            "open": StructType([*log, opened, StructField("day", DateType())]),
            "closed": StructType([log["transaction_id"], opened]), "held": log,
            "mark": StructType([StructField("final", LongType()), StructField("newest", LongType())]),
        }

    def _folders(self, name: str, low: int, high: int) -> list[str]:
        _, paths = _listed(self.spark, f"{self.path}/{name}")
        return [p.toString() for n, p in _batches(paths) if low <= n < high]

    def _read(self, name: str, folders: list[str]) -> DataFrame | None:
        reader = self.spark.read.schema(self.schemas[name]).option("basePath", f"{self.path}/{name}")
        return reader.parquet(*folders).drop("batch_id") if folders else None

    def snapshot(self, before: int) -> int:
        """The last batch before one that wrote all open predictions."""
        return max((before - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY, 0) if before else 0

    def open_rows(self, before: int) -> DataFrame | None:
        """Pending predictions as events, with ``opened``, the batch that left them so."""
        start = self.snapshot(before)
        rows = self._read("open", self._folders("open", start, before))
        closed = self._read("closed", self._folders("closed", start + 1, before))
        return rows if rows is None or closed is None else rows.join(closed, ["transaction_id", "opened"], "left_anti")

    def held(self, before: int) -> DataFrame | None:
        return self._read("held", self._folders("held", 0, before)[:1])  # newest first

    def mark(self, before: int) -> tuple[int, int] | None:
        """(time up to which events are final, newest event time)."""
        found = self._read("mark", self._folders("mark", 0, before)[:1])
        return None if found is None else tuple(found.first())

    def write(self, name: str, batch_id: int, rows: DataFrame, by: str | None = None) -> DataFrame:
        writer = rows.write.mode("overwrite")
        path = f"{self.path}/{name}/batch_id={batch_id}"
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def forget(self, batch_id: int) -> None:
        """Drop what no batch from this one on reads; the batches before it are committed."""
        start = self.snapshot(batch_id)
        for name, first in (("open", start), ("closed", start), ("held", batch_id - 1), ("mark", batch_id - 1), ("found", batch_id)):
            fs, paths = _listed(self.spark, f"{self.path}/{name}")
            for number, folder in _batches(paths):
                if number < first:
                    fs.delete(folder, True)

    def last_batch(self) -> int:
        _, paths = _listed(self.spark, f"{self.path}/mark")
        found = _batches(paths)
        return found[0][0] if found else -1


def _with_state(ready: DataFrame, state: DataFrame | None, final: int, max_age_days: int) -> DataFrame:
    """Final events together with the open predictions they or the time may close."""
    fresh = ready.withColumn("opened", F.lit(None).cast("long"))
    if state is None:
        return fresh
    oldest = F.lit(final - max_age_days * MICROS_PER_DAY)
    expiring = state.filter((F.col("day") <= F.to_date(F.timestamp_micros(oldest))) & (F.col("at") < oldest))
    touched = state.filter(~(F.col("at") < oldest)).join(ready.select("transaction_id").distinct(), "transaction_id", "left_semi")
    return fresh.unionByName(expiring.unionByName(touched).select(fresh.columns))


def reconcile_stream(
    predictions: DataFrame, labels: DataFrame, state_path: str, output_path: str, checkpoint: str, *,
    max_age_days: int = MAX_AGE_DAYS, delay: timedelta = timedelta(0), late_path: str | None = None, available_now: bool = True,
):
    """Outcomes of predictions and labels in event order, however the micro-batches are cut. Returns the query.

    Events count once no earlier one can come: when an event more than ``delay`` newer was seen. Rows of ``outcomes``
    go to ``output_path`` with their ``status``: matched, superseded, expired (``max_age_days`` passed without a label,
    in event time) and unmatched labels. Events older than what is final go to ``late_path`` (``{output_path}-late``
    unless named), rows without id or time to neither. ``open_outcomes`` gives what is still open, so at any time
    written and open rows together are all events, each once. A closed prediction leaves the state with the next
    snapshot; an id with many rows is scanned in slices and never held in one keyed state.
    """
    late_path = late_path or f"{output_path}-late"
    log = event_log(predictions, labels)
    wait = int(delay / timedelta(microseconds=1))

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = _State(spark, state_path, batch.schema)
        batch = batch.persist()
        try:
            state.forget(batch_id)
            marked = state.mark(batch_id)
            newest = batch.agg(F.max("at")).first()[0]
            if newest is None and marked is None:
                return
            newest = max(t for t in (newest, marked and marked[1]) if t is not None)
            final = max(newest - wait, marked[0]) if marked else newest - wait
            rows = batch
            if marked:
                batch.filter(F.col("at") < marked[0]).write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
                rows = batch.filter(F.col("at") >= marked[0])
            held = state.held(batch_id)
            rows = rows if held is None else rows.unionByName(held)
            opened = state.open_rows(batch_id)
            events = _with_state(rows.filter(F.col("at") < final), opened, final, max_age_days)
            found = state.write("found", batch_id, outcomes(events, F.lit(final), max_age_days=max_age_days, carry=("opened",)))
            done = found.filter(F.col("status") != PENDING)
            done.drop("opened").write.mode("overwrite").parquet(f"{output_path}/batch_id={batch_id}")
            state.write("closed", batch_id, done.filter("opened IS NOT NULL").select("transaction_id", "opened"))
            waiting = found.filter((F.col("status") == PENDING) & F.col("opened").isNull()).withColumn("opened", F.lit(batch_id).cast("long"))
            waiting = waiting.select(
                "transaction_id", F.lit(False).alias("is_label"), micros("prediction_timestamp").alias("at"), *_FIELDS, "opened",
                F.to_date("prediction_timestamp").alias("day"),
            )
            if batch_id and batch_id % SNAPSHOT_EVERY == 0 and opened is not None:
                gone = done.filter("opened IS NOT NULL").select("transaction_id", "opened")
                waiting = waiting.unionByName(opened.join(gone, ["transaction_id", "opened"], "left_anti").select(waiting.columns))
            state.write("open", batch_id, waiting, by="day")
            state.write("held", batch_id, rows.filter(F.col("at") >= final))
            state.write("mark", batch_id, spark.createDataFrame([(final, newest)], "final long, newest long"))
        finally:
            batch.unpersist()

    writer = log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def open_outcomes(spark: SparkSession, state_path: str, as_of: datetime | None = None, *, max_age_days: int = MAX_AGE_DAYS) -> DataFrame | None:
    """What a stopped stream has not written yet: outcomes of events that are not final and predictions still pending.

    Judged at ``as_of``, or at the newest event seen. None before the first batch.
    """
    _, kept = _listed(spark, f"{state_path}/held")
    if not _batches(kept):
        return None
    log = spark.read.parquet(_batches(kept)[0][1].toString()).schema
    state = _State(spark, state_path, log)
    after = state.last_batch() + 1
    marked = state.mark(after)
    opened, held = state.open_rows(after), state.held(after)
    events = held if opened is None else held.unionByName(opened.select(held.columns))
    now = F.lit(marked[1]) if as_of is None else micros(F.lit(as_of))
    return outcomes(events, now, max_age_days=max_age_days)


def on_each_batch(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Call ``callback(rows, batch_id)`` for every micro-batch: reconciled rows or triggers."""
    writer = stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_activity(
    events: DataFrame, keys=("merchant_category",), *, length: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour"
) -> DataFrame:
    """Sliding event-time counts and amounts; works on a batch as well."""
    return (
        events.withWatermark("timestamp", delay)
        .groupBy(F.window("timestamp", length, slide), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "amount")
    )
