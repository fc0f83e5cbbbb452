"""Serving-side velocity on a stream.

Each micro-batch is swept together with the last seven days of recorded events of the users
and devices in it, by the same operator as the batch form. The history is a table in the
shared folder, partitioned by batch and day: a batch that runs again replaces its own part, so
results are exactly-once, survive lost executors, and a hot user is scanned in slices instead
of sitting in one keyed state.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import HOT_ROWS
from ..operators.velocity import SERVING_WINDOWS, trailing

KEEP = timedelta(seconds=max(SERVING_WINDOWS.values()))
NEEDED = ["transaction_id", "timestamp", "user_id", "device_id", "merchant_id", "amount"]


def _history(spark: SparkSession, path: str, before_batch: int, since) -> DataFrame | None:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root) or not any("batch_id=" in s.getPath().getName() for s in fs.listStatus(root)):
        return None
    table = spark.read.parquet(path)
    return table.filter(
        (F.col("batch_id") < before_batch) & (F.col("day") >= F.lit(since.date())) & (F.col("timestamp") > F.lit(since))
    ).select(*NEEDED)


def batch_velocity(events: DataFrame, history: DataFrame | None, *, min_rows: int = HOT_ROWS) -> DataFrame:
    """Serving velocity of ``events``, which follow the recorded ``history``."""
    fresh = events.withColumn("_new", F.lit(True))

    def with_past(df: DataFrame, key: str) -> DataFrame:
        if history is None:
            return df
        keys = events.select(key).distinct()
        past = history.join(keys, key, "left_semi").withColumn("_new", F.lit(False))
        return df.unionByName(past, allowMissingColumns=True)

    users = with_past(fresh, "user_id")
    by_user = trailing(
        users, "user_id", SERVING_WINDOWS, sums={"user_txn_amount": F.col("amount")},
        distincts={"user_unique_merchants": "merchant_id"}, arrival=True, count_name="user_txn_count", min_rows=min_rows,
    ).filter("_new")
    probe = with_past(fresh, "device_id")
    by_device = trailing(
        with_past(by_user, "device_id"), "device_id", SERVING_WINDOWS, distincts={"device_unique_users": "user_id"},
        arrival=True, count_name="device_txn_count", min_rows=min_rows, probe=probe,
    )
    return by_device.filter("_new").drop("_new")


def velocity_stream(
    events: DataFrame, history_path: str, output_path: str, checkpoint: str, *,
    score: Callable[[DataFrame], DataFrame] | None = None, late_path: str | None = None,
    lateness: timedelta = KEEP, available_now: bool = True, min_rows: int = HOT_ROWS,
):
    """Start the loop: read velocity, score, emit, record. Returns the streaming query.

    ``score`` turns the batch with velocity columns into the output rows. Events older than the
    newest event seen so far minus ``lateness`` go to ``late_path`` instead (``{output_path}-late``
    unless named): every row in is a row out or a late row. Recorded days that no event in time can
    reach any more are removed from the history.
    """
    late_path = late_path or f"{output_path}-late"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            bounds = batch.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).first()
            if bounds["lo"] is None:
                return
            rows, late = batch, None
            newest = _newest(spark, history_path, batch_id)
            if newest is not None:
                is_late = F.col("timestamp") < F.lit(newest - lateness)
                rows, late = batch.filter(~is_late), batch.filter(is_late)
            past = _history(spark, history_path, batch_id, max(bounds["lo"], (newest or bounds["lo"]) - lateness) - KEEP)
            out = batch_velocity(rows, past, min_rows=min_rows)
            if score is not None:
                out = score(out)
            out.write.mode("overwrite").parquet(f"{output_path}/batch_id={batch_id}")
            if late is not None:
                late.write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
            recorded = rows.select(*NEEDED, F.to_date("timestamp").alias("day"))
            recorded.write.mode("overwrite").partitionBy("day").parquet(f"{history_path}/batch_id={batch_id}")
            top = max(t for t in (newest, bounds["hi"]) if t is not None)
            spark.createDataFrame([(top,)], "newest timestamp").write.mode("overwrite").parquet(f"{history_path}-newest/batch_id={batch_id}")
            _prune(spark, history_path, batch_id, (top - lateness - KEEP).date())
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _listed(spark: SparkSession, path: str):
    """(file system, folders) directly below a folder; none if it does not exist."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []


def _batches(paths) -> list:
    """(batch number, folder), newest first."""
    named = [(int(p.getName().split("=")[1]), p) for p in paths if p.getName().startswith("batch_id=")]
    return sorted(named, key=lambda x: -x[0])


def _newest(spark: SparkSession, path: str, before_batch: int):
    """The newest recorded event time: one row that each batch leaves."""
    _, paths = _listed(spark, f"{path}-newest")
    for number, folder in _batches(paths):
        if number < before_batch:
            return spark.read.parquet(folder.toString()).first()[0]
    return None


def _prune(spark: SparkSession, path: str, batch_id: int, first_day) -> None:
    """Remove recorded days before ``first_day``, and marks of batches before the last one."""
    fs, paths = _listed(spark, path)
    for _, folder in _batches(paths):
        days = [s.getPath() for s in fs.listStatus(folder)]
        dated = [d for d in days if d.getName().startswith("day=") and d.getName()[4:] < first_day.isoformat()]
        for d in dated:
            fs.delete(d, True)
        if dated and len(dated) == sum(d.getName().startswith("day=") for d in days):
            fs.delete(folder, True)
    _, marks = _listed(spark, f"{path}-newest")
    for number, folder in _batches(marks):
        if number < batch_id - 1:
            fs.delete(folder, True)
