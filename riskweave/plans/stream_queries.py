"""Streaming jobs run to completion over the event table; results equal the batch form."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.labels import between_dates
from ..operators.outcomes import LABEL_FIELDS, PREDICTION_FIELDS, prediction_outcomes
from ..session import prepare, shared_root
from ..streaming.labels import open_outcomes, reconcile_stream, windowed_activity
from ..streaming.velocity import velocity_stream
from . import label_queries
from . import velocity_queries as V
from .views import TXN_SQL, transactions


def _folder(spark, name):
    return f"{shared_root(prepare(spark))}/{name}-{uuid.uuid4().hex}"


#: Cut points of the reconciled stream: one part of predictions and of labels per micro-batch.
CUTS = tuple(datetime(2024, *day) for day in ((1, 8), (1, 20), (2, 10), (3, 20)))


#: Days a label may take here, so that predictions expire while the stream runs; what is known when, for the tables.
MAX_AGE, OUTCOMES_AT = 60, datetime(2024, 3, 31)


def _in_slices(tables: Sequence[tuple[DataFrame, str, str]], cuts: Sequence[datetime], start: Callable) -> None:
    """Run a stream over the rows of tables (rows, time column, folder), cut by time, one micro-batch per cut.

    Every slice is added to the folders by as many tasks and files as its rows have, then the stream goes on over what
    is new.
    """
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        for frame, time, folder in tables:
            between_dates(frame, time, low, high).write.mode("append").parquet(folder)
        start(*[frame.sparkSession.readStream.schema(frame.schema).parquet(folder) for frame, _, folder in tables]).awaitTermination()


#: Cut points of the velocity stream: windows of a week reach over several micro-batches.
EVENT_CUTS = tuple(datetime(2024, 1, day) for day in (5, 9, 14, 15, 24))


def stream_velocity(spark, sf_dir):
    """Serving velocity over six micro-batches in time order; history recorded and pruned on the way."""
    root = _folder(spark, "velocity")
    events = transactions(spark, sf_dir).select("transaction_id", "timestamp", "user_id", "amount", "merchant_id", "device_id")

    def start(stream: DataFrame):
        return velocity_stream(stream, f"{root}/history", f"{root}/out", f"{root}/checkpoint", lateness=timedelta(hours=1))

    _in_slices([(events, "timestamp", f"{root}/events")], EVENT_CUTS, start)
    return V.online_columns(spark.read.parquet(f"{root}/out"))


def stream_reconcile(spark, sf_dir):
    """Predictions and labels of which some come again, as streams of five micro-batches; every event with its outcome."""
    root = _folder(spark, "reconcile")
    p, q = label_queries._repeated(spark, sf_dir)
    p = p.select("transaction_id", *PREDICTION_FIELDS)
    q = q.select("transaction_id", *LABEL_FIELDS)

    def start(told: DataFrame, known: DataFrame):
        return reconcile_stream(told, known, f"{root}/state", f"{root}/out", f"{root}/checkpoint", max_age_days=MAX_AGE)

    _in_slices([(p, "prediction_timestamp", f"{root}/p"), (q, "label_timestamp", f"{root}/q")], CUTS, start)
    out = spark.read.parquet(f"{root}/out").drop("batch_id").unionByName(open_outcomes(spark, f"{root}/state", max_age_days=MAX_AGE))
    delay = (F.unix_micros("label_timestamp") - F.unix_micros("prediction_timestamp")) / F.lit(86_400_000_000.0)
    return out.select(
        "transaction_id", "status", "decision", "model_version", F.unix_micros("prediction_timestamp").alias("predicted_us"),
        "is_fraud", F.unix_micros("label_timestamp").alias("labelled_us"), F.round(delay, 5).alias("label_delay_days"),
    )


def outcomes(spark, sf_dir):
    """The same events as tables, at the end of March."""
    out = prediction_outcomes(*label_queries._repeated(spark, sf_dir), OUTCOMES_AT, max_age_days=MAX_AGE)
    return out.select(
        "transaction_id", "status", "decision", F.unix_micros("prediction_timestamp").alias("predicted_us"), F.unix_micros("label_timestamp").alias("labelled_us")
    )


OUTCOMES = """, told AS (
  SELECT transaction_id, false AS is_label, epoch_us(prediction_timestamp) AS at_us, decision, model_version, NULL::INT AS is_fraud FROM p2
  UNION ALL SELECT transaction_id, true, epoch_us(label_timestamp), NULL, NULL, is_fraud FROM l2
), told2 AS (
  SELECT *, lead(at_us) OVER w AS next_us, lead(is_label) OVER w AS next_label, lead(is_fraud) OVER w AS next_fraud,
    lag(at_us) OVER w AS last_us, lag(is_label) OVER w AS last_label, max(at_us) OVER () AS now_us
  FROM told WINDOW w AS (PARTITION BY transaction_id ORDER BY at_us, is_label, decision)
), outs AS (
  SELECT transaction_id, CASE
      WHEN coalesce(next_us, now_us) - at_us > {age} THEN 'expired'
      WHEN next_us IS NULL THEN 'pending' WHEN next_label THEN 'matched' ELSE 'superseded' END AS status,
    decision, model_version, at_us AS predicted_us, next_fraud, next_us FROM told2 WHERE NOT is_label
  UNION ALL SELECT transaction_id, 'unmatched', NULL, NULL, NULL, is_fraud, at_us FROM told2
  WHERE is_label AND NOT coalesce(NOT last_label AND at_us - last_us <= {age}, false)
)
SELECT transaction_id, status, decision, model_version, predicted_us,
  CASE WHEN status IN ('matched', 'unmatched') THEN next_fraud END AS is_fraud,
  CASE WHEN status IN ('matched', 'unmatched') THEN next_us END AS labelled_us,
  CASE WHEN status = 'matched' THEN round((next_us - predicted_us) / 86400000000.0::DOUBLE, 5) END AS label_delay_days FROM outs"""
OUTCOMES = OUTCOMES.replace("{age}", str(MAX_AGE * 86_400_000_000))
STREAM_RECONCILE = "WITH " + label_queries.REPEATED + OUTCOMES
PREDICTION_OUTCOMES = (
    "WITH " + label_queries.REPEATED + OUTCOMES.replace("told2 AS", "told1 AS (SELECT * FROM told WHERE at_us <= epoch_us(TIMESTAMP '2024-03-31')), told2 AS", 1)
    .replace("FROM told WINDOW", "FROM told1 WINDOW").replace("max(at_us) OVER ()", "epoch_us(TIMESTAMP '2024-03-31')")
)
PREDICTION_OUTCOMES = f"SELECT transaction_id, status, decision, predicted_us, labelled_us FROM ({PREDICTION_OUTCOMES})"


def windowed_counts(spark, sf_dir):
    """The dashboard window over the batch table."""
    out = windowed_activity(transactions(spark, sf_dir), length="24 hours", slide="6 hours")
    return out.select(F.unix_micros("window_start").alias("start_us"), "merchant_category", "n", F.round("amount", 3).alias("amount"))


WINDOWED_COUNTS = "WITH " + TXN_SQL + """ SELECT (us // 21600000000 - k) * 21600000000 AS start_us, merchant_category, count(*) AS n, round(sum(amount), 3) AS amount
FROM txn, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1, 2"""

QUERIES = {"stream_velocity": stream_velocity, "stream_reconcile": stream_reconcile, "prediction_outcomes": outcomes, "windowed_counts": windowed_counts}
ORACLE = {"stream_velocity": V.ONLINE_VELOCITY, "stream_reconcile": STREAM_RECONCILE, "prediction_outcomes": PREDICTION_OUTCOMES, "windowed_counts": WINDOWED_COUNTS}
