"""Joining predictions to labels that arrive late, and the reconciled table.

Duplicates are resolved by aggregation (``max_by`` / ``min_by``), not by a window: partial
aggregates run before the shuffle, so an id repeated very often costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import floor_days, guarded_ratio, micros, one_if
from .ranking import ranking_quality
from .scan import HOT_ROWS

MAX_AGE_DAYS = 120
POSITIVE_DECISIONS = ("block", "review")
_DAY_US = 86_400_000_000.0


def between_dates(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """[start, end) on a timestamp column; the filter reaches the Parquet scan."""
    out = df
    if start is not None:
        out = out.filter(F.col(column) >= F.lit(start))
    if end is not None:
        out = out.filter(F.col(column) < F.lit(end))
    return out


def join_labels(
    predictions: DataFrame, labels: DataFrame, max_label_delay_days: int = MAX_AGE_DAYS
) -> DataFrame:
    """Predictions left-joined to labels with whole-day delay and lateness; empty if either is.

    Several labels for one id give several rows. Large labels meet predictions in a sort-merge
    join, whose skewed partitions adaptive execution splits.
    """
    facts = labels.select("transaction_id", "is_fraud", "label_timestamp")
    left = predictions.drop("is_fraud", "label_timestamp")
    out = left.join(facts, "transaction_id", "left")
    if labels.isEmpty():
        out = out.limit(0)
    if "prediction_timestamp" not in predictions.columns:
        return out
    delay = floor_days(F.col("label_timestamp"), F.col("prediction_timestamp"))
    return out.withColumns(
        {
            "label_delay_days": delay,
            "has_label": F.col("is_fraud").isNotNull(),
            "label_too_late": F.coalesce(delay > max_label_delay_days, F.lit(False)),
        }
    )


def evaluation_window(
    predictions: DataFrame, labels: DataFrame, window_end: datetime, window_days: int = 30
) -> DataFrame:
    """Labelled predictions of the ``window_days`` before ``window_end``; all labels take part."""
    recent = between_dates(predictions, "prediction_timestamp", window_end - timedelta(days=window_days), window_end)
    return join_labels(recent, labels)


def label_coverage(joined: DataFrame, min_label_rate: float = 0.8) -> DataFrame:
    """One row: n, labelled share and whether it reaches the minimum."""
    return joined.agg(
        F.count(F.lit(1)).alias("n_predictions"), F.sum(one_if(F.col("has_label"))).alias("n_labelled"),
        F.avg(one_if(F.col("has_label")).cast("double")).alias("label_rate"),
    ).withColumn("enough_labels", F.coalesce(F.col("label_rate") >= min_label_rate, F.lit(False)))


def last_predictions(predictions: DataFrame, arrival: Sequence[str] = ("prediction_timestamp",)) -> DataFrame:
    """The prediction recorded last per transaction id."""
    return _one_per_id(predictions, arrival, F.max_by)


def first_labels(labels: DataFrame, arrival: Sequence[str] = ("label_timestamp",)) -> DataFrame:
    """The label recorded first per transaction id; later ones find nothing to match."""
    return _one_per_id(labels, arrival, F.min_by)


def _one_per_id(df: DataFrame, arrival: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c != "transaction_id"]
    # equal times fall by content, so there is one result
    order = F.struct(*[F.col(c) for c in arrival], F.xxhash64(F.to_json(F.struct(*sorted(rest)))))
    return df.groupBy("transaction_id").agg(pick(F.struct(*rest), order).alias("_r")).select("transaction_id", "_r.*")


def reconcile(
    predictions: DataFrame,
    labels: DataFrame,
    *,
    positive: Sequence[str] = POSITIVE_DECISIONS,
    prediction_order: Sequence[str] = ("prediction_timestamp",),
    label_order: Sequence[str] = ("label_timestamp",),
    max_delay_days: int | None = None,
) -> DataFrame:
    """One row per transaction with both a prediction and a label."""
    left = last_predictions(
        predictions.select(
            "transaction_id", "fraud_probability", "decision", "model_version", "prediction_timestamp", "amount",
            *[c for c in prediction_order if c != "prediction_timestamp"],
        ),
        prediction_order,
    )
    right = first_labels(
        labels.select(
            "transaction_id", "is_fraud", "label_timestamp", *[c for c in label_order if c != "label_timestamp"]
        ),
        label_order,
    )
    pairs = left.join(right, "transaction_id")
    if max_delay_days is not None:
        pairs = pairs.filter(micros("label_timestamp") - micros("prediction_timestamp") <= F.lit(int(max_delay_days * _DAY_US)))
    return reconciled_columns(pairs, positive)


def reconciled_columns(pairs: DataFrame, positive: Sequence[str] = POSITIVE_DECISIONS) -> DataFrame:
    """The reconciled record of a (prediction, label) pair; shared by batch and stream."""
    actual = F.col("is_fraud").cast("int") == 1
    return pairs.select(
        "transaction_id",
        "fraud_probability",
        F.col("decision").isin(*positive).alias("predicted_fraud"),
        actual.alias("actual_fraud"),
        ((F.col("decision") == "block") == actual).alias("correct"),
        "model_version",
        "prediction_timestamp",
        "label_timestamp",
        ((micros("label_timestamp") - micros("prediction_timestamp")) / F.lit(_DAY_US)).alias("label_delay_days"),
        "amount",
    )


def expire_pending(predictions: DataFrame, as_of: datetime, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """Drop predictions that are too old at ``as_of`` to be labelled any more."""
    return predictions.filter(F.col("prediction_timestamp") >= F.lit(as_of - timedelta(days=max_age_days)))


def pending(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions (last per id) without a label."""
    return last_predictions(predictions).join(labels.select("transaction_id"), "transaction_id", "left_anti")


def unmatched_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels whose transaction was never predicted."""
    return labels.join(predictions.select("transaction_id"), "transaction_id", "left_anti")


def reconcile_stats(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: pending, reconciled, labels received and matched, match rate.

    Both sides are counted per id first, so one full join of unique ids answers everything.
    """
    p = predictions.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("_p"))
    q = labels.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("_l"))
    both = p.join(q, "transaction_id", "full")
    matched = F.col("_p").isNotNull() & F.col("_l").isNotNull()
    sums = both.agg(
        F.sum(one_if(F.col("_l").isNull())).alias("pending_predictions"),
        F.sum(one_if(matched)).alias("reconciled_records"),
        F.coalesce(F.sum("_l"), F.lit(0)).alias("labels_received"),
        F.sum(one_if(matched)).alias("labels_matched"),
    )
    return sums.withColumn("match_rate", guarded_ratio(F.col("labels_matched"), F.col("labels_received")))


def _outcomes() -> dict[str, Column]:
    """What each reconciled row adds to the sums."""
    actual, flagged, money = F.col("actual_fraud"), F.col("predicted_fraud"), F.col("amount")

    def worth(cond: Column) -> Column:
        return F.when(cond, money).otherwise(F.lit(0.0))

    return {
        "n_samples": F.lit(1), "_actual": one_if(actual), "_flagged": one_if(flagged),
        "true_positives": one_if(actual & flagged), "false_positives": one_if(~actual & flagged),
        "false_negatives": one_if(actual & ~flagged), "true_negatives": one_if(~actual & ~flagged),
        "total_fraud_amount": worth(actual), "caught_fraud_amount": worth(actual & flagged), "false_positive_amount": worth(~actual & flagged),
        "_delay": F.col("label_delay_days"), "_delays": one_if(F.col("label_delay_days").isNotNull()),
    }


def performance(
    reconciled: DataFrame,
    groups: Sequence[str] = (),
    *,
    model_version: str | None = None,
    min_date: datetime | None = None,
    max_date: datetime | None = None,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """True performance of reconciled rows, overall or per group; both dates are included."""
    rows = reconciled
    if model_version is not None:
        rows = rows.filter(F.col("model_version") == model_version)
    if min_date is not None:
        rows = rows.filter(F.col("prediction_timestamp") >= F.lit(min_date))
    if max_date is not None:
        rows = rows.filter(F.col("prediction_timestamp") <= F.lit(max_date))
    keys = list(groups) or ["_all"]
    rows = rows if groups else rows.withColumn("_all", F.lit(0))
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    n = F.col("n_samples").cast("double")
    scored = rows.withColumn("_y", one_if(F.col("actual_fraud")))
    # one pass: sums and ranking measures come from the same ladder of scores
    sums = ranking_quality(scored, keys, "fraud_probability", "_y", min_rows, _outcomes())
    return sums.withColumns(
        {
            "actual_fraud_rate": F.col("_actual") / n, "predicted_fraud_rate": F.col("_flagged") / n,
            "avg_label_delay_days": F.try_divide(F.col("_delay"), F.col("_delays").cast("double")),
            "precision": guarded_ratio(tp, tp + fp),
            "recall": guarded_ratio(tp, tp + fn),
            "f1": guarded_ratio(2 * tp, 2 * tp + fp + fn),
            "fraud_catch_rate_dollars": guarded_ratio(F.col("caught_fraud_amount"), F.col("total_fraud_amount")),
        }
    ).drop("_all", "_actual", "_flagged", "_delay", "_delays")


def performance_by_version(reconciled: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    return performance(reconciled, ["model_version"], min_rows=min_rows)


def rolling_quality(reconciled: DataFrame, window_days: int = 7) -> DataFrame:
    """Per day d of the prediction range the quality of predictions in [d, d + window_days).

    Rows are reduced to one per day before each day is counted in the windows it belongs to.
    """
    actual, flagged = F.col("actual_fraud"), F.col("predicted_fraud")
    daily = reconciled.groupBy(F.to_date("prediction_timestamp").alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(one_if(actual)).alias("_y"), F.sum(one_if(flagged)).alias("_f"),
        F.sum(one_if(actual & flagged)).alias("_t"),
    )
    # one row per calendar day from here on
    first = F.min("_day").over(Window.partitionBy(F.lit(0)))
    ranged = daily.select("*", first.alias("_first"))
    spread = ranged.select(
        "_n", "_y", "_f", "_t", "_first", F.explode(F.sequence(F.date_sub("_day", window_days - 1), F.col("_day"))).alias("date")
    ).filter(F.col("date") >= F.col("_first"))
    sums = spread.groupBy("date").agg(*[F.sum(c).alias(c) for c in ("_n", "_y", "_f", "_t")])
    one = F.lit(1)
    return sums.select(
        "date",
        F.col("_n").alias("n_samples"),
        (F.col("_y") / F.col("_n")).alias("fraud_rate"),
        (F.col("_t") / F.greatest(one, F.col("_f"))).alias("precision"),
        (F.col("_t") / F.greatest(one, F.col("_y"))).alias("recall"),
    )
