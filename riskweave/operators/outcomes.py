"""What becomes of every prediction and label, one to one and in event order.

The events of a transaction id, predictions and labels together, are put in order of time; at equal times
predictions come first. A label uses up the prediction right before it. A prediction followed by another one is
superseded; one whose label does not come within ``max_age_days`` is expired; a label without an open prediction
before it is unmatched. So every event has one outcome: predictions are matched, superseded, expired or pending,
labels matched or unmatched. An id with very many events is scanned in slices (``scan.running``).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import micros
from ..functions.columns import MICROS_PER_DAY
from .labels import MAX_AGE_DAYS
from .scan import HOT_ROWS, NO_HOT_GROUPS, has_hot_group, running

PREDICTION_FIELDS = ("fraud_probability", "decision", "model_version", "prediction_timestamp", "amount")
LABEL_FIELDS = ("is_fraud", "label_timestamp")
#: Prediction outcomes that end its wait, and the one that does not.
CLOSED, PENDING = ("matched", "superseded", "expired"), "pending"
_TYPES = {
    "fraud_probability": "double", "decision": "string", "model_version": "string", "prediction_timestamp": "timestamp",
    "amount": "double", "is_fraud": "int", "label_timestamp": "timestamp",
}


def event_log(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """(transaction_id, is_label, at, prediction and label fields): one row per event; ``at`` in microseconds.

    Rows without an id or a time have no place in any order and are left out.
    """

    def side(df: DataFrame, own: tuple[str, ...], time: str, is_label: bool) -> DataFrame:
        fields = [(F.col(c) if c in own else F.lit(None)).cast(t).alias(c) for c, t in _TYPES.items()]
        rows = df.filter(F.col("transaction_id").isNotNull() & F.col(time).isNotNull())
        return rows.select("transaction_id", F.lit(is_label).alias("is_label"), micros(time).alias("at"), *fields)

    p = side(predictions, PREDICTION_FIELDS, "prediction_timestamp", False)
    return p.unionByName(side(labels, LABEL_FIELDS, "label_timestamp", True))


def _outcome(status: str, prediction: Column | None, label: Column | None, carry: Sequence[str]) -> Column:
    """One result row; ``carry`` comes from the prediction."""

    def field(name: str, kind: str) -> Column:
        side = label if name in LABEL_FIELDS else prediction
        return F.lit(None).cast(kind) if side is None else side[name]

    kept = {**_TYPES, **dict.fromkeys(carry, "long")}
    return F.struct(F.lit(status).alias("status"), *[field(c, t).alias(c) for c, t in kept.items()])


def outcomes(
    log: DataFrame, as_of_us: Column, *, max_age_days: int = MAX_AGE_DAYS, min_rows: int = HOT_ROWS, carry: Sequence[str] = ()
) -> DataFrame:
    """(transaction_id, status, prediction fields, label fields) of an event log, as known at ``as_of_us``.

    A matched pair is one row, every other event one row of its own. ``carry`` names further bigint columns of
    predictions to keep.
    """
    keys = ["transaction_id"]
    if min_rows != NO_HOT_GROUPS and not has_hot_group(log, keys, min_rows):
        min_rows = NO_HOT_GROUPS
    age = F.lit(max_age_days * MICROS_PER_DAY)
    # equal times fall by content, so there is one result
    told = log.withColumn("_tie", F.xxhash64(*_TYPES))
    event = F.struct("at", "is_label", "_tie", *_TYPES, *carry)
    ordered = running(told, keys, "at", {"_before": ("max", event)}, ties=("is_label", "_tie"), min_rows=min_rows)
    # backwards: whether anything follows
    back = ordered.withColumns({"_l": ~F.col("is_label"), "_t": F.bitwise_not("_tie")})
    ordered = running(back, keys, "at", {"_after": ("max", F.lit(1))}, ties=("_l", "_t"), descending=True, min_rows=min_rows)
    before, now = F.col("_before"), F.struct(*_TYPES, *carry)
    waits = before.isNotNull() & ~before["is_label"]
    in_time = F.col("at") - before["at"] <= age

    def outcome(status: str, prediction: Column | None, label: Column | None) -> Column:
        return _outcome(status, prediction, label, carry)

    previous = F.when(
        waits,
        F.when(F.col("is_label") & in_time, outcome("matched", before, now))
        .when(in_time, outcome("superseded", before, None))
        .otherwise(outcome("expired", before, None)),
    )
    lonely = F.when(F.col("is_label") & ~F.coalesce(waits & in_time, F.lit(False)), outcome("unmatched", None, now))
    last = F.when(
        ~F.col("is_label") & F.col("_after").isNull(),
        F.when(as_of_us - F.col("at") > age, outcome("expired", now, None)).otherwise(outcome(PENDING, now, None)),
    )
    found = F.filter(F.array(previous, lonely, last), lambda x: x.isNotNull())
    return ordered.select("transaction_id", F.explode(found).alias("_o")).select("transaction_id", "_o.*")


def prediction_outcomes(
    predictions: DataFrame, labels: DataFrame, as_of: datetime, *, max_age_days: int = MAX_AGE_DAYS, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Outcomes of whole tables: events after ``as_of`` are left out."""
    now = micros(F.lit(as_of))
    return outcomes(event_log(predictions, labels).filter(F.col("at") <= now), now, max_age_days=max_age_days, min_rows=min_rows)
