"""When to retrain: triggers from metrics, drift, fraud rate and schedule, and their log."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TRIGGER


#: Statuses of a retrain from its first to its last.
PROGRESS = ("pending", "in_progress", "failed", "completed")


@dataclass(frozen=True)
class RetrainLimits:
    # fixed values: default limits of the triggers
    min_precision: float = 0.5
    min_recall: float = 0.7
    min_pr_auc: float = 0.75
    max_psi: float = 0.1
    max_feature_drift_pct: float = 10.0
    fraud_rate_change: float = 0.2
    max_days_without_retrain: int = 30
    min_hours_between: int = 24
    min_samples: int | None = None


@dataclass(frozen=True)
class RetrainState:
    """What earlier runs left behind."""

    last_retrain: datetime | None = None
    model_version: str = "v1"
    baseline_fraud_rate: float | None = None


def can_retrain(state: RetrainState, as_of: datetime, limits: RetrainLimits = RetrainLimits()) -> bool:
    """At least the cooldown has passed since the last completed retrain."""
    if state.last_retrain is None:
        return True
    return (as_of - state.last_retrain).total_seconds() / 3600 >= limits.min_hours_between


def _trigger(df: DataFrame, prefix: str, reason: str, violated: Column, snapshot: Mapping[str, Column],
             as_of: datetime, version: str, notes: str = "", where: Column | None = None) -> DataFrame:
    pairs = [x for k, v in snapshot.items() for x in (F.lit(k), v.cast("double"))]
    rows = df if where is None else df.filter(where)
    return rows.select(
        F.lit(f"{prefix}_{as_of:%Y%m%d_%H%M%S}").alias("trigger_id"), F.lit(reason).alias("reason"),
        F.lit(as_of).cast("timestamp").alias("timestamp"),
        (F.create_map(*pairs) if pairs else F.expr("map_from_arrays(array(), array())").cast("map<string,double>")).alias("metrics_snapshot"),
        violated.alias("threshold_violated"), F.lit(version).alias("model_version_before"),
        F.lit(None).cast("string").alias("model_version_after"), F.lit("pending").alias("status"), F.lit(notes).alias("notes"),
    )


# The texts below (``name=value < limit`` and the like) are fixed values: trigger rows must carry them.
def _join_violations(parts: list[Column]) -> Column:
    return F.concat_ws("; ", F.array_compact(F.array(*parts)))


def performance_trigger(metrics: DataFrame, as_of: datetime, state: RetrainState = RetrainState(),
                        limits: RetrainLimits = RetrainLimits()) -> DataFrame:
    """From rows with precision, recall, pr_auc; a pr_auc of zero or null is not judged."""
    p, r, a = F.col("precision"), F.col("recall"), F.col("pr_auc")
    violated = _join_violations([
        F.when(p < limits.min_precision, F.format_string(f"precision=%.3f < {limits.min_precision}", p)),
        F.when(r < limits.min_recall, F.format_string(f"recall=%.3f < {limits.min_recall}", r)),
        F.when((a != 0) & (a < limits.min_pr_auc), F.format_string(f"pr_auc=%.3f < {limits.min_pr_auc}", a)),
    ])
    rows = metrics if can_retrain(state, as_of, limits) else metrics.limit(0)
    if limits.min_samples is not None:
        rows = rows.filter(F.col("n_samples") >= limits.min_samples)
    rows = rows.withColumn("_violated", violated).filter(F.col("_violated") != "")
    return _trigger(rows, "perf", "performance_degradation", F.col("_violated"),
                    {"precision": p, "recall": r, "pr_auc": a}, as_of, state.model_version)


def drift_trigger(share: DataFrame, as_of: datetime, state: RetrainState = RetrainState(),
                  limits: RetrainLimits = RetrainLimits()) -> DataFrame:
    """From rows with psi and drifting_features_pct."""
    psi, pct = F.coalesce(F.col("psi"), F.lit(0.0)), F.coalesce(F.col("drifting_features_pct"), F.lit(0.0))
    violated = _join_violations([
        F.when(psi > limits.max_psi, F.format_string(f"psi=%.3f > {limits.max_psi}", psi)),
        F.when(pct > limits.max_feature_drift_pct,
               F.format_string(f"feature_drift=%.1f%% > {limits.max_feature_drift_pct}%%", pct)),
    ])
    rows = share if can_retrain(state, as_of, limits) else share.limit(0)
    rows = rows.withColumn("_violated", violated).filter(F.col("_violated") != "")
    return _trigger(rows, "drift", "data_drift", F.col("_violated"), {"psi": psi, "drifting_features_pct": pct}, as_of, state.model_version)


def fraud_rate_trigger(rates: DataFrame, as_of: datetime, state: RetrainState = RetrainState(),
                       limits: RetrainLimits = RetrainLimits()) -> DataFrame:
    """From rows with fraud_rate; without a baseline nothing fires (the first rate becomes it)."""
    rate = F.col("fraud_rate")
    base = F.lit(state.baseline_fraud_rate).cast("double")
    change = F.abs(rate - base) / base
    shown = limits.fraud_rate_change * 100
    text = F.format_string(f"fraud_rate_change=%.1f%% > {shown:.1f}%%", change * 100)
    rows = rates if can_retrain(state, as_of, limits) and state.baseline_fraud_rate else rates.limit(0)
    return _trigger(rows, "fraud", "fraud_rate_spike", text,
                    {"baseline_fraud_rate": base, "current_fraud_rate": rate, "change_pct": change * 100},
                    as_of, state.model_version, where=change > limits.fraud_rate_change)


def fraud_rate_state(rates: DataFrame, state: RetrainState) -> RetrainState:
    """The state with a baseline: the given one, or else the first rate seen."""
    if state.baseline_fraud_rate is not None:
        return state
    first = rates.select("fraud_rate").first()
    return RetrainState(state.last_retrain, state.model_version, None if first is None else first[0])


def schedule_trigger(spark: SparkSession, as_of: datetime, state: RetrainState,
                     limits: RetrainLimits = RetrainLimits()) -> DataFrame:
    """Fires when the last retrain is at least the allowed number of whole days ago."""
    days = None if state.last_retrain is None else (as_of - state.last_retrain).days
    one = spark.range(1)
    due = days is not None and days >= limits.max_days_without_retrain
    text = F.lit(f"days_since_retrain={days} > {limits.max_days_without_retrain}")
    return _trigger(one, "sched", "scheduled", text, {"days_since_retrain": F.lit(days)}, as_of, state.model_version, where=F.lit(due))


def manual_trigger(spark: SparkSession, as_of: datetime, notes: str = "", state: RetrainState = RetrainState()) -> DataFrame:
    return _trigger(spark.range(1), "manual", "manual", F.lit(None).cast("string"), {}, as_of, state.model_version, notes)


def trigger_counts(triggers: DataFrame) -> DataFrame:
    """Number of triggers per reason; outcome rows of one trigger count once."""
    return triggers.groupBy("reason").agg(F.count_distinct("trigger_id").alias("n"))


def trigger_status(log: DataFrame) -> DataFrame:
    """Current row per trigger: the latest one, at equal times the one furthest on (``PROGRESS``), then by content."""
    rest = [c for c in log.columns if c != "trigger_id"]
    order = F.struct("timestamp", F.array_position(F.lit(list(PROGRESS)), F.col("status")), F.xxhash64(F.to_json(F.struct(*sorted(rest)))))
    return log.groupBy("trigger_id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("trigger_id", "_r.*")


def state_from_log(log: DataFrame, baseline_fraud_rate: float | None = None, version: str = "v1") -> RetrainState:
    """Last completed retrain and the model version it produced."""
    done = log.filter(F.col("status") == "completed")
    last = F.max_by("model_version_after", F.struct("timestamp", "trigger_id", "model_version_after"))
    row = done.agg(F.max("timestamp").alias("t"), last.alias("v")).first()
    return RetrainState(row["t"], row["v"] or version, baseline_fraud_rate)


def outcome(trigger: DataFrame, as_of: datetime, status: str, model_version_after: str | None = None, notes: str = "") -> DataFrame:
    """The row to append when a retrain starts, completes or fails."""
    return trigger.withColumns(
        {
            "timestamp": F.lit(as_of).cast("timestamp"), "status": F.lit(status),
            "model_version_after": F.lit(model_version_after).cast("string"), "notes": F.concat(F.col("notes"), F.lit(notes)),
        }
    )


def recent_triggers(log: DataFrame, limit: int = 10) -> DataFrame:
    return trigger_status(log).orderBy(F.desc("timestamp"), "trigger_id").limit(limit)


def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TRIGGER)
