"""Alert rows from drift, gate, contract and latency tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ("info", "warning", "critical")
SOURCE = "riskweave"


# --- fixed values: alert rows must carry these names and message texts --------------------------------
DRIFT = ("drift_detected", "Drift detected in '%s': %.3f (threshold: %.3f)")
PERFORMANCE = ("performance_degradation", "Performance degraded: %s=%.3f (min: %.3f)")
QUALITY = ("data_quality_issue", "Data quality issue: ")
LATENCY = ("latency_degradation", "Latency degraded: p99=%.1fms (target: %.1fms)")
LATENCY_TARGET_MS = 50.0
# ------------------------------------------------------------------------------------------


def severity_rank(col: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), col)


def _alert(df: DataFrame, name: str, severity: Column, message: Column, as_of: datetime, details: dict[str, Column]) -> DataFrame:
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        F.lit(name).alias("name"), severity.alias("severity"), message.alias("message"),
        F.lit(as_of).cast("timestamp").alias("timestamp"), F.lit(SOURCE).alias("source"), F.create_map(*pairs).alias("details"),
    )


def drift_alerts(results: DataFrame, as_of: datetime) -> DataFrame:
    """One alert per drifting feature."""
    hit = results.filter(F.col("severity") != "none")
    text = F.format_string(DRIFT[1], "feature", "statistic", "threshold")
    return _alert(hit, DRIFT[0], F.col("severity"), text, as_of,
                  {"feature": F.col("feature"), "drift_value": F.col("statistic"), "threshold": F.col("threshold")})


def performance_alerts(gates: DataFrame, as_of: datetime) -> DataFrame:
    """One alert per failed gate row (metric, value, minimum, passed)."""
    hit = gates.filter(~F.col("passed"))
    text = F.format_string(PERFORMANCE[1], "metric", "value", "minimum")
    return _alert(hit, PERFORMANCE[0], F.lit("critical"), text, as_of,
                  {"metric": F.col("metric"), "current_value": F.col("value"), "threshold": F.col("minimum")})


def quality_alerts(checks: DataFrame, as_of: datetime) -> DataFrame:
    """One alert per failed contract check."""
    hit = checks.filter(~F.col("passed"))
    text = F.concat(F.lit(QUALITY[1]), F.col("message"))
    return _alert(hit, QUALITY[0], F.lit("warning"), text, as_of,
                  {"column": F.col("column"), "check": F.col("check"), "value": F.col("value")})


def latency_alerts(summary: DataFrame, as_of: datetime, target_ms: float = LATENCY_TARGET_MS) -> DataFrame:
    """One alert per latency summary row whose p99 is above the target."""
    hit = summary.filter(F.col("latency_p99_ms") > target_ms)
    text = F.format_string(LATENCY[1], F.col("latency_p99_ms"), F.lit(float(target_ms)))
    return _alert(hit, LATENCY[0], F.lit("warning"), text, as_of,
                  {"current_p99_ms": F.col("latency_p99_ms"), "threshold_ms": F.lit(float(target_ms))})


def at_least(alerts: DataFrame, severity: str = "info") -> DataFrame:
    """Alerts of the given severity or worse."""
    return alerts.filter(severity_rank(F.col("severity")) >= SEVERITIES.index(severity) + 1)


def recent_alerts(alerts: DataFrame, n: int = 10, severity: str | None = None) -> DataFrame:
    """The last n alerts, optionally of one severity."""
    rows = alerts if severity is None else alerts.filter(F.col("severity") == severity)
    return rows.orderBy(F.desc("timestamp"), "name", "message").limit(n)
