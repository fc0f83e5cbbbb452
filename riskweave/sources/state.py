"""State that outlives a run: versioned tables, append-only logs, report sections."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..operators.evaluation import EvaluationReport
from ..operators.retrain import RetrainState, empty_log


def _files(spark: SparkSession, path: str):
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), root


def save_table(df: DataFrame, path: str) -> str:
    """Write a new version beside the old ones; readers keep the version they opened."""
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    target = f"{path}/version-{stamp}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(target)
    return target


def load_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest completely written version, or None."""
    fs, root = _files(spark, path)
    if not fs.exists(root):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())
    for name in reversed([n for n in names if n.startswith("version-")]):
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
        if fs.exists(done):
            return spark.read.parquet(f"{path}/{name}")
    return None


def save_reconciler(path: str, pending: DataFrame, reconciled: DataFrame) -> None:
    save_table(pending, f"{path}/pending")
    save_table(reconciled, f"{path}/reconciled")


def load_reconciler(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    return load_table(spark, f"{path}/pending"), load_table(spark, f"{path}/reconciled")


def append_triggers(triggers: DataFrame, path: str) -> None:
    triggers.write.mode("append").parquet(f"{path}/triggers")


def load_triggers(spark: SparkSession, path: str) -> DataFrame:
    fs, root = _files(spark, f"{path}/triggers")
    return spark.read.parquet(f"{path}/triggers") if fs.exists(root) else empty_log(spark)


def save_retrain_state(spark: SparkSession, state: RetrainState, path: str) -> None:
    row = (state.last_retrain, state.model_version, state.baseline_fraud_rate)
    schema = "last_retrain timestamp, model_version string, baseline_fraud_rate double"
    save_table(spark.createDataFrame([row], schema).coalesce(1), f"{path}/state")


def load_retrain_state(spark: SparkSession, path: str) -> RetrainState:
    found = load_table(spark, f"{path}/state")
    row = None if found is None else found.first()
    return RetrainState() if row is None else RetrainState(row["last_retrain"], row["model_version"], row["baseline_fraud_rate"])


def append_alerts(alerts: DataFrame, path: str) -> None:
    """One JSON object per line."""
    alerts.write.mode("append").json(path)


def clear_alerts(spark: SparkSession, schema, path: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").json(path)


def save_report(report: EvaluationReport, path: str, fmt: str = "parquet") -> None:
    """One dataset per section of the report."""
    for name, table in report.sections().items():
        table.write.mode("overwrite").format(fmt).save(f"{path}/{name}")
