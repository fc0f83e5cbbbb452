"""Loaders for transactions, labels, predictions and ground truth."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from ..operators.labels import between_dates, evaluation_window, join_labels, label_coverage
from ..operators.quality import LABEL_CONTRACT, TRANSACTION_CONTRACT, DataContract, require_valid
from ..schemas import LABEL_FIELDS, PREDICTION_LOG, TRANSACTION_FIELDS, record_ddl
from ..session import prepare
from .daily import has_days, read_days


def _exists(spark: SparkSession, pattern: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def load_parts(
    spark: SparkSession, directory: str, stem: str, time_column: str, empty: str,
    start=None, end=None, contract: DataContract | None = None, schema: str | None = None,
) -> DataFrame:
    """The table ``{stem}`` of day partitions, else all ``{stem}_*.parquet`` parts, else ``{stem}*.csv``, else an empty table.

    Of day partitions only the days of [start, end) are read. Parts are united by column name. The [start, end) filter is pushed into the scan; the
    contract, when given, is checked on the filtered rows and raises on errors.
    """
    prepare(spark)
    parquet, csv = f"{directory}/{stem}_*.parquet", f"{directory}/{stem}*.csv"
    if has_days(spark, f"{directory}/{stem}"):
        df = read_days(spark, f"{directory}/{stem}", time_column, start, end)
    elif _exists(spark, parquet):
        reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
        df = reader.parquet(parquet)
    elif _exists(spark, csv):
        reader = spark.read.option("header", "true")
        df = (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(csv)
    else:
        return spark.createDataFrame([], empty)
    if time_column in df.columns:
        df = df.withColumn(time_column, df[time_column].cast("timestamp"))
        df = between_dates(df, time_column, start, end)
    if contract is not None and not df.isEmpty():
        require_valid(df, contract)
    return df


def load_transactions(spark: SparkSession, data_dir: str, start_date=None, end_date=None, validate: bool = True, **kw) -> DataFrame:
    return load_parts(
        spark, f"{data_dir}/raw", "transactions", "timestamp", record_ddl(TRANSACTION_FIELDS), start_date, end_date,
        TRANSACTION_CONTRACT if validate else None, **kw,
    )


def load_labels(spark: SparkSession, data_dir: str, start_date=None, end_date=None, validate: bool = True, **kw) -> DataFrame:
    return load_parts(
        spark, f"{data_dir}/labels", "labels", "label_timestamp", record_ddl(LABEL_FIELDS), start_date, end_date,
        LABEL_CONTRACT if validate else None, **kw,
    )


def load_predictions(spark: SparkSession, data_dir: str, start_date=None, end_date=None, **kw) -> DataFrame:
    return load_parts(
        spark, f"{data_dir}/predictions", "predictions", "prediction_timestamp", PREDICTION_LOG, start_date, end_date, **kw
    )


def load_ground_truth(spark: SparkSession, data_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{data_dir}/ground_truth.parquet")


def load_evaluation_window(spark: SparkSession, data_dir: str, window_end, window_days: int = 30) -> DataFrame:
    """Predictions of the window, labelled by every label there is."""
    start = window_end - timedelta(days=window_days)
    return evaluation_window(load_predictions(spark, data_dir, start, window_end), load_labels(spark, data_dir), window_end, window_days)


__all__ = [
    "load_parts", "load_transactions", "load_labels", "load_predictions", "load_ground_truth",
    "load_evaluation_window", "join_labels", "label_coverage",
]
