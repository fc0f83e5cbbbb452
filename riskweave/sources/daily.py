"""Event tables as one partition per day: loads read the days they ask for, writes replace the days they bring."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import between_dates
from ..session import cut_lineage, prepare

DAY = "day"


def has_days(spark: SparkSession, path: str) -> bool:
    """Whether a folder is a table of day partitions."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{DAY}=*"))
    return found is not None and len(found) > 0


def write_days(df: DataFrame, path: str, time_column: str = "timestamp") -> None:
    """Write the rows, each day as a partition that replaces what was there; other days stay.

    Rows are brought together by day and large days split again (adaptive execution measures them), so a busy day is
    no single task and a quiet one no crowd of small files. Rows without a time have no day and are left out.
    """
    prepare(df.sparkSession)
    dated = df.filter(F.col(time_column).isNotNull()).withColumn(DAY, F.to_date(time_column))
    writer = dated.hint("rebalance", F.col(DAY)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(DAY).parquet(path)


def read_days(spark: SparkSession, path: str, time_column: str = "timestamp", start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """The rows of [start, end). Only partitions of days that the range touches are read."""
    prepare(spark)
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.filter(F.col(DAY) >= F.lit(start.date()))
    if end is not None:
        rows = rows.filter(F.col(DAY) <= F.lit((end - timedelta(microseconds=1)).date()))
    return between_dates(rows, time_column, start, end).drop(DAY)


def merge_days(spark: SparkSession, path: str, fresh: DataFrame, key: Sequence[str], time_column: str = "timestamp") -> int:
    """Add rows that came late or again: of equal keys on a day the fresh row stays. Returns the number of days rewritten.

    Stored days that no fresh row belongs to are neither read nor written.
    """
    if not has_days(spark, path):
        write_days(fresh, path, time_column)
        return fresh.select(F.to_date(time_column)).distinct().count()
    fresh = cut_lineage(fresh.filter(F.col(time_column).isNotNull()))
    days = [r[0] for r in fresh.select(F.to_date(time_column).alias(DAY)).distinct().collect()]  # as many as days
    if not days:
        return 0
    stored = spark.read.parquet(path).filter(F.col(DAY).isin(days)).drop(DAY)
    both = stored.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*key, "_fresh")]
    keys = [*key, F.to_date(time_column).alias(DAY)]
    order = F.struct("_fresh", F.xxhash64(F.to_json(F.struct(*sorted(rest)))))
    kept = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")
    write_days(cut_lineage(kept), path, time_column)  # stored first, as the days it read are replaced
    return len(days)
