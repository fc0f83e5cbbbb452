"""Event tables kept by day: what a load reads, what a write replaces."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskweave.sources import daily
from riskweave.sources.tables import load_predictions, load_transactions

T0 = datetime(2024, 5, 1)
DDL = "transaction_id string, timestamp timestamp, amount double"


def rows(spark, n=240):
    return spark.createDataFrame([(f"t{i}", T0 + timedelta(hours=i), float(i)) for i in range(n)], DDL)


def files_of(path, day):
    return sorted(Path(path).glob(f"day={day}/*.parquet"))


def test_a_day_is_read_without_the_others(spark, tmp_path):
    path = str(tmp_path / "events")
    daily.write_days(rows(spark), path)
    for folder in Path(path).glob("day=*"):
        if folder.name != "day=2024-05-04":
            for f in folder.glob("*.parquet"):
                f.write_bytes(b"no parquet file")  # whoever reads it fails
            for f in folder.glob(".*.crc"):
                f.unlink()
    spark.catalog.clearCache()
    schema_from = spark.read.schema(f"{DDL}, day date").parquet(path)
    assert schema_from.filter("day = '2024-05-04'").count() == 24
    got = daily.between_dates(schema_from.filter("day = '2024-05-04'"), "timestamp", T0 + timedelta(days=3, hours=5), T0 + timedelta(days=3, hours=8))
    assert sorted(r["amount"] for r in got.collect()) == [77.0, 78.0, 79.0]


def test_ranges_become_day_filters(spark, tmp_path):
    path = str(tmp_path / "events")
    daily.write_days(rows(spark), path)
    for low, high in ((0, 240), (5, 6), (23, 24), (24, 48), (30, 100), (100, 100)):
        got = daily.read_days(spark, path, "timestamp", T0 + timedelta(hours=low), T0 + timedelta(hours=high))
        assert sorted(r["amount"] for r in got.collect()) == [float(i) for i in range(low, high)]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert low == high or "PartitionFilters: [isnotnull(day" in plan
    one = daily.read_days(spark, path, "timestamp", T0, T0 + timedelta(days=1))
    assert one.rdd.getNumPartitions() <= len(files_of(path, "2024-05-01"))
    assert daily.read_days(spark, path).count() == 240


def test_writing_a_day_again_and_merging_late_rows(spark, tmp_path):
    path = str(tmp_path / "events")
    daily.write_days(rows(spark), path)
    untouched = files_of(path, "2024-05-08")
    daily.write_days(rows(spark).filter(F.to_date("timestamp") == F.lit(T0.date())).limit(3), path)
    assert daily.read_days(spark, path).count() == 240 - 21
    fresh = spark.createDataFrame(
        [("t30", T0 + timedelta(hours=30), -1.0), ("new", T0 + timedelta(hours=31), 5.0), ("later", T0 + timedelta(days=20), 1.0), ("lost", None, 1.0)], DDL
    )
    assert daily.merge_days(spark, path, fresh, ["transaction_id"]) == 2
    got = {r["transaction_id"]: r["amount"] for r in daily.read_days(spark, path).collect()}
    assert got["t30"] == -1.0 and got["new"] == 5.0 and got["later"] == 1.0 and "lost" not in got
    assert len(got) == 240 - 21 + 2
    assert files_of(path, "2024-05-08") == untouched
    assert daily.merge_days(spark, path, fresh.limit(0), ["transaction_id"]) == 0
    again = str(tmp_path / "other")
    assert daily.merge_days(spark, again, rows(spark, 30), ["transaction_id"]) == 2


@pytest.mark.parametrize("kept_by_day", [True, False])
def test_loaders_take_either_layout(spark, tmp_path, kept_by_day):
    df = rows(spark)
    if kept_by_day:
        daily.write_days(df, str(tmp_path / "raw" / "transactions"))
    else:
        df.write.parquet(str(tmp_path / "raw" / "transactions_1.parquet"))
    got = load_transactions(spark, str(tmp_path), T0 + timedelta(days=1), T0 + timedelta(days=2), validate=False)
    assert sorted(r["amount"] for r in got.collect()) == [float(i) for i in range(24, 48)] and "day" not in got.columns
    assert load_predictions(spark, str(tmp_path)).count() == 0
