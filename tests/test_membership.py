"""Filtered list membership and exact heavy hitters against plain joins and counts."""

import pytest
from pyspark.sql import functions as F

from riskweave.operators import entities
from riskweave.operators.entities import heavy_hitters, membership_flag
from riskweave.operators.membership import flag_members, likely_hits, list_filter


def table(spark, n=5_000):
    return spark.range(n).select(
        F.col("id"), (F.col("id") % 700).alias("user"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("d"), F.col("id") % 50)).alias("device"),
        F.create_map(F.lit("a"), F.col("id")).alias("extra"),
    )


@pytest.mark.parametrize("most_bits", [1 << 26, 64])
def test_flags_equal_a_plain_join(spark, most_bits):
    """With 64 bits in all the filter lets nearly everything through; the flags stay right."""
    df = table(spark)
    users = spark.range(0, 100_000, 7).select(F.col("id").cast("int").alias("u"))
    devices = spark.createDataFrame([("d3",), ("d3",), (None,), ("zz",)], "d string")
    got = flag_members(df, {"bad_user": ("user", users), "bad_device": ("device", devices)}, most_bits=most_bits)
    want = membership_flag(membership_flag(df, "user", users, "bad_user"), "device", devices, "bad_device")
    columns = ["id", "user", "device", "bad_user", "bad_device"]
    assert got.count() == 5_000 and got.select(columns).exceptAll(want.select(columns)).count() == 0
    assert got.columns == [*df.columns, "bad_user", "bad_device"]


def test_only_likely_rows_go_on(spark):
    df = spark.range(40_000)
    listing = spark.range(0, 4_000_000, 100).select((F.col("id") + 39_000).alias("item"))
    on_list = df.join(listing, df["id"] == listing["item"], "left_semi").count()
    through = likely_hits(df, "id", listing).count()
    assert on_list <= through <= on_list + 0.03 * 40_000
    found = list_filter(listing)
    assert found.row.count() == 1 and found.bits % 64 == 0 and len(found.row.first()["words"]) == found.bits // 64


def test_empty_lists_and_tables(spark):
    df = table(spark, 20)
    none = spark.createDataFrame([], "x long")
    assert flag_members(df, {"f": ("user", none)}).filter("f").count() == 0
    assert flag_members(df.limit(0), {"f": ("user", spark.range(5))}).count() == 0
    assert flag_members(df, {}) is df
    again = flag_members(df.withColumn("f", F.lit(True)), {"f": ("user", none)})
    assert again.filter("f").count() == 0 and again.columns.count("f") == 1


def counts(df, column, k):
    return [tuple(r) for r in df.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(k).collect()]


def test_heavy_hitters_equal_exact_counts(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, F.concat(F.lit("w"), F.col("id") % 7))
        .when(F.col("id") % 11 > 0, F.concat(F.lit("r"), F.col("id"))).alias("x")
    )
    for k in (1, 5, 8):
        assert [tuple(r) for r in heavy_hitters(df, "x", k, tracked=2_000).collect()] == counts(df, "x", k)


def test_what_a_sketch_may_have_missed_is_counted_in_full(spark, monkeypatch):
    """All equally frequent: the sketch names few or none, so everything is counted."""
    df = spark.range(20_000).select((F.col("id") % 4_000).alias("x"))
    assert [tuple(r) for r in heavy_hitters(df, "x", 12, tracked=100).collect()] == counts(df, "x", 12)
    assert heavy_hitters(df.limit(0), "x", 3).count() == 0
    few = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x long")
    assert [tuple(r) for r in heavy_hitters(few, "x", 10).collect()] == [(1, 2), (2, 1)]
    assert entities.TRACKED >= 10_000
