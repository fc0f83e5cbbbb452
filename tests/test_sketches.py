"""Daily profiles and hourly panes: merged windows against exact ones, errors against the stated bounds."""

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import drift, panes, profiles

T0 = datetime(2024, 3, 1)


def measured(spark, n=20_000, days=20):
    rng = np.random.default_rng(3)
    rows = [
        (T0 + timedelta(minutes=int(m)), float(v), float(w) if w > 0.05 else None, 7.0, int(k))
        for m, v, w, k in zip(rng.integers(0, days * 1440, n), 1e6 + rng.lognormal(0, 1, n), rng.random(n), rng.integers(0, 5, n))
    ]
    return spark.createDataFrame(rows, "timestamp timestamp, a double, b double, flat double, k int")


def test_any_window_from_daily_rows(spark):
    df = measured(spark)
    daily = profiles.daily_profiles(df, ["a", "b", "flat", "k"]).cache()
    assert daily.count() == 20 * 4
    for first, last in ((0, 20), (3, 10), (19, 20)):
        low, high = T0 + timedelta(days=first), T0 + timedelta(days=last)
        got = {r["feature"]: r for r in profiles.window_profile(daily, low.date(), high.date()).collect()}
        raw = df.filter((F.col("timestamp") >= F.lit(low)) & (F.col("timestamp") < F.lit(high)))
        exact = {r["feature"]: r for r in drift.feature_profile(raw, ["a", "b", "flat", "k"]).collect()}
        assert set(got) == set(exact)
        for name, e in exact.items():
            g = got[name]
            for c in ("mean", "std", "min", "max"):
                assert g[c] == pytest.approx(e[c], rel=1e-9, abs=1e-9), (name, c)
            values = np.sort([r[0] for r in raw.select(F.col(name).cast("double")).dropna().collect()])
            assert g["n"] == len(values)
            for p in drift.PROFILE_PERCENTS:
                below, upto = (np.searchsorted(values, g[f"p{p}"], side=s) / len(values) for s in ("left", "right"))
                most = 2 * profiles.rank_error() + 1 / len(values)
                assert below <= p / 100 + most and upto >= p / 100 - most


def test_a_day_written_again_replaces_itself_alone(spark, tmp_path):
    df, path = measured(spark, 2_000, 4), str(tmp_path / "daily")
    profiles.write_profiles(profiles.daily_profiles(df, ["a"]), path)
    second = df.filter(F.to_date("timestamp") == F.lit(date(2024, 3, 2)))
    profiles.write_profiles(profiles.daily_profiles(second.unionByName(second), ["a"]), path)
    n = {r["day"]: r["n"] for r in profiles.read_profiles(spark, path).collect()}
    want = {r["d"]: r["count"] for r in df.groupBy(F.to_date("timestamp").alias("d")).count().collect()}
    want[date(2024, 3, 2)] *= 2
    assert n == want
    # a window reads its own days' partitions
    plan = profiles.between_days(profiles.read_profiles(spark, path), date(2024, 3, 2), date(2024, 3, 3))
    assert len(plan.inputFiles()) == 4 and "PartitionFilters: [isnotnull(day" in plan._jdf.queryExecution().toString()


def test_drift_from_profiles_is_near_the_exact_one(spark):
    df = measured(spark)
    border = T0 + timedelta(days=14)
    moved = df.withColumn("a", F.when(F.col("timestamp") >= F.lit(border), F.col("a") + 0.1).otherwise(F.col("a")))
    daily = profiles.daily_profiles(moved, ["a", "b", "flat", "k"])
    got = {r["feature"]: r for r in profiles.profile_drift(daily, (date(2024, 3, 1), border.date()), (border.date(), date(2024, 4, 1))).collect()}
    names = ["a", "b", "flat"]
    exact = drift.feature_drift(moved.filter(F.col("timestamp") < F.lit(border)), moved.filter(F.col("timestamp") >= F.lit(border)), names)
    bound = 2 / profiles.GRID + 2 * profiles.rank_error()
    for e in exact.collect():
        g = got[e["feature"]]
        assert g["severity"] == e["severity"], (g, e)
        assert abs(g["ks_statistic"] - e["ks_statistic"]) <= bound
        assert g["statistic"] == pytest.approx(e["statistic"], abs=0.03)
        assert g["ref_mean"] == pytest.approx(e["ref_mean"], rel=1e-12)


def test_profiles_of_nothing(spark):
    df = measured(spark, 10, 1).limit(0)
    daily = profiles.daily_profiles(df, ["a"])
    assert daily.count() == 0 and profiles.window_profile(daily, date(2024, 1, 1), date(2025, 1, 1)).count() == 0


def pane_events(spark, n, users, partners, hours, seed=1):
    rng = np.random.default_rng(seed)
    rows = [
        (f"u{u}", T0 + timedelta(minutes=int(m)), float(round(a, 2)), f"m{p}" if p else None)
        for u, m, a, p in zip(rng.integers(0, users, n), rng.integers(0, hours * 60, n), rng.lognormal(2, 1, n), rng.integers(0, partners, n))
    ]
    return spark.createDataFrame(rows, "user_id string, timestamp timestamp, amount double, merchant_id string")


@pytest.mark.parametrize("length", [1, 5, 24, 1000])
def test_windows_of_panes_equal_plain_sums(spark, length):
    df = pane_events(spark, 1_500, 6, 30, 200)
    hours = panes.activity_panes(df, distincts={"merchants": "merchant_id"})
    got = {(r["user_id"], r["pane"]): (r["n"], float(r["amount"]), r["merchants"]) for r in panes.pane_windows(hours, length).collect()}
    rows = [(r["user_id"], int(r["timestamp"].timestamp() // 3600), r["amount"], r["merchant_id"]) for r in df.collect()]
    assert set(got) == {(u, p) for u, p, _, _ in rows}
    for u, p in got:
        inside = [r for r in rows if r[0] == u and p - length < r[1] <= p]
        n, amount, merchants = got[u, p]
        assert n == len(inside) and amount == pytest.approx(sum(r[2] for r in inside)) and merchants == len({r[3] for r in inside} - {None})


def test_many_partners_within_the_stated_error(spark):
    df = pane_events(spark, 60_000, 1, 20_000, 100, 7)
    hours = panes.activity_panes(df, distincts={"merchants": "merchant_id"})
    last = panes.pane_windows(hours, 100).orderBy(F.desc("pane")).first()
    exact = df.select("merchant_id").dropna().distinct().count()
    assert abs(last["merchants"] - exact) <= 4 * panes.distinct_error() * exact


def test_panes_can_be_added_and_hold_odd_rows(spark):
    df = pane_events(spark, 400, 3, 10, 50)
    odd = spark.createDataFrame([(None, T0, 1.0, "m1"), ("u1", None, 1.0, "m1")], df.schema)
    first, second = df.filter("amount < 5"), df.filter("amount >= 5")
    count = {"merchants": "merchant_id"}
    whole = panes.activity_panes(df, distincts=count)
    added = panes.add_panes(panes.activity_panes(first.unionByName(odd), distincts=count), panes.activity_panes(second, distincts=count))
    a, b = (sorted(map(tuple, panes.pane_windows(x, 12).collect())) for x in (whole, added))
    assert a == b
    assert panes.pane_windows(whole.limit(0), 12).count() == 0
    with pytest.raises(ValueError):
        panes.pane_windows(whole, 0)
