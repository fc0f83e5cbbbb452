from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.operators import velocity as V
from riskweave.operators.entities import devices_per_user
from riskweave.operators.scan import HOT_ROWS

T0 = datetime(2024, 3, 1)
SCHEMA = "transaction_id bigint, timestamp timestamp, user_id string, device_id bigint, merchant_id string, amount double"
PATHS = pytest.mark.parametrize("min_rows", [HOT_ROWS, 10], ids=["plain", "sliced"])


def rows():
    """Many equal instants, events exactly one window apart, a hot user, null merchants."""
    rng = np.random.default_rng(3)
    out = []
    for i in range(150):
        user = "hot" if i % 3 else f"u{i % 5}"
        at = T0 + timedelta(minutes=15 * int(rng.integers(0, 40)))
        merchant = None if i % 11 == 0 else f"m{rng.integers(0, 4)}"
        out.append((i, at, user, int(rng.integers(0, 4)), merchant, float(np.round(rng.lognormal(3, 1), 2))))
    out.append((1000, T0, "single", 9, "m1", 5.0))
    return out


@PATHS
def test_windows_against_brute_force(spark, min_rows):
    data = rows()
    pdf = pd.DataFrame(data, columns=["id", "t", "u", "d", "m", "a"])
    df = spark.createDataFrame(data, SCHEMA)
    got = V.burst_ratios(V.windowed_features(df, (1, 24), min_rows=min_rows)).toPandas().set_index("transaction_id")
    peak = V.trailing_max(df, "user_id", {"1h": 3600}, "amount", "mx", min_rows=min_rows).toPandas().set_index(["user_id", "timestamp"])
    for r in pdf.itertuples():
        g = got.loc[r.id]
        for h in (1, 24):
            past = pdf[(pdf.u == r.u) & (pdf.t >= r.t - timedelta(hours=h)) & (pdf.t < r.t)]
            assert g[f"txn_count_{h}h"] == len(past)
            assert g[f"txn_amount_{h}h"] == pytest.approx(past.a.sum(), abs=1e-9)
            assert g[f"avg_amount_{h}h"] == pytest.approx(past.a.mean() if len(past) else 0, abs=1e-9)
            assert g[f"unique_merchants_{h}h"] == past.m.nunique()
        assert g["txn_count_ratio_1h_24h"] == pytest.approx(g["txn_count_1h"] / max(g["txn_count_24h"], 1))
        hour = pdf[(pdf.u == r.u) & (pdf.t >= r.t - timedelta(hours=1)) & (pdf.t < r.t)]
        assert peak.loc[(r.u, r.t), "mx_1h"] == (hour.a.max() if len(hour) else 0)


@PATHS
def test_serving_windows_against_brute_force(spark, min_rows):
    data = rows()
    pdf = pd.DataFrame(data, columns=["id", "t", "u", "d", "m", "a"])
    got = V.serving_velocity(spark.createDataFrame(data, SCHEMA), min_rows=min_rows).toPandas().set_index("transaction_id")
    for r in pdf.itertuples():
        before = pdf[(pdf.t < r.t) | ((pdf.t == r.t) & (pdf.id < r.id))]
        for w, s in V.SERVING_WINDOWS.items():
            mine = before[(before.u == r.u) & (before.t > r.t - timedelta(seconds=s))]
            dev = before[(before.d == r.d) & (before.t > r.t - timedelta(seconds=s))]
            g = got.loc[r.id]
            assert g[f"user_txn_count_{w}"] == len(mine) and g[f"user_unique_merchants_{w}"] == mine.m.nunique()
            assert g[f"user_txn_amount_{w}"] == pytest.approx(mine.a.sum(), abs=1e-9)
            assert g[f"device_txn_count_{w}"] == len(dev) and g[f"device_unique_users_{w}"] == dev.u.nunique()


def test_bounds_of_both_forms(spark):
    """An event exactly one hour back is inside [t-w, t) and outside (t-w, ...)."""
    data = [(1, T0, "u", 1, "m", 1.0), (2, T0 + timedelta(hours=1), "u", 1, "m", 2.0)]
    df = spark.createDataFrame(data, SCHEMA)
    assert V.windowed_features(df, (1,)).filter("transaction_id = 2").first()["txn_count_1h"] == 1
    assert V.serving_velocity(df).filter("transaction_id = 2").first()["user_txn_count_1h"] == 0


@PATHS
def test_history_and_rolling_profile(spark, min_rows):
    data = rows()
    pdf = pd.DataFrame(data, columns=["id", "t", "u", "d", "m", "a"])
    df = spark.createDataFrame(data, SCHEMA)
    hist = V.user_history(df, min_rows=min_rows).toPandas().set_index("transaction_id")
    prof = V.rolling_amount_profile(df, 1, min_rows=min_rows).toPandas().set_index("transaction_id")
    devs = devices_per_user(df, 1, min_rows=min_rows).toPandas().set_index("transaction_id")
    for r in pdf.itertuples():
        before = pdf[(pdf.u == r.u) & ((pdf.t < r.t) | ((pdf.t == r.t) & (pdf.id < r.id)))]
        assert hist.loc[r.id, "total_lifetime_transactions"] == len(before)
        past = pdf[(pdf.u == r.u) & (pdf.t >= r.t - timedelta(days=1)) & (pdf.t < r.t)]
        assert devs.loc[r.id, "devices_last_1d"] == max(1, past.d.nunique())
        std = prof.loc[r.id, "std_amount_1d"]
        assert pd.isna(std) if len(past) < 2 else std == pytest.approx(past.a.std(), abs=1e-4)


def test_unknown_user_and_constant_amount(spark):
    train = spark.createDataFrame([("a", 10.0), ("a", 10.0), ("b", 4.0), ("b", 8.0), ("c", 7.0)], "user_id string, amount double")
    base = V.user_baseline(train)
    assert base.filter("is_global").count() == 1 and base.filter("user_id = 'c'").first()["std_amount"] is None
    new = spark.createDataFrame([(1, "a", 13.0), (2, "b", 6.0), (3, "zz", 7.8)], "transaction_id int, user_id string, amount double")
    out = {r["transaction_id"]: r["amount_vs_user_avg"] for r in V.amount_vs_user(new, base).collect()}
    assert out[1] == 3.0 and out[2] == 0.0 and out[3] == pytest.approx(0.0)


def test_missing_columns_give_no_features(spark):
    assert V.windowed_features(spark.createDataFrame([(1,)], "x int")).columns == []
    df = spark.createDataFrame(rows(), SCHEMA).drop("merchant_id")
    assert V.windowed_features(df, (1,)).agg(F.max("unique_merchants_1h")).first()[0] == 0


def test_cold_plan_shuffles_events_once(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    plan = V.windowed_features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@PATHS
def test_grid_keeps_rows_of_null_and_repeated_ids_and_takes_nan(spark, min_rows):
    hour = timedelta(hours=1)
    data = [
        (None, T0, "a", 1, "m", 7.0), (None, T0 + hour, "a", 1, "m", 3.0), (5, T0, "b", 1, "m", 500.0),
        (5, T0 + hour, "b", 1, "m", float("nan")), (5, T0 + hour, "a", 1, "m", 2.0), (6, T0 + 2 * hour, "b", 1, "m", 1.0),
        (7, T0, None, 1, "m", 4.0), (8, T0 + hour, None, 1, "m", 4.0),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    got = V.velocity_grid(df, {"24h": 86400}, min_rows=min_rows).toPandas()
    assert len(got) == len(data)
    found = {(r.user_id, r.timestamp.hour - T0.hour): (r.amount_max_24h, r.txn_count_24h, r.amount_sum_24h) for r in got.itertuples()}
    assert found[("a", 1)] == (7.0, 1, 7.0) and found[("b", 1)] == (500.0, 1, 500.0)
    assert found[("b", 2)] == (500.0, 2, 500.0) and found[(None, 1)][0] == 4.0
