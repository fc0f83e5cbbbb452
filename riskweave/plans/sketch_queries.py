"""Queries over rows kept by day or hour: partitioned loads, daily profiles, hourly panes."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import entities, membership, panes, profiles
from ..operators.drift import PROFILE_PERCENTS, melt
from ..session import prepare, shared_root
from ..sources import daily
from ..sources.tables import load_evaluation_window, load_transactions
from .label_queries import PRED_LAB
from .monitoring_queries import _KS, _LONG, _PSI, _round, _sides
from .views import PRED_SQL, TXN_SQL, labels, predictions, transactions

MEASURES = ["amount", "account_age_days", "fraud_probability", "latency_ms"]
WINDOW = (date(2024, 1, 3), date(2024, 1, 24))
BORDER = date(2024, 1, 24)
PANES = 72


def _stored(spark, rows):
    """The profiles as a table of day partitions."""
    path = f"{shared_root(prepare(spark))}/profiles-{uuid.uuid4().hex}"
    profiles.write_profiles(rows, path)
    return profiles.read_profiles(spark, path)


def window_profiles(spark, sf_dir):
    """Three weeks from daily profiles; every estimated percentile's true rank is checked against twice the stated error."""
    p = predictions(spark, sf_dir).select("timestamp", *MEASURES)
    kept = _stored(spark, profiles.daily_profiles(p, MEASURES))
    out = profiles.window_profile(kept, *WINDOW)
    inside = p.filter((F.col("timestamp") >= F.lit(WINDOW[0])) & (F.col("timestamp") < F.lit(WINDOW[1])))
    # one row per feature is broadcast
    rows = melt(inside, MEASURES).join(F.broadcast(out.select("feature", *[f"p{q}" for q in PROFILE_PERCENTS])), "feature")
    most = 2 * profiles.rank_error()
    low = lambda q: F.avg((F.col("value") < F.col(f"p{q}")).cast("int")) <= q / 100 + most
    high = lambda q: F.avg((F.col("value") <= F.col(f"p{q}")).cast("int")) >= q / 100 - most
    checks = rows.groupBy("feature").agg(*[(low(q) & high(q)).alias(f"_{q}") for q in PROFILE_PERCENTS])
    near = F.lit(True)
    for q in PROFILE_PERCENTS:
        near = near & F.col(f"_{q}")
    joined = out.join(checks, "feature").select("feature", "n", "mean", "std", "min", "max", near.alias("ranks_near"))
    return _round(joined, 5, "mean", "std", "min", "max")


WINDOW_PROFILES = "WITH " + PRED_SQL + ", v AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {c}::DOUBLE AS value FROM pred WHERE "timestamp" >= TIMESTAMP '2024-01-03' AND "timestamp" < TIMESTAMP '2024-01-24'""" for c in MEASURES
) + """) SELECT feature, count(*) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, round(min(value), 5) AS min, round(max(value), 5) AS max,
  true AS ranks_near FROM v GROUP BY feature"""


def profile_drift(spark, sf_dir):
    """Everything before the border against everything after it, from daily profiles."""
    ref, cur = _sides(spark, sf_dir)
    kept = _stored(spark, profiles.daily_profiles(ref.unionByName(cur), ["amount", "device_id", "level", "flat"]))
    out = profiles.profile_drift(kept, (date(2000, 1, 1), BORDER), (BORDER, date(2100, 1, 1)))
    return _round(out.select("feature", "severity", "ref_mean", "cur_mean"), 5, "ref_mean", "cur_mean")


PROFILE_DRIFT = "WITH RECURSIVE " + _LONG + ", " + _PSI + ", " + _KS + """, means AS (SELECT feature, avg(value) FILTER (early) AS ref_mean, avg(value) FILTER (NOT early) AS cur_mean FROM v GROUP BY feature)
SELECT feature, CASE WHEN psi >= 0.2 THEN 'critical' WHEN psi >= 0.1 OR p < 0.05 THEN 'warning' ELSE 'none' END AS severity, round(ref_mean, 5) AS ref_mean, round(cur_mean, 5) AS cur_mean
FROM psi JOIN ks USING (feature) JOIN means USING (feature) WHERE feature <> 'user_id'"""


def pane_windows(spark, sf_dir):
    """Three days up to every hour a user was seen in; few partners, so the estimates are exact."""
    hours = panes.activity_panes(transactions(spark, sf_dir), distincts={"merchants": "merchant_id", "devices": "device_id"})
    return panes.pane_windows(hours, PANES).withColumn("amount", F.round(F.col("amount").cast("double"), 4))


PANE_WINDOWS = "WITH " + TXN_SQL + f""", e AS (SELECT user_id, us // 3600000000 AS pane, amount, merchant_id, device_id FROM txn), p AS (SELECT DISTINCT user_id, pane FROM e)
SELECT p.user_id, p.pane, count(*) AS n, round(sum(amount), 4)::DOUBLE AS amount, count(DISTINCT merchant_id) AS merchants, count(DISTINCT device_id) AS devices
FROM p JOIN e ON e.user_id = p.user_id AND e.pane BETWEEN p.pane - {PANES - 1} AND p.pane GROUP BY 1, 2"""

def loaded_window(spark, sf_dir):
    """Ten days of labelled predictions, loaded from tables kept by day, of which one day was written again."""
    root = f"{shared_root(prepare(spark))}/daily-{uuid.uuid4().hex}"
    p = predictions(spark, sf_dir).select(
        "transaction_id", "user_id", "merchant_id", "amount", "fraud_probability", "decision", "model_version", "prediction_timestamp"
    )
    daily.write_days(p.withColumn("amount", F.lit(0.0)), f"{root}/predictions/predictions", "prediction_timestamp")
    daily.merge_days(spark, f"{root}/predictions/predictions", p, ["transaction_id"], "prediction_timestamp")
    daily.write_days(labels(spark, sf_dir), f"{root}/labels/labels", "label_timestamp")
    joined = load_evaluation_window(spark, root, datetime(2024, 1, 20), 10)
    return joined.select("transaction_id", F.round("amount", 4).alias("amount"), "is_fraud", "label_delay_days", "has_label")


LOADED_WINDOW = "WITH " + PRED_LAB + ", " + """joined AS (SELECT p.transaction_id, p.amount, p.prediction_timestamp, l.is_fraud,
  floor((epoch_us(l.label_timestamp) - epoch_us(p.prediction_timestamp)) / 86400000000.0::DOUBLE)::BIGINT AS label_delay_days,
  l.is_fraud IS NOT NULL AS has_label FROM pred p LEFT JOIN lab l USING (transaction_id))
SELECT transaction_id, round(amount, 4) AS amount, is_fraud, label_delay_days, has_label FROM joined
WHERE prediction_timestamp >= TIMESTAMP '2024-01-10' AND prediction_timestamp < TIMESTAMP '2024-01-20'"""


def transactions_of_days(spark, sf_dir):
    """Loads of two ranges, one within a day, from transactions kept by day, with their contract."""
    root = f"{shared_root(prepare(spark))}/daily-{uuid.uuid4().hex}"
    t = transactions(spark, sf_dir).select("transaction_id", "timestamp", "amount", "merchant_id", "merchant_category", F.col("user_id").cast("string").alias("user_id"))
    daily.write_days(t, f"{root}/raw/transactions")
    ranges = ((datetime(2024, 1, 5), datetime(2024, 1, 9)), (datetime(2024, 1, 12, 6), datetime(2024, 1, 12, 18)))
    parts = [load_transactions(spark, root, *r, validate=False).withColumn("part", F.lit(i)) for i, r in enumerate(ranges)]
    both = parts[0].unionByName(parts[1])
    return both.groupBy("part", F.date_format("timestamp", "yyyy-MM-dd").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 3).alias("amount")
    )


TRANSACTIONS_OF_DAYS = "WITH " + TXN_SQL + """ SELECT part, strftime("timestamp", '%Y-%m-%d') AS date, count(*) AS n, round(sum(amount), 3) AS amount
FROM txn, (VALUES (0, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-09'), (1, TIMESTAMP '2024-01-12 06:00:00', TIMESTAMP '2024-01-12 18:00:00')) r(part, a, z)
WHERE "timestamp" >= a AND "timestamp" < z GROUP BY 1, 2"""

def _lists(spark, sf_dir):
    """Long lists made of the data: most items belong to no row."""
    t = transactions(spark, sf_dir)
    return {
        "listed_transaction": ("transaction_id", t.select((F.col("transaction_id") * 13).alias("item"))),
        "listed_user": ("user_id", t.select((F.col("user_id") * 7 + 1).alias("item"))),
    }


def filtered_list_flags(spark, sf_dir):
    """Two lists as long as the table; only rows their filters let through are joined."""
    flagged = membership.flag_members(transactions(spark, sf_dir).select("transaction_id", "user_id", "amount"), _lists(spark, sf_dir))
    return flagged.select("transaction_id", "listed_transaction", "listed_user")


FILTERED_LIST_FLAGS = "WITH " + TXN_SQL + """ SELECT transaction_id, transaction_id IN (SELECT transaction_id * 13 FROM txn) AS listed_transaction,
  user_id IN (SELECT user_id * 7 + 1 FROM txn) AS listed_user FROM txn"""


def top_users(spark, sf_dir):
    """The 25 busiest users, from a sketch's candidates counted exactly."""
    return entities.heavy_hitters(transactions(spark, sf_dir), "user_id", 25, tracked=2_000)


TOP_USERS = "WITH " + TXN_SQL + " SELECT user_id, count(*) AS n FROM txn GROUP BY 1 ORDER BY n DESC, user_id LIMIT 25"


def top_merchants(spark, sf_dir):
    return entities.heavy_hitters(transactions(spark, sf_dir), "merchant_id", 10)


TOP_MERCHANTS = "WITH " + TXN_SQL + " SELECT merchant_id, count(*) AS n FROM txn GROUP BY 1 ORDER BY n DESC, merchant_id LIMIT 10"

QUERIES = {
    "window_profiles": window_profiles, "profile_drift": profile_drift, "pane_windows": pane_windows, "loaded_window": loaded_window, "transactions_of_days": transactions_of_days,
    "filtered_list_flags": filtered_list_flags, "top_users": top_users, "top_merchants": top_merchants,
}
ORACLE = {
    "window_profiles": WINDOW_PROFILES, "profile_drift": PROFILE_DRIFT, "pane_windows": PANE_WINDOWS, "loaded_window": LOADED_WINDOW, "transactions_of_days": TRANSACTIONS_OF_DAYS,
    "filtered_list_flags": FILTERED_LIST_FLAGS, "top_users": TOP_USERS, "top_merchants": TOP_MERCHANTS,
}
