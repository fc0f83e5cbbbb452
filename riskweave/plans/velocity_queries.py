"""Queries over trailing windows and entity facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities, features, snapshots, velocity
from .views import TXN_SQL, table, transactions


def _round(df, places, *names):
    return df.withColumns({n: F.round(n, places) for n in names})


HOURS = (1, 6, 24, 168)
_HOUR_US = 3_600_000_000


def velocity_windows(spark, sf_dir):
    t = transactions(spark, sf_dir).select("transaction_id", "timestamp", "user_id", "amount", "merchant_id")
    out = velocity.windowed_features(t, HOURS)
    names = [f"{c}_{h}h" for h in HOURS for c in ("txn_count", "txn_amount", "avg_amount", "unique_merchants")]
    out = out.select("transaction_id", *names)
    return _round(out, 8, *[n for n in names if "amount" in n])


def _frame(name, us, key="user_id"):
    return f"{name} AS (PARTITION BY {key} ORDER BY us RANGE BETWEEN {us} PRECEDING AND 1 PRECEDING)"


def _distinct(col, w):
    return f"len(list_distinct(list_filter(coalesce(list({col}) OVER {w}, []), lambda x: x IS NOT NULL)))"


VELOCITY_WINDOWS = (
    "WITH " + TXN_SQL + " SELECT transaction_id, "
    + ", ".join(
        f"count(*) OVER w{h} AS txn_count_{h}h, round(coalesce(sum(amount) OVER w{h}, 0), 8) AS txn_amount_{h}h, "
        f"round(coalesce(avg(amount) OVER w{h}, 0), 8) AS avg_amount_{h}h, {_distinct('merchant_id', f'w{h}')} AS unique_merchants_{h}h"
        for h in HOURS
    )
    + " FROM txn WINDOW " + ", ".join(_frame(f"w{h}", h * _HOUR_US) for h in HOURS)
)


def velocity_ratios(spark, sf_dir):
    t = transactions(spark, sf_dir).select("transaction_id", "timestamp", "user_id", "amount", "merchant_id")
    out = velocity.velocity_features(t)
    return _round(
        out.select("transaction_id", "txn_count_ratio_1h_24h", "txn_amount_ratio_1h_24h"), 6,
        "txn_count_ratio_1h_24h", "txn_amount_ratio_1h_24h",
    )


VELOCITY_RATIOS = (
    "WITH " + TXN_SQL + """, f AS (SELECT transaction_id, count(*) OVER w1 AS c1, count(*) OVER w24 AS c24,
  coalesce(sum(amount) OVER w1, 0) AS a1, coalesce(sum(amount) OVER w24, 0) AS a24 FROM txn WINDOW """
    + _frame("w1", _HOUR_US) + ", " + _frame("w24", 24 * _HOUR_US) + """)
SELECT transaction_id, round(c1 / CASE WHEN c24 = 0 THEN 1 ELSE c24 END, 6) AS txn_count_ratio_1h_24h,
  round(a1 / CASE WHEN a24 = 0 THEN 1 ELSE a24 END, 6) AS txn_amount_ratio_1h_24h FROM f"""
)


def user_baseline(spark, sf_dir):
    out = velocity.user_baseline(transactions(spark, sf_dir))
    return _round(out, 8, "avg_amount", "std_amount")


USER_BASELINE = "WITH " + TXN_SQL + """
SELECT user_id, count(*) AS txn_count, round(avg(amount), 8) AS avg_amount, round(stddev_samp(amount), 8) AS std_amount,
  grouping(user_id) = 1 AS is_global FROM txn GROUP BY GROUPING SETS ((user_id), ())"""


def user_deviation(spark, sf_dir):
    """Baselines known on 3 January, applied to every transaction: users who first appear later get the global one."""
    t = transactions(spark, sf_dir).select("transaction_id", "timestamp", "user_id", "amount")
    base = velocity.user_baseline(t.filter(F.col("timestamp") < F.lit("2024-01-03").cast("timestamp")))
    out = velocity.amount_vs_user(t, base)
    return _round(out.select("transaction_id", "amount_vs_user_avg"), 4, "amount_vs_user_avg")


USER_DEVIATION = "WITH " + TXN_SQL + """,
early AS (SELECT * FROM txn WHERE "timestamp" < TIMESTAMP '2024-01-03'),
g AS (SELECT avg(amount) AS m, stddev_samp(amount) AS s FROM early),
u AS (SELECT user_id, avg(amount) AS m, stddev_samp(amount) AS s, 1 AS hit FROM early GROUP BY user_id)
SELECT transaction_id, round((amount - CASE WHEN hit = 1 THEN u.m ELSE g.m END)
  / CASE WHEN CASE WHEN hit = 1 THEN u.s ELSE g.s END > 0 THEN CASE WHEN hit = 1 THEN u.s ELSE g.s END ELSE 1 END, 4) AS amount_vs_user_avg
FROM txn LEFT JOIN u USING (user_id), g"""


def _grid_input(spark, sf_dir):
    t = transactions(spark, sf_dir)
    tid = F.col("transaction_id")
    return t.select(
        "transaction_id", "timestamp", "user_id", "amount", "merchant_id",
        F.concat(F.lit("r"), (tid % 41).cast("string")).alias("recipient_id"),
        F.concat(F.lit("ip"), (tid % 31).cast("string")).alias("ip_address"),
        (tid % 13 == 0).alias("is_failed"), (tid % 17 == 0).alias("is_declined"),
    )


def velocity_grid(spark, sf_dir):
    out = velocity.velocity_grid(_grid_input(spark, sf_dir))
    names = [c for c in out.columns if c.rsplit("_", 1)[-1] in velocity.GRID_WINDOWS]
    out = out.select("transaction_id", *names)
    return _round(out, 8, *[n for n in names if n.startswith("amount_")])


VELOCITY_GRID = (
    "WITH " + TXN_SQL + """, x AS (SELECT transaction_id, us, user_id, amount, merchant_id, 'r' || (transaction_id % 41) AS recipient_id,
  'ip' || (transaction_id % 31) AS ip_address, transaction_id % 13 = 0 AS is_failed, transaction_id % 17 = 0 AS is_declined FROM txn)
SELECT transaction_id, """
    + ", ".join(
        f"count(*) OVER w{w} AS txn_count_{w}, round(coalesce(sum(amount) OVER w{w}, 0), 8) AS amount_sum_{w}, "
        f"round(coalesce(avg(amount) OVER w{w}, 0), 8) AS amount_avg_{w}, round(coalesce(max(amount) OVER w{w}, 0), 8) AS amount_max_{w}, "
        f"{_distinct('merchant_id', 'w' + w)} AS unique_merchants_{w}, {_distinct('recipient_id', 'w' + w)} AS unique_recipients_{w}, "
        f"{_distinct('ip_address', 'w' + w)} AS unique_ips_{w}, coalesce(sum(is_failed::INT) OVER w{w}, 0)::BIGINT AS failed_attempts_{w}, "
        f"coalesce(sum(is_declined::INT) OVER w{w}, 0)::BIGINT AS declined_count_{w}"
        for w in velocity.GRID_WINDOWS
    )
    + " FROM x WINDOW " + ", ".join(_frame(f"w{w}", s * 1_000_000) for w, s in velocity.GRID_WINDOWS.items())
)


def online_velocity(spark, sf_dir):
    t = transactions(spark, sf_dir).select("transaction_id", "timestamp", "user_id", "amount", "merchant_id", "device_id")
    return online_columns(velocity.serving_velocity(t))


def online_columns(out):
    names = [c for c in out.columns if c.startswith(("user_txn", "user_unique", "device_txn", "device_unique"))]
    return _round(out.select("transaction_id", *names), 4, *[n for n in names if "amount" in n])


def _online_sql():
    user, device = [], []
    for w, s in velocity.SERVING_WINDOWS.items():
        new = f"h.us > t.us - {s * 1_000_000}"
        user.append(
            f"count(h.us) FILTER ({new}) AS user_txn_count_{w}, round(coalesce(sum(h.amount) FILTER ({new}), 0), 4) AS user_txn_amount_{w}, "
            f"count(DISTINCT h.merchant_id) FILTER ({new}) AS user_unique_merchants_{w}"
        )
        device.append(
            f"count(h.us) FILTER ({new}) AS device_txn_count_{w}, count(DISTINCT h.user_id) FILTER ({new}) AS device_unique_users_{w}"
        )
    before = "(h.us < t.us OR (h.us = t.us AND h.transaction_id < t.transaction_id))"
    return (
        "WITH " + TXN_SQL
        + f", u AS (SELECT t.transaction_id, {', '.join(user)} FROM txn t LEFT JOIN txn h ON h.user_id = t.user_id AND {before} GROUP BY ALL)"
        + f", d AS (SELECT t.transaction_id, {', '.join(device)} FROM txn t LEFT JOIN txn h ON h.device_id = t.device_id AND {before} GROUP BY ALL)"
        + " SELECT * FROM u JOIN d USING (transaction_id)"
    )


ONLINE_VELOCITY = _online_sql()


def user_history(spark, sf_dir):
    t = transactions(spark, sf_dir).select("transaction_id", "timestamp", "user_id", "amount")
    out = velocity.user_history(t).select(
        "transaction_id", "total_lifetime_transactions", "total_lifetime_amount", "avg_transaction_amount",
        "days_since_last_transaction", "transaction_frequency_weekly",
    )
    return _round(out, 8, "total_lifetime_amount", "avg_transaction_amount", "transaction_frequency_weekly")


USER_HISTORY = "WITH " + TXN_SQL + """, h AS (SELECT transaction_id, us, count(*) OVER w AS n, coalesce(sum(amount) OVER w, 0) AS a,
  max(us) OVER w AS last_us, min(us) OVER w AS first_us FROM txn
  WINDOW w AS (PARTITION BY user_id ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT transaction_id, n AS total_lifetime_transactions, round(a, 8) AS total_lifetime_amount,
  round(CASE WHEN n > 0 THEN a / n END, 8) AS avg_transaction_amount,
  floor((us - last_us) / 86400000000.0::DOUBLE)::BIGINT AS days_since_last_transaction,
  round(CASE WHEN us > first_us THEN n / greatest((us - first_us) / 604800000000.0::DOUBLE, 1.0) END, 8) AS transaction_frequency_weekly
FROM h"""


def rolling_amount(spark, sf_dir):
    t = transactions(spark, sf_dir).select("transaction_id", "timestamp", "user_id", "amount")
    out = velocity.rolling_amount_profile(t).select("transaction_id", "avg_amount_30d", "std_amount_30d")
    return _round(_round(out, 8, "avg_amount_30d"), 5, "std_amount_30d")


ROLLING_AMOUNT = (
    "WITH " + TXN_SQL + " SELECT transaction_id, round(avg(amount) OVER w, 8) AS avg_amount_30d, "
    "round(stddev_samp(amount) OVER w, 5) AS std_amount_30d FROM txn WINDOW " + _frame("w", 30 * 24 * _HOUR_US)
)


def devices_last_30d(spark, sf_dir):
    t = transactions(spark, sf_dir).select("transaction_id", "timestamp", "user_id", "device_id")
    return entities.devices_per_user(t).select("transaction_id", "devices_last_30d")


DEVICES_LAST_30D = (
    "WITH " + TXN_SQL + f" SELECT transaction_id, greatest(1, {_distinct('device_id', 'w')}) AS devices_last_30d FROM txn WINDOW "
    + _frame("w", 30 * 24 * _HOUR_US)
)


def shared_devices(spark, sf_dir):
    t = transactions(spark, sf_dir).select("transaction_id", "user_id", "device_id")
    return entities.with_sharing(t).select("transaction_id", "shared_devices_count")


SHARED_DEVICES = "WITH " + TXN_SQL + """, s AS (SELECT device_id, count(DISTINCT user_id) AS shared_devices_count FROM txn GROUP BY 1)
SELECT transaction_id, shared_devices_count FROM txn JOIN s USING (device_id)"""


def merchant_rates(spark, sf_dir):
    t = transactions(spark, sf_dir).select(
        "merchant_id", "timestamp", "is_fraud", (F.col("transaction_id") % 19 == 0).cast("int").alias("is_chargeback"),
        (F.col("transaction_id") % 23 == 0).cast("int").alias("is_complaint"),
    )
    out = entities.merchant_rates(t, F.lit("2024-02-01").cast("timestamp"))
    return _round(out, 6, "merchant_fraud_rate", "merchant_chargeback_rate", "merchant_complaint_rate")


MERCHANT_RATES = "WITH " + TXN_SQL + """
SELECT merchant_id, count(*) AS merchant_transaction_count,
  floor((epoch_us(TIMESTAMP '2024-02-01') - min(us)) / 86400000000.0::DOUBLE)::BIGINT AS merchant_age_days,
  round(avg(is_fraud), 6) AS merchant_fraud_rate, round(avg((transaction_id % 19 = 0)::INT), 6) AS merchant_chargeback_rate,
  round(avg((transaction_id % 23 = 0)::INT), 6) AS merchant_complaint_rate FROM txn GROUP BY merchant_id"""


def entity_frequency(spark, sf_dir):
    t = transactions(spark, sf_dir)
    kinds = [("user", "user_id"), ("merchant", "merchant_id"), ("device", "device_id")]
    parts = [
        entities.entity_frequency(t, c, 60).select(F.lit(k).alias("entity_type"), F.col(c).cast("string").alias("entity_id"), "n")
        for k, c in kinds
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ENTITY_FREQUENCY = "WITH " + TXN_SQL + " UNION ALL ".join(
    f" SELECT '{k}' AS entity_type, {c}::VARCHAR AS entity_id, count(*) AS n FROM txn GROUP BY {c} HAVING count(*) >= 60"
    for k, c in (("user", "user_id"), ("merchant", "merchant_id"), ("device", "device_id"))
)


def cooccurrence(spark, sf_dir):
    t = transactions(spark, sf_dir).select("user_id", "merchant_id")
    return _round(entities.cooccurrence(t, "user_id", "merchant_id", 50), 6, "weight")


COOCCURRENCE = "WITH " + TXN_SQL + """,
fu AS (SELECT user_id FROM txn GROUP BY 1 HAVING count(*) >= 50), fm AS (SELECT merchant_id FROM txn GROUP BY 1 HAVING count(*) >= 50)
SELECT user_id, merchant_id, count(*) AS n, round(ln(1 + count(*)), 6) AS weight FROM txn
WHERE user_id IN (SELECT user_id FROM fu) AND merchant_id IN (SELECT merchant_id FROM fm) GROUP BY 1, 2"""


def list_flags(spark, sf_dir):
    """Blocked users are customers with a negative balance; suppliers' numbers block devices."""
    t = transactions(spark, sf_dir).select(
        "transaction_id", "user_id", "device_id", "merchant_id",
        F.when(F.col("transaction_id") % 37 == 0, "XX").otherwise("NG").alias("location_country"),
    )
    users = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey")
    devices = table(spark, sf_dir, "supplier").select("s_suppkey")
    trusted = table(spark, sf_dir, "nation").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("m"))
    out = entities.with_list_flags(
        t, blocked_users=users, blocked_devices=devices, trusted_merchants=trusted, sanctioned=("XX", "YY")
    )
    return out.select("transaction_id", "user_is_blocked", "device_is_blocked", "is_whitelisted_merchant", "is_sanctioned_country")


LIST_FLAGS = "WITH " + TXN_SQL + """
SELECT transaction_id, user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS user_is_blocked,
  device_id IN (SELECT s_suppkey FROM supplier) AS device_is_blocked,
  merchant_id IN (SELECT 'm' || n_nationkey FROM nation) AS is_whitelisted_merchant,
  transaction_id % 37 = 0 AS is_sanctioned_country FROM txn"""


def user_dimension(spark, sf_dir):
    t = transactions(spark, sf_dir).select("transaction_id", "user_id", "amount")
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment", "c_nationkey")
    return entities.add_dimension(t, users, "user_id").select("transaction_id", "c_mktsegment", "c_nationkey")


USER_DIMENSION = "WITH " + TXN_SQL + " SELECT transaction_id, c_mktsegment, c_nationkey FROM txn LEFT JOIN customer ON c_custkey = user_id"


_MONTH_START = 1_704_067_200_000_000  # 2024-01-01


def _snapshots(spark, sf_dir):
    t = transactions(spark, sf_dir)
    snaps = t.select(
        F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"),
        F.create_map(F.lit("amount"), F.col("amount")).alias("features"), "timestamp",
        (F.lit(3600) * (1 + F.col("transaction_id") % 48)).alias("ttl_seconds"),
    )
    requests = table(spark, sf_dir, "customer").select(
        F.lit("user").alias("entity_type"), F.col("c_custkey").cast("string").alias("entity_id"), "c_mktsegment",
        # spread over the month, so that most requests have snapshots still to come
        F.timestamp_micros(F.lit(_MONTH_START) + F.pmod(F.col("c_custkey") * 37, F.lit(720)) * F.lit(_HOUR_US)).alias("as_of"),
    )
    return snapshots.snapshot_lookup(requests, snaps)


def snapshot_lookup(spark, sf_dir):
    return _snapshots(spark, sf_dir).select("entity_id", "hit", F.element_at("features", "amount").alias("amount"))


_SNAP = TXN_SQL + f""", asked AS (SELECT c_custkey, c_mktsegment, {_MONTH_START} + (c_custkey * 37 % 720) * {_HOUR_US} AS asked_us FROM customer),
found AS (SELECT c_custkey::VARCHAR AS entity_id, c_mktsegment, coalesce(asked_us <= us + 3600 * (1 + transaction_id % 48) * 1000000, false) AS hit, amount
  FROM asked ASOF LEFT JOIN txn ON user_id = c_custkey AND asked_us >= us)"""
SNAPSHOT_LOOKUP = "WITH " + _SNAP + " SELECT entity_id, hit, CASE WHEN hit THEN amount END AS amount FROM found"


def snapshot_hit_rate(spark, sf_dir):
    return _round(snapshots.hit_statistics(_snapshots(spark, sf_dir), ["c_mktsegment"]), 6, "hit_rate")


SNAPSHOT_HIT_RATE = "WITH " + _SNAP + """ SELECT c_mktsegment, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses,
  round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM found GROUP BY 1"""


def snapshot_upsert(spark, sf_dir):
    """Snapshots written twice at equal times: the change wins; entities of the third user go."""
    t = transactions(spark, sf_dir).select(
        F.lit("user").alias("entity_type"), F.col("user_id").cast("string").alias("entity_id"),
        F.create_map(F.lit("amount"), F.col("amount")).alias("features"), "timestamp", F.lit(60).alias("ttl_seconds"), "transaction_id",
    )
    changes = t.filter("transaction_id % 2 = 0").withColumn("features", F.create_map(F.lit("amount"), F.lit(-1.0)))
    gone = t.filter("entity_id = '3'").select("entity_type", "entity_id")
    kept = snapshots.delete(snapshots.upsert(t.drop("transaction_id"), changes.drop("ttl_seconds", "transaction_id")), gone)
    return kept.select("entity_id", "ttl_seconds", F.element_at("features", "amount").alias("amount"), F.unix_micros("timestamp").alias("us"))


SNAPSHOT_UPSERT = "WITH " + TXN_SQL + """ SELECT user_id::VARCHAR AS entity_id, CASE WHEN arg_max(transaction_id, us) % 2 = 0 THEN 3600 ELSE 60 END::INT AS ttl_seconds,
  CASE WHEN arg_max(transaction_id, us) % 2 = 0 THEN -1.0 ELSE arg_max(amount, us) END AS amount, max(us) AS us FROM txn WHERE user_id <> 3 GROUP BY user_id"""


def category_ranking(spark, sf_dir):
    cats = features.fit_categories(transactions(spark, sf_dir), "merchant_id", 20)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(cats)], "position int, category string")


CATEGORY_RANKING = "WITH " + TXN_SQL + """
SELECT position, category FROM (SELECT row_number() OVER (ORDER BY count(*) DESC, merchant_id)::INT AS position, merchant_id AS category
  FROM txn GROUP BY merchant_id) WHERE position <= 20"""

QUERIES = {
    "velocity_windows": velocity_windows, "velocity_ratios": velocity_ratios, "user_baseline": user_baseline,
    "user_deviation": user_deviation, "velocity_grid": velocity_grid, "online_velocity": online_velocity,
    "user_history": user_history, "rolling_amount": rolling_amount, "devices_last_30d": devices_last_30d,
    "shared_devices": shared_devices, "merchant_rates": merchant_rates, "entity_frequency": entity_frequency,
    "cooccurrence": cooccurrence, "list_flags": list_flags, "user_dimension": user_dimension,
    "snapshot_lookup": snapshot_lookup, "snapshot_hit_rate": snapshot_hit_rate, "snapshot_upsert": snapshot_upsert, "category_ranking": category_ranking,
}
ORACLE = {
    "velocity_windows": VELOCITY_WINDOWS, "velocity_ratios": VELOCITY_RATIOS, "user_baseline": USER_BASELINE,
    "user_deviation": USER_DEVIATION, "velocity_grid": VELOCITY_GRID, "online_velocity": ONLINE_VELOCITY,
    "user_history": USER_HISTORY, "rolling_amount": ROLLING_AMOUNT, "devices_last_30d": DEVICES_LAST_30D,
    "shared_devices": SHARED_DEVICES, "merchant_rates": MERCHANT_RATES, "entity_frequency": ENTITY_FREQUENCY,
    "cooccurrence": COOCCURRENCE, "list_flags": LIST_FLAGS, "user_dimension": USER_DIMENSION,
    "snapshot_lookup": SNAPSHOT_LOOKUP, "snapshot_hit_rate": SNAPSHOT_HIT_RATE, "snapshot_upsert": SNAPSHOT_UPSERT, "category_ranking": CATEGORY_RANKING,
}
