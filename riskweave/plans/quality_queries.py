"""Queries over contracts, records and feature expressions."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import features, merging, quality, records
from ..operators.labels import between_dates
from ..schemas import LABEL_FIELDS, LABEL_SOURCES, MERCHANT_CATEGORIES, TRANSACTION_FIELDS, TRANSACTION_TYPES
from ..sources.messages import good_events, to_messages
from .views import LAB_SQL, PRED_SQL, TXN_SQL, labels, transactions


def contract_checks(spark, sf_dir):
    t = transactions(spark, sf_dir).select(
        "transaction_id", "timestamp", (F.col("amount") * 300).alias("amount"), "merchant_id", "merchant_category", "user_id", "device_type"
    )
    found = quality.TRANSACTION_CONTRACT.check(t).unionByName(quality.LABEL_CONTRACT.check(labels(spark, sf_dir)))
    return found.select("contract", "column", "check", "severity", "passed", F.round("value", 6).alias("value"))


def contract_statistics(spark, sf_dir):
    """Statistics of the user's own making as parts of a contract."""
    t = transactions(spark, sf_dir).select("amount", F.col("user_id").cast("double").alias("user"), (F.col("amount") * 2 + F.col("user_id")).alias("mix"))
    own = [merging.trimmed_mean("amount", 0.0, 400.0, share=0.1, bins=80, low=1.0, high=45.0), merging.correlation("amount", "mix", low=0.9), merging.correlation("amount", "user", high=0.5)]
    found = quality.DataContract("own", merged=own).check(t)
    return found.select("contract", "column", "check", "severity", "passed", F.round("value", 5).alias("value"))


CONTRACT_STATISTICS = "WITH " + TXN_SQL + """, b AS (SELECT greatest(-1, least(80, floor(amount * 80 / 400)))::INT AS bin, count(*) AS n, sum(amount) AS s FROM txn GROUP BY 1),
u AS (SELECT bin, n, s, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS a FROM b),
k AS (SELECT s / n AS m, greatest(0, least(upto, a - 0.1::DOUBLE * a) - greatest(upto - n, 0.1::DOUBLE * a)) AS kept FROM u),
v AS (SELECT 'amount' AS "column", 'trimmed_mean' AS "check", sum(m * kept) / sum(kept) AS value, 1.0 AS low, 45.0 AS high FROM k
  UNION ALL SELECT 'amount', 'correlation with mix', corr(amount, amount * 2 + user_id), 0.9, NULL FROM txn
  UNION ALL SELECT 'amount', 'correlation with user', corr(amount, user_id), NULL, 0.5 FROM txn)
SELECT 'own' AS contract, "column", "check", 'warning' AS severity, coalesce(value >= low, true) AND coalesce(value <= high, true) AS passed, round(value, 5) AS value FROM v"""


def _contract_sql():
    rows = [f"SELECT 'transactions' AS contract, '{c}' AS \"column\", 'required' AS \"check\", 'error' AS severity, true AS passed, NULL::DOUBLE AS value"
            for c in quality.TRANSACTION_CONTRACT.required_columns]
    rows += [f"SELECT 'labels', '{c}', 'required', 'error', true, NULL::DOUBLE" for c in quality.LABEL_CONTRACT.required_columns]
    rows += [
        "SELECT 'transactions', 'amount', 'type', 'error', true, NULL::DOUBLE",
        "SELECT 'transactions', 'merchant_id', 'type', 'error', true, NULL::DOUBLE",
        "SELECT 'transactions', 'user_id', 'type', 'error', false, NULL::DOUBLE",
        "SELECT 'labels', 'is_fraud', 'type', 'error', true, NULL::DOUBLE",
        "SELECT 'transactions', 'transaction_id', 'distinct', 'error', count(DISTINCT transaction_id) = count(*), (count(*) - count(DISTINCT transaction_id))::DOUBLE FROM txn",
        "SELECT 'transactions', 'amount', 'within_0_to_100000', 'error', min(amount*300) >= 0 AND max(amount*300) <= 100000, "
        "round(CASE WHEN min(amount*300) < 0 THEN min(amount*300) ELSE max(amount*300) END, 6) FROM txn",
        "SELECT 'transactions', 'timestamp', 'filled', 'error', avg((\"timestamp\" IS NULL)::INT) <= 0, avg((\"timestamp\" IS NULL)::INT) FROM txn",
        "SELECT 'labels', 'transaction_id', 'filled', 'error', avg((transaction_id IS NULL)::INT) <= 0, avg((transaction_id IS NULL)::INT) FROM lab",
        "SELECT 'labels', 'is_fraud', 'known_value', 'error', count(*) FILTER (is_fraud NOT IN (0, 1)) = 0, count(*) FILTER (is_fraud NOT IN (0, 1))::DOUBLE FROM lab",
    ]
    for c in ("transaction_id", "amount", "merchant_id", "merchant_category", "user_id", "device_type"):
        rows.append(f"SELECT 'transactions', '{c}', 'null_rate', 'warning', avg(({c} IS NULL)::INT) <= 0.05, round(avg(({c} IS NULL)::INT), 6) FROM txn")
    return "WITH " + PRED_SQL + LAB_SQL + " UNION ALL ".join(rows)


CONTRACT_CHECKS = _contract_sql()


def record_quarantine(spark, sf_dir):
    tid = F.col("transaction_id")
    raw = transactions(spark, sf_dir).withColumns(
        {
            "amount": F.col("amount") * 30000,
            "transaction_type": F.when(tid % 50 == 0, "gift").otherwise(F.col("transaction_type")),
            "user_id": F.when(tid % 77 == 0, F.lit(None)).otherwise(F.col("user_id")).cast("string"),
            "hour_of_day": tid % 26, "day_of_week": (tid % 9).cast("string"),
        }
    )
    checked = records.check_records(raw, TRANSACTION_FIELDS, "transaction")
    return checked.select(
        F.col("transaction_id").cast("long").alias("transaction_id"), "currency", "channel", "merchant_category", "device_type",
        F.concat_ws(",", "failed_fields").alias("failed_fields"),
    )


def _in(col, values):
    return f"{col} IN ({', '.join(repr(v) for v in values)})"


RECORD_QUARANTINE = "WITH " + TXN_SQL + f"""
SELECT transaction_id, 'NGN' AS currency, 'app' AS channel,
  CASE WHEN {_in('lower(merchant_category)', MERCHANT_CATEGORIES)} THEN lower(merchant_category) ELSE 'other' END AS merchant_category,
  CASE WHEN device_type IS NULL THEN NULL WHEN lower(device_type) IN ('mobile','desktop','tablet','unknown','pos') THEN lower(device_type) ELSE 'unknown' END AS device_type,
  concat_ws(',', CASE WHEN amount * 30000 > 10000000 THEN 'amount' END,
    CASE WHEN NOT {_in("CASE WHEN transaction_id % 50 = 0 THEN 'gift' ELSE transaction_type END", TRANSACTION_TYPES)} THEN 'transaction_type' END,
    CASE WHEN transaction_id % 77 = 0 THEN 'user_id' END, CASE WHEN transaction_id % 26 > 23 THEN 'hour_of_day' END,
    CASE WHEN transaction_id % 9 > 6 THEN 'day_of_week' END) AS failed_fields
FROM txn"""


def category_normalise(spark, sf_dir):
    tid = F.col("transaction_id")
    t = transactions(spark, sf_dir)
    kind = F.when(tid % 3 == 0, "Retail").when(tid % 3 == 1, "GAMING").otherwise(F.col("merchant_category"))
    source = F.when(tid % 4 == 0, "Chargeback").when(tid % 4 == 1, "USER_REPORT").when(tid % 4 == 2, "rumour")
    return t.select(
        "transaction_id", records.merchant_category(kind).alias("merchant_category"),
        records.device_type(F.col("device_type")).alias("device_type"), records.label_source(source).alias("label_source"),
    )


CATEGORY_NORMALISE = "WITH " + TXN_SQL + f""", x AS (SELECT transaction_id, device_type,
  CASE transaction_id % 3 WHEN 0 THEN 'Retail' WHEN 1 THEN 'GAMING' ELSE merchant_category END AS k,
  CASE transaction_id % 4 WHEN 0 THEN 'Chargeback' WHEN 1 THEN 'USER_REPORT' WHEN 2 THEN 'rumour' END AS s FROM txn)
SELECT transaction_id, CASE WHEN {_in('lower(k)', MERCHANT_CATEGORIES)} THEN lower(k) ELSE 'other' END AS merchant_category,
  CASE WHEN device_type IS NULL THEN NULL WHEN lower(device_type) IN ('mobile','desktop','tablet','unknown','pos') THEN lower(device_type) ELSE 'unknown' END AS device_type,
  CASE WHEN {_in('lower(s)', LABEL_SOURCES)} THEN lower(s) ELSE 'unknown' END AS label_source FROM x"""


def label_records(spark, sf_dir):
    lab = labels(spark, sf_dir).withColumn(
        "is_fraud", F.when(F.col("transaction_id") % 41 == 0, 2).otherwise(F.col("is_fraud"))
    )
    good, bad = records.split_records(lab, LABEL_FIELDS, "label")
    return good.groupBy("label_source").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("valid")).unionByName(
        bad.groupBy("label_source").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("quarantined"))
    )


LABEL_RECORDS = "WITH " + TXN_SQL + LAB_SQL + f"""
SELECT CASE WHEN {_in('lower(label_source)', LABEL_SOURCES)} THEN lower(label_source) ELSE 'unknown' END AS label_source, count(*) AS n,
  CASE WHEN transaction_id % 41 = 0 THEN 'quarantined' ELSE 'valid' END AS part FROM lab GROUP BY ALL"""


def date_range(spark, sf_dir):
    t = transactions(spark, sf_dir)
    part = between_dates(t, "timestamp", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))
    return part.select("transaction_id", F.date_format("timestamp", "yyyy-MM-dd").alias("day"))


DATE_RANGE = "WITH " + TXN_SQL + """ SELECT transaction_id, strftime("timestamp", '%Y-%m-%d') AS day FROM txn
WHERE "timestamp" >= TIMESTAMP '2024-01-05' AND "timestamp" < TIMESTAMP '2024-01-12'"""


def time_features(spark, sf_dir):
    t = transactions(spark, sf_dir)
    exprs = features.time_features(F.col("timestamp"))
    places = {"hour_sin", "hour_cos"}
    return t.select("transaction_id", *[(F.round(e, 6) if n in places else e).alias(n) for n, e in exprs.items()])


_TIME = """hour("timestamp")::INT AS hour, (isodow("timestamp") - 1)::INT AS day_of_week,
  CASE WHEN isodow("timestamp") >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour("timestamp") >= 22 OR hour("timestamp") < 6 THEN 1 ELSE 0 END AS is_night,
  round(sin(2*pi()*hour("timestamp")/24), 6) AS hour_sin, round(cos(2*pi()*hour("timestamp")/24), 6) AS hour_cos"""
TIME_FEATURES = "WITH " + TXN_SQL + f" SELECT transaction_id, {_TIME} FROM txn"


def amount_features(spark, sf_dir):
    t = transactions(spark, sf_dir).withColumn("amount", F.col("amount") - 20)
    fit = features.fit_amount(t)
    return t.select("transaction_id", *[
        (e if n == "amount_high" else F.round(e, 5)).alias(n) for n, e in features.amount_features(F.col("amount"), fit).items()
    ])


AMOUNT_FEATURES = "WITH " + TXN_SQL + """, x AS (SELECT transaction_id, amount - 20 AS a FROM txn),
f AS (SELECT avg(a) AS m, stddev_samp(a) AS s, quantile_cont(a, 0.95) AS p FROM x)
SELECT transaction_id, round(least(greatest(a, 0), 1000000.0), 5) AS amount, round(ln(1 + greatest(a, 0)), 5) AS amount_log,
  round((a - m) / s, 5) AS amount_zscore, CASE WHEN a > p THEN 1 ELSE 0 END AS amount_high FROM x, f"""


def one_hot(spark, sf_dir):
    """How often each flag is set, the top three categories of two columns encoded."""
    t = transactions(spark, sf_dir)
    exprs = {}
    for c in ("merchant_category", "device_type"):
        exprs |= features.one_hot(c, features.fit_categories(t, c, 3))
    wide = t.agg(*[F.sum(e).alias(n) for n, e in exprs.items()])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("n")) for n in exprs])))


def _one_hot_sql(column):
    return f"""SELECT CASE WHEN r <= 3 THEN '{column}_' || k ELSE '{column}_other' END AS flag, sum(n)::BIGINT AS n
  FROM (SELECT {column} AS k, count(*) AS n, CASE WHEN {column} IS NULL THEN 99 ELSE row_number() OVER (ORDER BY {column} IS NULL, count(*) DESC, {column}) END AS r
  FROM txn GROUP BY {column}) GROUP BY 1"""


ONE_HOT = "WITH " + TXN_SQL + " " + _one_hot_sql("merchant_category") + " UNION ALL " + _one_hot_sql("device_type")


def risk_features(spark, sf_dir):
    tid = F.col("transaction_id")
    t = transactions(spark, sf_dir).select(
        "transaction_id", "is_vpn", "is_new_device", "is_emulator", "previous_fraud_flags", "account_age_days",
        (tid % 30).alias("failed_logins_24h"), F.when(tid % 6 != 0, tid % 700).alias("txn_count_1h"), (tid % 40).alias("txn_count_24h"),
        (tid * 1.0e6).alias("amount_sum_24h"), (tid % 60).alias("shared_devices_count"), ((tid % 150) / 100).alias("merchant_fraud_rate"),
        (tid % 25).alias("chargebacks_90d"), (tid % 2 == 0).alias("is_verified"),
    )
    exprs = {}
    for group in (features.device_features, features.user_features, features.velocity_columns, features.network_features):
        exprs |= group(t.columns)
    rounded = {"device_risk", "account_age_log", "txn_count_1h_log", "txn_count_24h_log", "amount_sum_24h", "merchant_fraud_rate"}
    return t.select("transaction_id", *[(F.round(e, 5) if n in rounded else e).alias(n) for n, e in exprs.items()])


RISK_FEATURES = "WITH " + TXN_SQL + """, x AS (SELECT transaction_id, is_vpn, is_new_device, is_emulator, previous_fraud_flags, account_age_days,
  transaction_id % 30 AS fl, CASE WHEN transaction_id % 6 <> 0 THEN transaction_id % 700 END AS c1, transaction_id % 40 AS c24,
  transaction_id * 1e6 AS a24, transaction_id % 60 AS sd, (transaction_id % 150) / 100.0::DOUBLE AS mf, transaction_id % 25 AS cb, transaction_id % 2 = 0 AS ver FROM txn)
SELECT transaction_id, is_vpn::INT AS is_vpn, is_new_device::INT AS is_new_device, is_emulator::INT AS is_emulator,
  least(fl, 20) AS failed_logins, CASE WHEN fl > 0 THEN 1 ELSE 0 END AS has_failed_logins,
  round((is_vpn::INT + is_new_device::INT + is_emulator::INT) / 3.0::DOUBLE, 5) AS device_risk,
  least(account_age_days, 3650) AS account_age, round(ln(1 + account_age_days), 5) AS account_age_log,
  CASE WHEN account_age_days < 30 THEN 1 ELSE 0 END AS is_new_account, ver::INT AS is_verified,
  least(previous_fraud_flags, 10) AS fraud_flags, CASE WHEN previous_fraud_flags > 0 THEN 1 ELSE 0 END AS has_fraud_history,
  least(cb, 20) AS chargebacks_90d, least(coalesce(c1, 0), 500) AS txn_count_1h, round(ln(1 + coalesce(c1, 0)), 5) AS txn_count_1h_log,
  least(c24, 500) AS txn_count_24h, round(ln(1 + c24), 5) AS txn_count_24h_log, round(least(a24, 1e7), 5) AS amount_sum_24h,
  CASE WHEN c1 > 5 THEN 1 ELSE 0 END AS velocity_breach_1h, CASE WHEN c24 > 20 THEN 1 ELSE 0 END AS velocity_breach_24h,
  least(sd, 50) AS shared_devices, CASE WHEN sd > 0 THEN 1 ELSE 0 END AS has_shared_device,
  round(least(mf, 1.0), 5) AS merchant_fraud_rate, CASE WHEN mf > 0.1 THEN 1 ELSE 0 END AS high_risk_merchant FROM x"""


def feature_matrix(spark, sf_dir):
    """Fit on the whole table, transform the whole table."""
    t = transactions(spark, sf_dir).drop("merchant_category")
    out = features.RiskFeatures().fit_transform(t)
    rounded = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    return out.withColumns({n: F.round(n, 5) for n in rounded})


FEATURE_MATRIX = "WITH " + TXN_SQL + f""", f AS (SELECT avg(amount) AS m, stddev_samp(amount) AS s, quantile_cont(amount, 0.95) AS p FROM txn)
SELECT transaction_id, {_TIME.replace(', 6)', ', 5)')}, round(amount, 5) AS amount, round(ln(1 + amount), 5) AS amount_log, round((amount - m) / s, 5) AS amount_zscore,
  CASE WHEN amount > p THEN 1 ELSE 0 END AS amount_high,
  CASE WHEN device_type = 'mobile' THEN 1 ELSE 0 END AS device_type_mobile, CASE WHEN device_type = 'Tablet' THEN 1 ELSE 0 END AS device_type_Tablet,
  CASE WHEN device_type = 'watch' THEN 1 ELSE 0 END AS device_type_watch, CASE WHEN device_type IS NULL THEN 1 ELSE 0 END AS device_type_other,
  is_vpn::INT AS is_vpn, is_new_device::INT AS is_new_device, is_emulator::INT AS is_emulator,
  round((is_vpn::INT + is_new_device::INT + is_emulator::INT) / 3.0::DOUBLE, 5) AS device_risk,
  account_age_days AS account_age, round(ln(1 + account_age_days), 5) AS account_age_log, CASE WHEN account_age_days < 30 THEN 1 ELSE 0 END AS is_new_account,
  previous_fraud_flags AS fraud_flags, CASE WHEN previous_fraud_flags > 0 THEN 1 ELSE 0 END AS has_fraud_history FROM txn, f"""


def event_messages(spark, sf_dir):
    """Every event as a JSON message and back; a tenth of the messages is cut off in the middle."""
    t = transactions(spark, sf_dir).select(
        F.col("transaction_id").cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("user_id"),
        "merchant_id", "merchant_category", "amount", F.col("device_id").cast("string").alias("device_id"),
        F.coalesce("device_type", F.lit("none")).alias("device_type"), F.lit("NG").alias("location_country"), "timestamp",
    )
    messages = to_messages(t).withColumn(
        "value", F.when(F.col("key").cast("long") % 10 == 3, F.expr("left(value, 40)")).otherwise(F.col("value"))
    )
    back = good_events(messages)
    return back.select(
        F.col("transaction_id").cast("long").alias("transaction_id"), "merchant_id", "device_type", "amount",
        F.unix_micros("timestamp").alias("us"), F.size("metadata").alias("n_metadata"),
    )


EVENT_MESSAGES = "WITH " + TXN_SQL + """ SELECT transaction_id, merchant_id, coalesce(device_type, 'none') AS device_type, amount, us, 0 AS n_metadata
FROM txn WHERE transaction_id % 10 <> 3"""

QUERIES = {
    "contract_checks": contract_checks, "contract_statistics": contract_statistics, "record_quarantine": record_quarantine, "category_normalise": category_normalise,
    "label_records": label_records, "date_range": date_range, "time_features": time_features, "amount_features": amount_features,
    "one_hot": one_hot, "risk_features": risk_features, "feature_matrix": feature_matrix, "event_messages": event_messages,
}
ORACLE = {
    "contract_checks": CONTRACT_CHECKS, "contract_statistics": CONTRACT_STATISTICS, "record_quarantine": RECORD_QUARANTINE, "category_normalise": CATEGORY_NORMALISE,
    "label_records": LABEL_RECORDS, "date_range": DATE_RANGE, "time_features": TIME_FEATURES, "amount_features": AMOUNT_FEATURES,
    "one_hot": ONE_HOT, "risk_features": RISK_FEATURES, "feature_matrix": FEATURE_MATRIX, "event_messages": EVENT_MESSAGES,
}
