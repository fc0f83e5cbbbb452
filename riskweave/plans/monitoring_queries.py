"""Queries over drift, alerts and retraining."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import alerts as A
from ..operators import drift as D
from ..operators import evaluation as E
from ..operators import quality
from ..operators import retrain as R
from ..session import cut_lineage
from .evaluation_queries import scored
from .views import PRED_SQL, predictions

AS_OF = datetime(2024, 2, 1)
FEATURES = ["amount", "user_id", "device_id", "level", "flat"]


def _round(df, places, *names):
    return df.withColumns({n: F.round(n, places) for n in names})


def _sides(spark, sf_dir):
    """Reference before 24 January, current after it, with one shifted and one constant column."""
    p = predictions(spark, sf_dir)
    border = F.col("timestamp") < F.lit("2024-01-24").cast("timestamp")
    x = p.select(
        "timestamp", "amount", "user_id", "device_id", F.when(border, F.col("amount")).otherwise(F.col("amount") * 10).alias("level"),
        F.lit(1.0).alias("flat"), F.when(border, F.col("fraud_probability")).otherwise(F.sqrt("fraud_probability")).alias("score"),
        (F.col("timestamp") < F.lit("2024-01-24").cast("timestamp")).alias("early"),
    )
    return x.filter("early").drop("early"), x.filter("not early").drop("early")


_X = PRED_SQL + """, x AS (SELECT "timestamp" < TIMESTAMP '2024-01-24' AS early, amount, user_id, device_id, fraud_probability FROM pred),
y AS (SELECT early, amount::DOUBLE AS amount, user_id::DOUBLE AS user_id, device_id::DOUBLE AS device_id, CASE WHEN early THEN amount ELSE amount * 10 END AS level,
  1.0::DOUBLE AS flat, CASE WHEN early THEN fraud_probability ELSE sqrt(fraud_probability) END AS score FROM x)"""


def _long(names):
    return ", v AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature, {c} AS value, early FROM y" for a, c in names) + ")"


_LONG = _X + _long([(f, f) for f in FEATURES])
_SCORE = _X + _long([("predictions", "score")])
_DECILES = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"

# bins of the reference's deciles and the counts of both sides, then the index
_PSI = f"""e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, {_DECILES}))) AS edges FROM v WHERE early GROUP BY feature),
b AS (SELECT feature, i, edges[i] AS lo, edges[i + 1] AS hi, i = len(edges) - 1 AS is_last, len(edges) - 1 AS nb FROM e, LATERAL (SELECT unnest(range(1, len(edges))) AS i)),
n AS (SELECT feature, count(*) FILTER (early) AS nr, count(*) FILTER (NOT early) AS nc FROM v GROUP BY feature),
h AS (SELECT b.feature, b.i, any_value(nb) AS nb, count(*) FILTER (v.early) AS r, count(*) FILTER (NOT v.early) AS c
  FROM b LEFT JOIN v ON v.feature = b.feature AND value >= lo AND (value < hi OR (is_last AND value <= hi)) GROUP BY 1, 2),
s AS (SELECT feature, (r + 1e-10::DOUBLE) / (nr + 1e-10::DOUBLE * nb) AS pr, (c + 1e-10::DOUBLE) / (nc + 1e-10::DOUBLE * nb) AS pc FROM h JOIN n USING (feature)),
psi AS (SELECT feature, coalesce(sum((pc - pr) * ln(pc / pr)), 0) AS psi FROM n LEFT JOIN s USING (feature) GROUP BY feature)"""
# exact p-values by the share of lattice paths that leave the band, diagonal by diagonal; large samples by the limiting law
_KS = """d AS (SELECT feature, value, count(*) FILTER (early) AS r, count(*) FILTER (NOT early) AS c FROM v GROUP BY 1, 2),
k0 AS (SELECT feature, sum(r) OVER w AS r, sum(c) OVER w AS c, sum(r) OVER a AS nr, sum(c) OVER a AS nc FROM d
  WINDOW w AS (PARTITION BY feature ORDER BY value), a AS (PARTITION BY feature)),
k1 AS MATERIALIZED (SELECT feature, max(abs(r / nr - c / nc)) AS ks, max(abs(r * nc - c * nr))::BIGINT AS h,
  max(nr)::BIGINT AS nr, max(nc)::BIGINT AS nc FROM k0 GROUP BY feature),
k2 AS (SELECT *, ks * sqrt(nr::DOUBLE * nc / (nr + nc)) AS lam FROM k1),
paths(feature, m, n, h, s, lo, p) USING KEY (feature) AS (
  SELECT feature, least(nr, nc), greatest(nr, nc), h, 0::BIGINT, 0::BIGINT, [0.0::DOUBLE] FROM k1 WHERE greatest(nr, nc) <= 10000 AND h > 0
  UNION SELECT feature, m, n, h, s + 1, first, list_transform(range(first, last + 1),
    lambda i: coalesce(p[i - lo], 1.0) * i / (s + 1) + coalesce(p[i - lo + 1], 1.0) * (s + 1 - i) / (s + 1))
  FROM (SELECT *, greatest(0, s + 1 - n, floor(((s + 1) * m - h) / (m + n))::BIGINT + 1) AS first,
    least(m, s + 1, ceil(((s + 1) * m + h) / (m + n))::BIGINT - 1) AS last FROM paths WHERE s < m + n)),
ks AS (SELECT feature, ks, CASE WHEN h = 0 THEN 1.0::DOUBLE WHEN s = m + n THEN least(1.0, coalesce(p[m - lo + 1], 1.0)) WHEN lam < 0.1 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101),
  lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * k * k * lam * lam))))) END AS p FROM k2 LEFT JOIN (SELECT feature, m, n, s, lo, p FROM paths) USING (feature))"""


def psi(spark, sf_dir):
    ref, cur = _sides(spark, sf_dir)
    return _round(D.psi(D.melt(ref, FEATURES), D.melt(cur, FEATURES)), 6, "psi")


PSI = "WITH " + _LONG + ", " + _PSI + " SELECT feature, round(psi, 6) AS psi FROM psi"


def ks(spark, sf_dir):
    ref, cur = _sides(spark, sf_dir)
    return _round(D.ks(D.melt(ref, FEATURES), D.melt(cur, FEATURES)), 6, "ks_statistic", "ks_pvalue")


KS = "WITH RECURSIVE " + _LONG + ", " + _KS + " SELECT feature, round(ks, 6) AS ks_statistic, round(p, 6)::DOUBLE AS ks_pvalue FROM ks"


def kl(spark, sf_dir):
    ref, cur = _sides(spark, sf_dir)
    return _round(D.kl(D.melt(ref, FEATURES), D.melt(cur, FEATURES)), 6, "kl_divergence")


_KL = """g AS (SELECT feature, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo, CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi,
  count(*) FILTER (early) AS nr, count(*) FILTER (NOT early) AS nc FROM v GROUP BY feature),
q AS (SELECT feature, lo, hi, nr, nc, i, lo + (i - 1) * ((hi - lo) / 10) AS a, CASE WHEN i = 10 THEN hi ELSE lo + i * ((hi - lo) / 10) END AS z FROM g, (SELECT unnest(range(1, 11)) AS i)),
t AS (SELECT q.feature, i, count(*) FILTER (v.early) / (any_value(nr) * ((any_value(hi) - any_value(lo)) / 10)) + 1e-10::DOUBLE AS dr,
  count(*) FILTER (NOT v.early) / (any_value(nc) * ((any_value(hi) - any_value(lo)) / 10)) + 1e-10::DOUBLE AS dc
  FROM q LEFT JOIN v ON v.feature = q.feature AND value >= a AND (value < z OR (i = 10 AND value <= z)) GROUP BY 1, 2),
u AS (SELECT feature, dr / sum(dr) OVER (PARTITION BY feature) AS pr, dc / sum(dc) OVER (PARTITION BY feature) AS pc FROM t),
kl AS (SELECT feature, sum(pc * ln(pc / pr)) AS kl FROM u GROUP BY feature)"""
KL = "WITH " + _LONG + ", " + _KL + " SELECT feature, round(kl, 6) AS kl_divergence FROM kl"

_DRIFT = _LONG + ", " + _PSI + ", " + _KS + """, means AS (SELECT feature, avg(value) FILTER (early) AS ref_mean, avg(value) FILTER (NOT early) AS cur_mean FROM v GROUP BY feature),
drift AS (SELECT feature, CASE WHEN psi >= 0.2 THEN 'critical' WHEN psi >= 0.1 OR p < 0.05 THEN 'warning' ELSE 'none' END AS severity, psi, ks, p, ref_mean, cur_mean
  FROM psi JOIN ks USING (feature) JOIN means USING (feature))"""


def _drift(spark, sf_dir):
    return D.feature_drift(*_sides(spark, sf_dir), FEATURES)


def feature_drift(spark, sf_dir):
    out = D.drift_table(_drift(spark, sf_dir))
    return _round(out, 5, "statistic", "p_value", "ks_statistic", "ref_mean", "cur_mean")


FEATURE_DRIFT = "WITH RECURSIVE " + _DRIFT + """ SELECT 'feature' AS drift_type, feature, severity, round(psi, 5) AS statistic, 0.1::DOUBLE AS threshold, round(p, 5)::DOUBLE AS p_value,
  round(ks, 5) AS ks_statistic, round(ref_mean, 5) AS ref_mean, round(cur_mean, 5) AS cur_mean, severity <> 'none' AS is_drifted FROM drift"""


def prediction_drift(spark, sf_dir):
    out = D.drift_table(D.prediction_drift(*_sides(spark, sf_dir)))
    return _round(out, 5, "statistic", "kl_divergence", "ref_mean", "cur_mean")


PREDICTION_DRIFT = "WITH " + _SCORE + ", " + _PSI + ", " + _KL + """, means AS (SELECT feature, avg(value) FILTER (early) AS ref_mean, avg(value) FILTER (NOT early) AS cur_mean FROM v GROUP BY feature),
o AS (SELECT *, CASE WHEN psi >= 0.2 OR kl >= 0.2 THEN 'critical' WHEN psi >= 0.1 OR kl >= 0.1 THEN 'warning' ELSE 'none' END AS severity FROM psi JOIN kl USING (feature) JOIN means USING (feature))
SELECT 'prediction' AS drift_type, feature, severity, round(psi, 5) AS statistic, 0.1::DOUBLE AS threshold, round(kl, 5) AS kl_divergence, round(ref_mean, 5) AS ref_mean,
  round(cur_mean, 5) AS cur_mean, severity <> 'none' AS is_drifted FROM o"""


def drift_gate(spark, sf_dir):
    gate = D.drift_gate(_drift(spark, sf_dir))
    return gate.select(F.concat_ws(",", "critical_features").alias("critical_features"), "passed")


DRIFT_GATE = "WITH RECURSIVE " + _DRIFT + """ SELECT coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (severity = 'critical'), '') AS critical_features,
  count(*) FILTER (severity = 'critical') = 0 AS passed FROM drift"""


def drifting_share(spark, sf_dir):
    return _round(D.drifting_share(_drift(spark, sf_dir)), 5, "psi", "drifting_features_pct")


DRIFTING_SHARE = "WITH RECURSIVE " + _DRIFT + """ SELECT round(max(psi), 5) AS psi, round(avg((severity <> 'none')::INT) * 100, 5) AS drifting_features_pct FROM drift"""


def drift_windows(spark, sf_dir):
    """Last week against the weeks before it."""
    p = predictions(spark, sf_dir).select("timestamp", "amount", "fraud_probability", "latency_ms")
    ref, cur = D.split_windows(p, datetime(2024, 1, 31), reference_days=21)
    return _round(D.feature_drift(ref, cur).select("feature", "severity", "statistic", "ks_statistic"), 5, "statistic", "ks_statistic")


DRIFT_WINDOWS = "WITH RECURSIVE " + PRED_SQL + """, y AS (SELECT "timestamp" < TIMESTAMP '2024-01-24' AS early, amount, fraud_probability, latency_ms FROM pred
  WHERE "timestamp" >= TIMESTAMP '2024-01-03' AND "timestamp" < TIMESTAMP '2024-01-31')""" + _long(
    [(c, c) for c in ("amount", "fraud_probability", "latency_ms")]) + ", " + _PSI + ", " + _KS + """
SELECT feature, CASE WHEN psi >= 0.2 THEN 'critical' WHEN psi >= 0.1 OR p < 0.05 THEN 'warning' ELSE 'none' END AS severity, round(psi, 5) AS statistic, round(ks, 5) AS ks_statistic
FROM psi JOIN ks USING (feature)"""


def feature_profile(spark, sf_dir):
    p = predictions(spark, sf_dir).select("amount", "account_age_days", "fraud_probability", "latency_ms")
    out = D.feature_profile(p)
    return _round(out, 5, *[c for c in out.columns if c != "feature"])


FEATURE_PROFILE = "WITH " + PRED_SQL + ", v AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c}::DOUBLE AS value FROM pred" for c in ("amount", "account_age_days", "fraud_probability", "latency_ms")
) + ") SELECT feature, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std, round(min(value), 5) AS min, round(max(value), 5) AS max, " + ", ".join(
    f"round(quantile_cont(value, {p / 100}), 5) AS p{p}" for p in D.PROFILE_PERCENTS
) + " FROM v GROUP BY feature"


def _all_alerts(spark, sf_dir):
    s = scored(spark, sf_dir)
    checks = quality.TRANSACTION_CONTRACT.check(
        predictions(spark, sf_dir).select("transaction_id", "timestamp", (F.col("amount") * 300).alias("amount"), "merchant_id", "merchant_category",
                                          F.col("user_id").cast("string").alias("user_id"))
    )
    parts = [
        A.drift_alerts(_drift(spark, sf_dir), AS_OF),
        A.performance_alerts(E.metric_gates(E.classification_metrics(s)), AS_OF),
        A.quality_alerts(checks, AS_OF),
        A.latency_alerts(E.latency_summary(s), AS_OF),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drift_alerts(spark, sf_dir):
    return A.drift_alerts(_drift(spark, sf_dir), AS_OF).select("name", "severity", "message", F.element_at("details", "feature").alias("feature"))


DRIFT_ALERTS = "WITH RECURSIVE " + _DRIFT + """ SELECT 'drift_detected' AS name, severity, 'Drift detected in ''' || feature || ''': ' || printf('%.3f', psi) || ' (threshold: 0.100)' AS message, feature
FROM drift WHERE severity <> 'none'"""


def recent_alerts(spark, sf_dir):
    """The last alerts of all kinds that are critical."""
    out = A.recent_alerts(A.at_least(_all_alerts(spark, sf_dir), "warning"), 10, "critical")
    return out.select("name", "severity", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "source")


RECENT_ALERTS = "WITH RECURSIVE " + _DRIFT + """, sc AS (SELECT is_fraud AS label, fraud_probability AS score FROM pred),
c AS (SELECT count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn FROM sc),
lad0 AS (SELECT score AS s, count(*) AS n, sum(label) AS pos FROM sc GROUP BY 1),
lad AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS nn, sum(pos) OVER (ORDER BY s DESC) AS pp FROM lad0), ap AS (SELECT sum(pos * (pp::DOUBLE / nn::DOUBLE)) / sum(pos) AS ap FROM lad),
perf AS (SELECT tp / (tp + fp) < 0.70 AS bad FROM c UNION ALL SELECT tp / (tp + fn) < 0.60 FROM c UNION ALL SELECT ap < 0.75 FROM ap)
SELECT 'drift_detected' AS name, 'critical' AS severity, '2024-02-01' AS day, 'riskweave' AS source FROM drift WHERE severity = 'critical'
UNION ALL SELECT 'performance_degradation', 'critical', '2024-02-01', 'riskweave' FROM perf WHERE bad"""

STATE = R.RetrainState(datetime(2023, 12, 30, 6), "v2", 0.04)


def _triggers(spark, sf_dir):
    s = scored(spark, sf_dir)
    parts = [
        R.performance_trigger(E.classification_metrics(s), AS_OF, STATE),
        R.drift_trigger(D.drifting_share(_drift(spark, sf_dir)), AS_OF, STATE),
        R.fraud_rate_trigger(s.agg(F.avg("label").alias("fraud_rate")), AS_OF, STATE),
        R.schedule_trigger(spark, AS_OF, STATE),
        R.manual_trigger(spark, AS_OF, "new pattern", STATE),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def retrain_triggers(spark, sf_dir):
    return _triggers(spark, sf_dir).select("trigger_id", "reason", "threshold_violated", "model_version_before", "status", "notes")


_TRIG = "WITH RECURSIVE " + _DRIFT + """, sc AS (SELECT is_fraud AS label, fraud_probability AS score FROM pred),
c AS (SELECT count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn, avg(label) AS rate FROM sc),
lad0 AS (SELECT score AS s, count(*) AS n, sum(label) AS pos FROM sc GROUP BY 1),
lad AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS nn, sum(pos) OVER (ORDER BY s DESC) AS pp FROM lad0), ap AS (SELECT sum(pos * (pp::DOUBLE / nn::DOUBLE)) / sum(pos) AS ap FROM lad),
pt AS (SELECT concat_ws('; ', CASE WHEN tp / (tp + fp) < 0.5 THEN 'precision=' || printf('%.3f', tp / (tp + fp)) || ' < 0.5' END,
  CASE WHEN tp / (tp + fn) < 0.7 THEN 'recall=' || printf('%.3f', tp / (tp + fn)) || ' < 0.7' END, CASE WHEN ap < 0.75 THEN 'pr_auc=' || printf('%.3f', ap) || ' < 0.75' END) AS v FROM c, ap),
ds AS (SELECT max(psi) AS psi, avg((severity <> 'none')::INT) * 100 AS pct FROM drift),
dt AS (SELECT concat_ws('; ', CASE WHEN psi > 0.1 THEN 'psi=' || printf('%.3f', psi) || ' > 0.1' END, CASE WHEN pct > 10 THEN 'feature_drift=' || printf('%.1f', pct) || '% > 10.0%' END) AS v FROM ds),
trig AS (SELECT 'perf' AS k, 'performance_degradation' AS reason, v, '' AS notes FROM pt WHERE v <> '' UNION ALL SELECT 'drift', 'data_drift', v, '' FROM dt WHERE v <> ''
UNION ALL SELECT 'fraud', 'fraud_rate_spike', 'fraud_rate_change=' || printf('%.1f', abs(rate - 0.04::DOUBLE) / 0.04::DOUBLE * 100) || '% > 20.0%', '' FROM c WHERE abs(rate - 0.04) / 0.04 > 0.2
UNION ALL SELECT 'sched', 'scheduled', 'days_since_retrain=32 > 30', '' UNION ALL SELECT 'manual', 'manual', NULL, 'new pattern')"""
RETRAIN_TRIGGERS = _TRIG + """ SELECT k || '_20240201_000000' AS trigger_id, reason, v AS threshold_violated, 'v2' AS model_version_before, 'pending' AS status, notes FROM trig"""


def trigger_counts(spark, sf_dir):
    """Triggers per reason after the drift retrain has started and finished."""
    log = cut_lineage(_triggers(spark, sf_dir))  # a few rows, read three times below
    drift = log.filter("reason = 'data_drift'")
    log = log.unionByName(R.outcome(drift, datetime(2024, 2, 1, 1), "in_progress")).unionByName(
        R.outcome(drift, datetime(2024, 2, 1, 2), "completed", "v3")
    )
    status = R.recent_triggers(log, 10).groupBy("reason", "status").agg(F.max("model_version_after").alias("model_version_after"))
    return R.trigger_counts(log).join(status, "reason")


TRIGGER_COUNTS = _TRIG + """ SELECT reason, count(*) AS n, CASE WHEN reason = 'data_drift' THEN 'completed' ELSE 'pending' END AS status,
  CASE WHEN reason = 'data_drift' THEN 'v3' END AS model_version_after FROM trig GROUP BY reason"""

QUERIES = {
    "feature_profile": feature_profile, "psi": psi, "ks": ks, "kl": kl, "feature_drift": feature_drift, "prediction_drift": prediction_drift,
    "drift_gate": drift_gate, "drifting_share": drifting_share, "drift_windows": drift_windows, "drift_alerts": drift_alerts, "recent_alerts": recent_alerts,
    "retrain_triggers": retrain_triggers, "trigger_counts": trigger_counts,
}
ORACLE = {
    "feature_profile": FEATURE_PROFILE, "psi": PSI, "ks": KS, "kl": KL, "feature_drift": FEATURE_DRIFT, "prediction_drift": PREDICTION_DRIFT,
    "drift_gate": DRIFT_GATE, "drifting_share": DRIFTING_SHARE, "drift_windows": DRIFT_WINDOWS, "drift_alerts": DRIFT_ALERTS, "recent_alerts": RECENT_ALERTS,
    "retrain_triggers": RETRAIN_TRIGGERS, "trigger_counts": TRIGGER_COUNTS,
}
