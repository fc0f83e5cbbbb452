"""Queries over a scored, labelled table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import features, ranking
from ..operators.entities import class_distribution
from ..operators.model import split_point, stratified_split
from .label_queries import ladder_sql
from .views import PRED_SQL, predictions, transactions


def _round(df, places, *names):
    return df.withColumns({n: F.round(n, places) for n in names})


def scored(spark, sf_dir):
    return predictions(spark, sf_dir).select(
        "transaction_id", F.col("is_fraud").alias("label"), F.col("fraud_probability").alias("score"), "amount", "timestamp",
        "merchant_category", "device_type", "model_version", "latency_ms", "prediction_timestamp",
    )


SC = PRED_SQL + """, sc AS (SELECT transaction_id, is_fraud AS label, fraud_probability AS score, amount, "timestamp", merchant_category, device_type,
  model_version, latency_ms, prediction_timestamp FROM pred)"""
_RATES = ["precision", "recall", "f1", "specificity", "brier_score", "log_loss", "positive_rate", "predicted_positive_rate"]


def confusion_metrics(spark, sf_dir):
    return _round(E.classification_metrics(scored(spark, sf_dir)), 6, *_RATES, "roc_auc", "pr_auc")


def _confusion(positive):
    return f"""count(*) FILTER (label = 1 AND {positive}) AS true_positives, count(*) FILTER (label = 0 AND {positive}) AS false_positives,
  count(*) FILTER (label = 0 AND NOT ({positive})) AS true_negatives, count(*) FILTER (label = 1 AND NOT ({positive})) AS false_negatives"""


_FLAT = _confusion("score >= 0.5") + """, avg((score - label) * (score - label)) AS brier_score,
  avg(CASE WHEN label = 1 THEN -ln(greatest(1e-15::DOUBLE, least(score, 1 - 1e-15::DOUBLE))) ELSE -ln(1 - greatest(1e-15::DOUBLE, least(score, 1 - 1e-15::DOUBLE))) END) AS log_loss,
  avg(label) AS positive_rate, avg((score >= 0.5)::INT) AS predicted_positive_rate, count(*) AS n_samples"""
_DERIVED = """true_positives, false_positives, true_negatives, false_negatives, n_samples,
  round(coalesce(true_positives / nullif(true_positives + false_positives, 0), 0), 6) AS precision,
  round(coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0), 6) AS recall,
  round(coalesce(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0), 0), 6) AS f1,
  round(coalesce(true_negatives / nullif(true_negatives + false_positives, 0), 0), 6) AS specificity,
  round(brier_score, 6) AS brier_score, round(log_loss, 6) AS log_loss, round(positive_rate, 6) AS positive_rate,
  round(predicted_positive_rate, 6) AS predicted_positive_rate, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc"""
CONFUSION_METRICS = "WITH " + SC + ", " + ladder_sql("sc", [], "score", "label") + f", c AS (SELECT {_FLAT} FROM sc) SELECT {_DERIVED} FROM c, ranks"


def slice_metrics(spark, sf_dir):
    s = scored(spark, sf_dir).withColumns(
        {"amount_bucket": E.amount_bucket(F.col("amount") * 40), "time_of_day": E.time_of_day(F.col("timestamp"))}
    )
    out = E.slice_metrics(s, ["merchant_category", "device_type", "amount_bucket", "time_of_day"])
    return _round(out, 6, *_RATES, "roc_auc", "pr_auc")


_BUCKET = "CASE WHEN amount * 40 >= 10000 THEN 'very_high' WHEN amount * 40 >= 1000 THEN 'high' WHEN amount * 40 >= 100 THEN 'medium' ELSE 'low' END"
_PART = "CASE WHEN hour(\"timestamp\") >= 18 THEN 'evening' WHEN hour(\"timestamp\") >= 12 THEN 'afternoon' WHEN hour(\"timestamp\") >= 6 THEN 'morning' ELSE 'night' END"
_LONG = ", sl AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS slice_name, {e} AS slice, label, score FROM sc WHERE {e} IS NOT NULL"
    for n, e in (("merchant_category", "merchant_category"), ("device_type", "device_type"), ("amount_bucket", _BUCKET), ("time_of_day", _PART))
) + ")"
SLICE_METRICS = "WITH " + SC + _LONG + ", " + ladder_sql("sl", ["slice_name", "slice"], "score", "label") + (
    f", c AS (SELECT slice_name, slice, {_FLAT} FROM sl GROUP BY 1, 2 HAVING count(*) >= 10) SELECT slice_name, slice, {_DERIVED} FROM c JOIN ranks USING (slice_name, slice)"
)


def roc_auc(spark, sf_dir):
    out = ranking.ranking_quality(scored(spark, sf_dir), ["model_version"])
    return _round(out.select("model_version", "roc_auc"), 8, "roc_auc")


def average_precision(spark, sf_dir):
    out = ranking.ranking_quality(scored(spark, sf_dir), ["model_version"])
    return _round(out.select("model_version", "pr_auc"), 8, "pr_auc")


_BY_VERSION = "WITH " + SC + ", " + ladder_sql("sc", ["model_version"], "score", "label")
ROC_AUC = _BY_VERSION + " SELECT model_version, round(roc_auc, 8) AS roc_auc FROM ranks"
AVERAGE_PRECISION = _BY_VERSION + " SELECT model_version, round(pr_auc, 8) AS pr_auc FROM ranks"


def calibration(spark, sf_dir):
    return _round(E.calibration_curve(scored(spark, sf_dir)), 6, "prob_true", "prob_pred")


_RIGHT = "len(list_filter(range(1, 10), lambda i: i * 0.1::DOUBLE < score))"
_LEFT = "len(list_filter(range(1, 10), lambda i: i * 0.1::DOUBLE <= score))"
CALIBRATION = "WITH " + SC + f" SELECT {_RIGHT}::INT AS bin, count(*) AS n, round(avg(label), 6) AS prob_true, round(avg(score), 6) AS prob_pred FROM sc GROUP BY 1"


def ece(spark, sf_dir):
    return _round(E.calibration_errors(scored(spark, sf_dir)), 6, "ece", "mce", "brier_score")


ECE = "WITH " + SC + f""", l AS (SELECT {_LEFT} AS b, count(*) AS n, abs(avg(label) - avg(score)) AS gap FROM sc WHERE score < 1 GROUP BY 1),
r AS (SELECT {_RIGHT} AS b, abs(avg(label) - avg(score)) AS gap FROM sc GROUP BY 1)
SELECT round((SELECT sum(n * gap) FROM l) / (SELECT count(*) FROM sc), 6) AS ece, round((SELECT max(gap) FROM r), 6) AS mce,
  round((SELECT avg((score - label) * (score - label)) FROM sc), 6) AS brier_score"""


def threshold_analysis(spark, sf_dir):
    return _round(E.threshold_analysis(scored(spark, sf_dir)), 6, "precision", "recall", "f1", "predicted_positive_rate")


THRESHOLD_ANALYSIS = "WITH " + SC + f""", t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS threshold),
c AS (SELECT threshold, {_confusion('score >= threshold')} FROM t, sc GROUP BY 1)
SELECT threshold, true_positives, false_positives, false_negatives, true_negatives,
  round(coalesce(true_positives / nullif(true_positives + false_positives, 0), 0), 6) AS precision,
  round(coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0), 6) AS recall,
  round(coalesce(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0), 0), 6) AS f1,
  round((true_positives + false_positives) / (true_positives + false_positives + false_negatives + true_negatives), 6) AS predicted_positive_rate FROM c"""


def precision_at_k(spark, sf_dir):
    return _round(ranking.precision_at_k(scored(spark, sf_dir)), 6, "precision_at_k")


PRECISION_AT_K = "WITH " + SC + """, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, transaction_id) AS rn, count(*) OVER () AS n FROM sc),
k AS (SELECT DISTINCT floor(n * s)::BIGINT AS k FROM (SELECT max(n) AS n FROM r), (SELECT unnest([0.01, 0.05, 0.1, 0.2]::DOUBLE[]) AS s))
SELECT k, round(avg(label), 6) AS precision_at_k FROM k JOIN r ON rn <= k WHERE k > 0 GROUP BY k"""


def metric_gates(spark, sf_dir):
    return _round(E.metric_gates(E.classification_metrics(scored(spark, sf_dir))), 6, "value")


METRIC_GATES = "WITH " + SC + ", " + ladder_sql("sc", [], "score", "label") + f""", c AS (SELECT {_confusion('score >= 0.5')} FROM sc),
g AS (SELECT 'precision' AS metric, true_positives / (true_positives + false_positives) AS value, 0.70::DOUBLE AS minimum FROM c
  UNION ALL SELECT 'recall', true_positives / (true_positives + false_negatives), 0.60 FROM c UNION ALL SELECT 'pr_auc', pr_auc, 0.75 FROM ranks)
SELECT metric, round(value, 6) AS value, minimum, value >= minimum AS passed FROM g"""


def _gate_rows(df):
    flat = E.threshold_metrics(df.withColumn("_g", F.lit(0)), ["_g"])
    late = E.latency_summary(df)
    return E.as_metric_rows(flat, ["precision", "recall"]).unionByName(
        E.as_metric_rows(late.select(F.col("latency_p95_ms").alias("latency_p95")), ["latency_p95"])
    )


def regression_gates(spark, sf_dir):
    """Model v2 against model v1."""
    s = scored(spark, sf_dir)
    out = E.regression_gates(_gate_rows(s.filter("model_version = 'v2'")), _gate_rows(s.filter("model_version = 'v1'")))
    return _round(out, 6, "current", "previous", "change")


REGRESSION_GATES = "WITH " + SC + f""", c AS (SELECT model_version, {_confusion('score >= 0.5')} FROM sc GROUP BY 1),
p AS (SELECT model_version, latency_ms, row_number() OVER (PARTITION BY model_version ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY model_version) AS n FROM sc),
m AS (SELECT model_version, 'precision' AS metric, true_positives / (true_positives + false_positives) AS value FROM c
  UNION ALL SELECT model_version, 'recall', true_positives / (true_positives + false_negatives) FROM c
  UNION ALL SELECT model_version, 'latency_p95', latency_ms FROM p WHERE i = least(n * 95 // 100, n - 1)),
j AS (SELECT a.metric, a.value AS current, b.value AS previous, CASE WHEN a.metric = 'latency_p95' THEN a.value - b.value ELSE b.value - a.value END AS change,
  CASE WHEN a.metric = 'latency_p95' THEN 10.0::DOUBLE ELSE 0.02::DOUBLE END AS "limit" FROM m a JOIN m b USING (metric) WHERE a.model_version = 'v2' AND b.model_version = 'v1')
SELECT metric, round(current, 6) AS current, round(previous, 6) AS previous, round(change, 6) AS change, "limit", change <= "limit" AS passed FROM j"""


def report_warnings(spark, sf_dir):
    s = scored(spark, sf_dir)
    # with the threshold at 0.95 recall is low in every slice
    overall = E.classification_metrics(s, threshold=0.95)
    slices = E.slice_metrics(s, ["merchant_category"], threshold=0.95)
    return E.report_warnings(overall, slices, E.calibration_errors(s))


REPORT_WARNINGS = "WITH " + SC + f""", c AS (SELECT {_confusion('score >= 0.95')} FROM sc),
g AS (SELECT coalesce(true_positives / nullif(true_positives + false_positives, 0), 0) AS p, coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0) AS r FROM c),
s AS (SELECT merchant_category AS slice, {_confusion('score >= 0.95')}, count(*) AS n FROM sc GROUP BY 1),
sr AS (SELECT slice, n, coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0) AS r FROM s),
l AS (SELECT {_LEFT} AS b, count(*) AS n, abs(avg(label) - avg(score)) AS gap FROM sc WHERE score < 1 GROUP BY 1),
e AS (SELECT sum(n * gap) / (SELECT count(*) FROM sc) AS ece FROM l)
SELECT 'Low precision (' || printf('%.2f', p) || ') - high false positive rate' AS message FROM g WHERE p < 0.5
UNION ALL SELECT 'Low recall (' || printf('%.2f', r) || ') - missing many fraud cases' FROM g WHERE r < 0.5
UNION ALL SELECT 'Very low recall (' || printf('%.2f', r) || ') for merchant_category=' || slice FROM sr WHERE r < 0.3 AND n > 100
UNION ALL SELECT 'Poor calibration (ECE=' || printf('%.3f', ece) || ')' FROM e WHERE ece > 0.1"""


def latency_summary(spark, sf_dir):
    out = E.latency_summary(scored(spark, sf_dir), ["model_version"], failed=F.col("transaction_id") % 211 == 0)
    return _round(out, 4, "latency_mean_ms", "latency_min_ms", "latency_max_ms", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms",
                  "requests_per_second", "error_rate")


LATENCY_SUMMARY = "WITH " + SC + """, x AS (SELECT *, transaction_id % 211 = 0 AS bad FROM sc),
o AS (SELECT model_version, latency_ms, row_number() OVER (PARTITION BY model_version ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY model_version) AS n FROM x WHERE NOT bad),
p AS (SELECT model_version, max(latency_ms) FILTER (i = least(n * 50 // 100, n - 1)) AS p50, max(latency_ms) FILTER (i = least(n * 95 // 100, n - 1)) AS p95,
  max(latency_ms) FILTER (i = least(n * 99 // 100, n - 1)) AS p99 FROM o GROUP BY 1)
SELECT model_version, count(*) AS num_requests, round(avg(latency_ms) FILTER (NOT bad), 4) AS latency_mean_ms, round(min(latency_ms) FILTER (NOT bad), 4) AS latency_min_ms,
  round(max(latency_ms) FILTER (NOT bad), 4) AS latency_max_ms,
  round(count(*) / ((epoch_us(max(prediction_timestamp)) - epoch_us(min(prediction_timestamp))) / 1e6::DOUBLE), 4) AS requests_per_second,
  count(*) FILTER (bad) AS error_count, round(avg(bad::INT), 4) AS error_rate, round(max(p50), 4) AS latency_p50_ms, round(max(p95), 4) AS latency_p95_ms,
  round(max(p99), 4) AS latency_p99_ms FROM x JOIN p USING (model_version) GROUP BY model_version"""


def _version_volume(spark, sf_dir):
    m = E.threshold_metrics(scored(spark, sf_dir), ["model_version"])
    return m.select("model_version", "precision", "recall", F.col("n_samples").alias("transactions"), F.col("positive_rate").alias("rate"))


def roi_by_version(spark, sf_dir):
    out = E.money_value(_version_volume(spark, sf_dir), fraud_rate=F.col("rate"), platform_cost=450.0)
    out = E.unit_cost(out, 450.0)
    return _round(out.drop("rate"), 4, "precision", "recall", "cost_per_prediction")


ROI_BY_VERSION = "WITH " + SC + f""", c AS (SELECT model_version, {_confusion('score >= 0.5')}, count(*) AS n, avg(label) AS rate FROM sc GROUP BY 1),
m AS (SELECT model_version, n, rate, coalesce(true_positives / nullif(true_positives + false_positives, 0), 0) AS p, coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0) AS r FROM c),
v AS (SELECT *, n * rate * r * 500 AS prevented, n * rate * (1 - r) * 500 AS missed, CASE WHEN p > 0 THEN n * rate * r * (1 - p) / p ELSE 0 END * 5 AS alarms,
  CASE WHEN p > 0 THEN rate * r * 500 - (1 - p) / p * 5 ELSE 0 END AS each FROM m)
SELECT model_version, round(p, 4) AS precision, round(r, 4) AS recall, n AS transactions, round(prevented, 2) AS fraud_prevented, round(missed, 2) AS fraud_missed,
  round(alarms, 2) AS false_alarm_cost, round(prevented, 2) AS gross_savings, round(prevented - alarms - 450, 2) AS net_savings,
  round((prevented - alarms - 450) / 450 * 100, 1) AS roi_percentage, CASE WHEN each > 0 THEN floor(450 / each) ELSE -1 END::BIGINT AS break_even_predictions,
  round(450.0::DOUBLE / n, 4) AS cost_per_prediction, round(450.0::DOUBLE / n * 1000000, 2) AS cost_per_million FROM v"""


def class_counts(spark, sf_dir):
    return class_distribution(scored(spark, sf_dir))


CLASS_COUNTS = "WITH " + SC + " SELECT label, count(*) AS n FROM sc GROUP BY 1"


def time_split(spark, sf_dir):
    """Which side of the 0.8 quantile of time each transaction falls on."""
    t = transactions(spark, sf_dir)
    at = split_point(t)
    return t.select("transaction_id", F.when(F.unix_micros("timestamp") <= F.lit(at), "train").otherwise("test").alias("part"))


TIME_SPLIT = "WITH " + PRED_SQL + """, q AS (SELECT quantile_cont(us::DOUBLE, 0.8) AS border FROM txn)
SELECT transaction_id, CASE WHEN us <= border THEN 'train' ELSE 'test' END AS part FROM txn, q"""


def stratified_sizes(spark, sf_dir):
    train, test = stratified_split(scored(spark, sf_dir))
    count = F.count(F.lit(1)).alias("n")
    return train.groupBy("label").agg(count).withColumn("part", F.lit("train")).unionByName(
        test.groupBy("label").agg(count).withColumn("part", F.lit("test"))
    )


STRATIFIED_SIZES = "WITH " + SC + """, c AS (SELECT label, count(*) AS n FROM sc GROUP BY 1)
SELECT label, round_even(n * 0.2::DOUBLE, 0)::BIGINT AS n, 'test' AS part FROM c UNION ALL SELECT label, n - round_even(n * 0.2::DOUBLE, 0)::BIGINT, 'train' FROM c"""


def model_columns(spark, sf_dir):
    """The numeric inputs chosen from the feature table, with their column totals."""
    t = transactions(spark, sf_dir).select("transaction_id", "is_vpn", "is_emulator", "account_age_days", "previous_fraud_flags")
    out = features.RiskFeatures(categorical=()).fit_transform(t)
    names = features.model_inputs(out)
    wide = out.agg(*[F.sum(F.col(n).cast("double")).alias(n) for n in names])
    return _round(E.as_metric_rows(wide, names).withColumnRenamed("metric", "feature").withColumnRenamed("value", "total"), 3, "total")


MODEL_COLUMNS = "WITH " + PRED_SQL + """, f AS (SELECT is_vpn::INT AS is_vpn, is_emulator::INT AS is_emulator, (is_vpn::INT + is_emulator::INT) / 2.0::DOUBLE AS device_risk,
  account_age_days AS account_age, ln(1 + account_age_days) AS account_age_log, (account_age_days < 30)::INT AS is_new_account, previous_fraud_flags AS fraud_flags,
  (previous_fraud_flags > 0)::INT AS has_fraud_history FROM txn)
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(sum({c})::DOUBLE, 3) AS total FROM f"
    for c in ("is_vpn", "is_emulator", "device_risk", "account_age", "account_age_log", "is_new_account", "fraud_flags", "has_fraud_history")
)

QUERIES = {
    "confusion_metrics": confusion_metrics, "slice_metrics": slice_metrics, "roc_auc": roc_auc, "average_precision": average_precision,
    "calibration": calibration, "ece": ece, "threshold_analysis": threshold_analysis, "precision_at_k": precision_at_k,
    "metric_gates": metric_gates, "regression_gates": regression_gates, "report_warnings": report_warnings,
    "latency_summary": latency_summary, "roi_by_version": roi_by_version, "class_counts": class_counts, "time_split": time_split,
    "stratified_sizes": stratified_sizes, "model_columns": model_columns,
}
ORACLE = {
    "confusion_metrics": CONFUSION_METRICS, "slice_metrics": SLICE_METRICS, "roc_auc": ROC_AUC, "average_precision": AVERAGE_PRECISION,
    "calibration": CALIBRATION, "ece": ECE, "threshold_analysis": THRESHOLD_ANALYSIS, "precision_at_k": PRECISION_AT_K,
    "metric_gates": METRIC_GATES, "regression_gates": REGRESSION_GATES, "report_warnings": REPORT_WARNINGS,
    "latency_summary": LATENCY_SUMMARY, "roi_by_version": ROI_BY_VERSION, "class_counts": CLASS_COUNTS, "time_split": TIME_SPLIT,
    "stratified_sizes": STRATIFIED_SIZES, "model_columns": MODEL_COLUMNS,
}
