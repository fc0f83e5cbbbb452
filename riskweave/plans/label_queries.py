"""Queries over predictions and late labels."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import labels as L
from .views import LAB_SQL, PRED_SQL, labels, predictions

PRED_LAB = PRED_SQL + LAB_SQL
WINDOW_END = datetime(2024, 1, 20)


def _round(df, places, *names):
    return df.withColumns({n: F.round(n, places) for n in names})


def _pred(spark, sf_dir):
    return predictions(spark, sf_dir).select(
        "transaction_id", "user_id", "merchant_id", "amount", "fraud_probability", "decision", "model_version", "prediction_timestamp"
    )


def label_join(spark, sf_dir):
    out = L.join_labels(_pred(spark, sf_dir), labels(spark, sf_dir))
    return out.select("transaction_id", "is_fraud", "label_delay_days", "has_label", "label_too_late")


_JOINED = """joined AS (SELECT p.transaction_id, p.prediction_timestamp, l.is_fraud,
  floor((epoch_us(l.label_timestamp) - epoch_us(p.prediction_timestamp)) / 86400000000.0::DOUBLE)::BIGINT AS label_delay_days,
  l.is_fraud IS NOT NULL AS has_label FROM pred p LEFT JOIN lab l USING (transaction_id))"""
LABEL_JOIN = "WITH " + PRED_LAB + ", " + _JOINED + """
SELECT transaction_id, is_fraud, label_delay_days, has_label, coalesce(label_delay_days > 120, false) AS label_too_late FROM joined"""


def evaluation_window(spark, sf_dir):
    out = L.evaluation_window(_pred(spark, sf_dir), labels(spark, sf_dir), WINDOW_END, 10)
    return out.select("transaction_id", "is_fraud", "label_delay_days", "has_label")


_IN_WINDOW = """prediction_timestamp >= TIMESTAMP '2024-01-10' AND prediction_timestamp < TIMESTAMP '2024-01-20'"""
EVALUATION_WINDOW = "WITH " + PRED_LAB + ", " + _JOINED + f" SELECT transaction_id, is_fraud, label_delay_days, has_label FROM joined WHERE {_IN_WINDOW}"


def label_coverage(spark, sf_dir):
    joined = L.evaluation_window(_pred(spark, sf_dir), labels(spark, sf_dir), WINDOW_END, 10)
    return _round(L.label_coverage(joined, 0.96), 6, "label_rate")


LABEL_COVERAGE = "WITH " + PRED_LAB + ", " + _JOINED + f"""
SELECT count(*) AS n_predictions, count(*) FILTER (has_label) AS n_labelled, round(avg(has_label::INT), 6) AS label_rate,
  avg(has_label::INT) >= 0.96 AS enough_labels FROM joined WHERE {_IN_WINDOW}"""


def _repeated(spark, sf_dir):
    """Predictions and labels of which some come again, later and different."""
    p, q = _pred(spark, sf_dir), labels(spark, sf_dir)
    again = p.filter("transaction_id % 10 = 0").withColumns(
        {
            "prediction_timestamp": F.col("prediction_timestamp") + F.expr("INTERVAL 1 HOUR"),
            "fraud_probability": F.lit(0.95), "decision": F.lit("block"),
        }
    )
    relabel = q.filter("transaction_id % 7 = 0").withColumns(
        {"label_timestamp": F.col("label_timestamp") + F.expr("INTERVAL 5 DAYS"), "is_fraud": 1 - F.col("is_fraud")}
    )
    return p.unionByName(again), q.unionByName(relabel)


REPEATED = PRED_LAB + """,
p2 AS (SELECT transaction_id, amount, fraud_probability, decision, model_version, prediction_timestamp FROM pred UNION ALL
  SELECT transaction_id, amount, 0.95, 'block', model_version, prediction_timestamp + INTERVAL 1 HOUR FROM pred WHERE transaction_id % 10 = 0),
l2 AS (SELECT transaction_id, is_fraud, label_timestamp FROM lab UNION ALL
  SELECT transaction_id, 1 - is_fraud, label_timestamp + INTERVAL 5 DAY FROM lab WHERE transaction_id % 7 = 0),
lp AS (SELECT * FROM p2 QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY prediction_timestamp DESC) = 1),
fl AS (SELECT * FROM l2 QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY label_timestamp) = 1),
rec AS (SELECT transaction_id, fraud_probability, decision IN ('block', 'review') AS predicted_fraud, is_fraud = 1 AS actual_fraud,
  (decision = 'block') = (is_fraud = 1) AS correct, model_version, prediction_timestamp,
  (epoch_us(label_timestamp) - epoch_us(prediction_timestamp)) / 86400000000.0::DOUBLE AS label_delay_days, amount FROM lp JOIN fl USING (transaction_id))"""


def _reconciled(spark, sf_dir):
    return L.reconcile(*_repeated(spark, sf_dir))


def reconciled(spark, sf_dir):
    out = _reconciled(spark, sf_dir).drop("prediction_timestamp", "label_timestamp")
    return _round(out, 5, "fraud_probability", "label_delay_days", "amount")


RECONCILED = "WITH " + REPEATED + """ SELECT transaction_id, round(fraud_probability, 5) AS fraud_probability, predicted_fraud, actual_fraud, correct,
  model_version, round(label_delay_days, 5) AS label_delay_days, round(amount, 5) AS amount FROM rec"""


def reconcile_stats(spark, sf_dir):
    return _round(L.reconcile_stats(*_repeated(spark, sf_dir)), 6, "match_rate")


RECONCILE_STATS = "WITH " + REPEATED + """, pi AS (SELECT DISTINCT transaction_id FROM p2), li AS (SELECT transaction_id, count(*) AS c FROM l2 GROUP BY 1)
SELECT count(*) FILTER (c IS NULL) AS pending_predictions, count(*) FILTER (c IS NOT NULL) AS reconciled_records,
  (SELECT count(*) FROM l2) AS labels_received, count(*) FILTER (c IS NOT NULL) AS labels_matched,
  round(count(*) FILTER (c IS NOT NULL) / (SELECT count(*) FROM l2), 6) AS match_rate FROM pi LEFT JOIN li USING (transaction_id)"""


def pending_predictions(spark, sf_dir):
    """Predictions still without a label that have not expired by mid May."""
    open_ = L.pending(*_repeated(spark, sf_dir))
    alive = L.expire_pending(open_, datetime(2024, 5, 14))
    return alive.select("transaction_id", "decision", F.round("fraud_probability", 5).alias("fraud_probability"))


PENDING_PREDICTIONS = "WITH " + REPEATED + """ SELECT transaction_id, decision, round(fraud_probability, 5) AS fraud_probability FROM lp
WHERE transaction_id NOT IN (SELECT transaction_id FROM l2) AND prediction_timestamp >= TIMESTAMP '2024-05-14' - INTERVAL 120 DAY"""


def unmatched_labels(spark, sf_dir):
    """All labels, with ids of a system that is 500 ahead, against all predictions."""
    p, q = _repeated(spark, sf_dir)
    return L.unmatched_labels(p, q.withColumn("transaction_id", F.col("transaction_id") + 500)).select("transaction_id", "is_fraud")


UNMATCHED_LABELS = "WITH " + REPEATED + """ SELECT transaction_id + 500 AS transaction_id, is_fraud FROM l2
WHERE transaction_id + 500 NOT IN (SELECT transaction_id FROM pred)"""


def rolling_quality(spark, sf_dir):
    out = L.rolling_quality(_reconciled(spark, sf_dir)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return _round(out, 6, "fraud_rate", "precision", "recall")


ROLLING_QUALITY = "WITH " + REPEATED + """, days AS (SELECT unnest(generate_series(min(prediction_timestamp::DATE), max(prediction_timestamp::DATE), INTERVAL 1 DAY))::DATE AS d FROM rec)
SELECT strftime(d, '%Y-%m-%d') AS date, count(*) AS n_samples, round(avg(actual_fraud::INT), 6) AS fraud_rate,
  round(count(*) FILTER (actual_fraud AND predicted_fraud) / greatest(1, count(*) FILTER (predicted_fraud)), 6) AS precision,
  round(count(*) FILTER (actual_fraud AND predicted_fraud) / greatest(1, count(*) FILTER (actual_fraud)), 6) AS recall
FROM days JOIN rec ON prediction_timestamp >= d AND prediction_timestamp < d + INTERVAL 7 DAY GROUP BY d"""

_PERF = ["actual_fraud_rate", "predicted_fraud_rate", "precision", "recall", "f1", "roc_auc", "pr_auc", "fraud_catch_rate_dollars"]
_MONEY = ["total_fraud_amount", "caught_fraud_amount", "false_positive_amount", "avg_label_delay_days"]


def version_performance(spark, sf_dir):
    out = L.performance_by_version(_reconciled(spark, sf_dir))
    return _round(_round(out, 6, *_PERF), 3, *_MONEY)


def overall_performance(spark, sf_dir):
    out = L.performance(_reconciled(spark, sf_dir), min_date=datetime(2024, 1, 4), max_date=datetime(2024, 1, 25))
    return _round(_round(out, 6, *_PERF), 3, *_MONEY)


def ladder_sql(source, groups, score, label):
    """CTEs ending in ``ranks(groups, roc_auc, pr_auc)`` over a relation."""
    g = ", ".join(groups) + ", " if groups else ""
    part = f"PARTITION BY {', '.join(groups)} " if groups else ""
    by = f" GROUP BY {', '.join(groups)}" if groups else ""
    return f"""lad0 AS (SELECT {g}{score} AS s, count(*) AS n, sum({label})::BIGINT AS pos FROM {source} GROUP BY {g}{score}),
lad AS (SELECT *, coalesce(sum(n) OVER wd, 0) AS na, coalesce(sum(pos) OVER wd, 0) AS pa FROM lad0
  WINDOW wd AS ({part}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ranks AS (SELECT {g}CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN sum((n - pos)::DOUBLE * (pa + pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(n - pos)::DOUBLE) END AS roc_auc,
  CASE WHEN sum(pos) > 0 AND sum(n - pos) > 0 THEN sum(pos * ((pa + pos)::DOUBLE / (na + n)::DOUBLE)) / sum(pos)::DOUBLE END AS pr_auc FROM lad{by})"""


def _perf_sql(where, groups):
    g = ", ".join(groups) + ", " if groups else ""
    by = f"GROUP BY {', '.join(groups)}" if groups else ""
    join = f"JOIN ranks USING ({', '.join(groups)})" if groups else ", ranks"
    return "WITH " + REPEATED + f", r AS (SELECT *, actual_fraud::INT AS y FROM rec WHERE {where}), " + ladder_sql("r", groups, "fraud_probability", "y") + f""",
c AS (SELECT {g}count(*) AS n_samples, avg(y) AS actual_fraud_rate, avg(predicted_fraud::INT) AS predicted_fraud_rate,
  count(*) FILTER (actual_fraud AND predicted_fraud) AS true_positives, count(*) FILTER (NOT actual_fraud AND predicted_fraud) AS false_positives,
  count(*) FILTER (actual_fraud AND NOT predicted_fraud) AS false_negatives, count(*) FILTER (NOT actual_fraud AND NOT predicted_fraud) AS true_negatives,
  coalesce(sum(amount) FILTER (actual_fraud), 0) AS total_fraud_amount, coalesce(sum(amount) FILTER (actual_fraud AND predicted_fraud), 0) AS caught_fraud_amount,
  coalesce(sum(amount) FILTER (NOT actual_fraud AND predicted_fraud), 0) AS false_positive_amount, avg(label_delay_days) AS avg_label_delay_days FROM r {by})
SELECT {g}n_samples, round(actual_fraud_rate, 6) AS actual_fraud_rate, round(predicted_fraud_rate, 6) AS predicted_fraud_rate,
  true_positives, false_positives, false_negatives, true_negatives, round(total_fraud_amount, 3) AS total_fraud_amount,
  round(caught_fraud_amount, 3) AS caught_fraud_amount, round(false_positive_amount, 3) AS false_positive_amount,
  round(avg_label_delay_days, 3) AS avg_label_delay_days,
  round(coalesce(true_positives / nullif(true_positives + false_positives, 0), 0), 6) AS precision,
  round(coalesce(true_positives / nullif(true_positives + false_negatives, 0), 0), 6) AS recall,
  round(coalesce(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0), 0), 6) AS f1,
  round(coalesce(caught_fraud_amount / nullif(total_fraud_amount, 0), 0), 6) AS fraud_catch_rate_dollars,
  round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM c {join}"""


VERSION_PERFORMANCE = _perf_sql("true", ["model_version"])
OVERALL_PERFORMANCE = _perf_sql("prediction_timestamp >= TIMESTAMP '2024-01-04' AND prediction_timestamp <= TIMESTAMP '2024-01-25'", [])

QUERIES = {
    "label_join": label_join, "evaluation_window": evaluation_window, "label_coverage": label_coverage, "reconciled": reconciled,
    "reconcile_stats": reconcile_stats, "pending_predictions": pending_predictions, "unmatched_labels": unmatched_labels,
    "rolling_quality": rolling_quality, "version_performance": version_performance, "overall_performance": overall_performance,
}
ORACLE = {
    "label_join": LABEL_JOIN, "evaluation_window": EVALUATION_WINDOW, "label_coverage": LABEL_COVERAGE, "reconciled": RECONCILED,
    "reconcile_stats": RECONCILE_STATS, "pending_predictions": PENDING_PREDICTIONS, "unmatched_labels": UNMATCHED_LABELS,
    "rolling_quality": ROLLING_QUALITY, "version_performance": VERSION_PERFORMANCE, "overall_performance": OVERALL_PERFORMANCE,
}
