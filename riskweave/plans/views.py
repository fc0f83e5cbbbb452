"""Transaction, prediction and label views over ``events``, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        "user_id",
        F.col("value").alias("amount"),
        F.col("event_type").alias("merchant_category"),
        F.concat(F.lit("m"), F.regexp_extract("props", r"(\d+)", 1)).alias("merchant_id"),
        (F.col("event_id") % 97).alias("device_id"),
        F.when((F.col("value") > 150) | ((F.col("event_id") * 31) % 97 == 0), 1).otherwise(0).alias("is_fraud"),
        F.when(F.col("event_id") % 4 == 0, "transfer")
        .when(F.col("event_id") % 4 == 1, "withdrawal")
        .otherwise("payment")
        .alias("transaction_type"),
        (F.col("event_id") % 11 == 0).alias("is_vpn"),
        (F.col("event_id") % 7 == 0).alias("is_new_device"),
        (F.col("event_id") % 53 == 0).alias("is_emulator"),
        ((F.col("user_id") * 37) % 400).alias("account_age_days"),
        F.when(F.col("user_id") % 29 == 0, 2).otherwise(0).alias("previous_fraud_flags"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("string"))
        .when(F.col("event_id") % 5 == 1, "Tablet")
        .when(F.col("event_id") % 5 == 2, "watch")
        .otherwise("mobile")
        .alias("device_type"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (((F.col("transaction_id") * 7919) % 700) + 299 * F.col("is_fraud")) / F.lit(1000.0)
    return (
        transactions(spark, sf_dir)
        .withColumn("fraud_probability", p)
        .withColumn(
            "decision",
            F.when(F.col("fraud_probability") >= 0.9, "block")
            .when(F.col("fraud_probability") >= 0.7, "review")
            .otherwise("allow"),
        )
        .withColumn("model_version", F.concat(F.lit("v"), (F.col("transaction_id") % 3).cast("string")))
        .withColumn("prediction_timestamp", F.col("timestamp"))
        .withColumn("latency_ms", F.lit(5.0) + ((F.col("transaction_id") * 17) % 900) / F.lit(10.0))
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tid = F.col("transaction_id")
    return (
        transactions(spark, sf_dir)
        .filter(tid % 20 != 0)
        .select(
            "transaction_id",
            "is_fraud",
            (F.col("timestamp") + F.make_dt_interval(((tid * 17) % 130).cast("int"))).alias("label_timestamp"),
            F.when(tid % 3 == 0, "chargeback").when(tid % 3 == 1, "Investigation").otherwise("auto").alias("label_source"),
        )
    )


TXN_SQL = r"""
txn AS (
  SELECT event_id AS transaction_id, ts AS "timestamp", epoch_us(ts) AS us, user_id, value AS amount,
         event_type AS merchant_category, 'm' || regexp_extract(props, '(\d+)', 1) AS merchant_id,
         event_id % 97 AS device_id,
         CASE WHEN value > 150 OR (event_id*31) % 97 = 0 THEN 1 ELSE 0 END AS is_fraud,
         CASE event_id % 4 WHEN 0 THEN 'transfer' WHEN 1 THEN 'withdrawal' ELSE 'payment' END AS transaction_type,
         event_id % 11 = 0 AS is_vpn, event_id % 7 = 0 AS is_new_device, event_id % 53 = 0 AS is_emulator,
         (user_id*37) % 400 AS account_age_days,
         CASE WHEN user_id % 29 = 0 THEN 2 ELSE 0 END AS previous_fraud_flags,
         CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Tablet' WHEN 2 THEN 'watch' ELSE 'mobile' END AS device_type
  FROM events)
"""

PRED_SQL = TXN_SQL + r""",
pred AS (
  SELECT *, CASE WHEN fraud_probability >= 0.9 THEN 'block' WHEN fraud_probability >= 0.7 THEN 'review' ELSE 'allow' END AS decision
  FROM (SELECT *, (((transaction_id*7919) % 700) + 299*is_fraud) / 1000.0::DOUBLE AS fraud_probability,
               'v' || (transaction_id % 3) AS model_version, "timestamp" AS prediction_timestamp,
               5 + ((transaction_id*17) % 900) / 10.0::DOUBLE AS latency_ms
        FROM txn))
"""

LAB_SQL = r""",
lab AS (
  SELECT transaction_id, is_fraud, "timestamp" + to_days(((transaction_id*17) % 130)::INT) AS label_timestamp,
         CASE transaction_id % 3 WHEN 0 THEN 'chargeback' WHEN 1 THEN 'Investigation' ELSE 'auto' END AS label_source
  FROM txn WHERE transaction_id % 20 <> 0)
"""
