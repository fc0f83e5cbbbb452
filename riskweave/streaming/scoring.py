"""The scoring loop: messages in, decisions out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import RuleSet, engine_rules
from ..operators.scoring import Scorer, check_transactions

# velocity columns under the names the rules read
RULE_NAMES = {
    "txn_count_1h": "user_txn_count_1h", "txn_count_24h": "user_txn_count_24h", "txn_count_7d": "user_txn_count_7d",
    "amount_sum_24h": "user_txn_amount_24h", "amount_sum_7d": "user_txn_amount_7d",
}


def prediction_events(scorer: Scorer | None, rules: RuleSet | None = None, model_version: str = "v1") -> Callable[[DataFrame], DataFrame]:
    """A function from a batch with velocity columns to prediction events.

    (transaction_id, fraud_probability, decision, risk_level, triggered_rules, model_version,
    timestamp); to be given to ``velocity_stream``.
    """
    rules = rules or engine_rules()

    def score(batch: DataFrame) -> DataFrame:
        context = batch.withColumns({k: F.col(v) for k, v in RULE_NAMES.items() if v in batch.columns})
        fired = rules.fired(context.columns)
        # the decision carries the fired rules along, so no second pass joins them back
        answered = check_transactions(
            context.withColumn("_fired", fired).withColumn("_id", F.col("transaction_id")).withColumn(
                "transaction_id", F.struct(F.col("_id").alias("id"), F.col("_fired").alias("fired"), F.col("timestamp").alias("ts"))
            ),
            scorer, rules, model_version=model_version, explain=False, score_all=True,
        )
        return answered.select(
            F.col("transaction_id.id").alias("transaction_id"), F.col("risk_score").alias("fraud_probability"),
            F.col("action").alias("decision"), F.col("risk_tier").alias("risk_level"),
            F.col("transaction_id.fired").alias("triggered_rules"), "model_version",
            F.col("transaction_id.ts").alias("timestamp"),
        )

    return score
