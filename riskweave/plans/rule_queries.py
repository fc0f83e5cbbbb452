"""Queries over rules, decisions and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators import scoring
from .views import PRED_SQL, predictions


def _context(spark, sf_dir):
    """Predictions with the columns the rules read; amounts are scaled to reach the limits."""
    tid = F.col("transaction_id")
    return predictions(spark, sf_dir).select(
        "transaction_id", "user_id", "transaction_type", "is_vpn", "is_new_device", "is_emulator", "account_age_days", "previous_fraud_flags",
        (F.col("amount") * 1000).alias("amount"), F.col("fraud_probability").alias("score"),
        (F.col("user_id") % 31 == 0).alias("user_is_blocked"), F.when(tid % 3 != 0, tid % 59 == 0).alias("device_is_blocked"),
        (tid % 60).alias("txn_count_1h"), (tid % 8).alias("txn_count_10m"), (tid * 300.0).alias("amount_sum_24h"), (tid % 4 != 0).alias("is_verified"),
        F.when(tid % 43 == 0, "XX").otherwise("NG").alias("location_country"), (tid % 5 == 0).alias("is_whitelisted_merchant"),
    )


CTX = PRED_SQL + """,
ctx AS (SELECT transaction_id, user_id, transaction_type, is_vpn, is_new_device, is_emulator, account_age_days, previous_fraud_flags, amount * 1000 AS amount,
  fraud_probability AS score, user_id % 31 = 0 AS user_is_blocked, CASE WHEN transaction_id % 3 <> 0 THEN transaction_id % 59 = 0 END AS device_is_blocked,
  transaction_id % 60 AS txn_count_1h, transaction_id % 8 AS txn_count_10m, transaction_id * 300.0::DOUBLE AS amount_sum_24h, transaction_id % 4 <> 0 AS is_verified,
  CASE WHEN transaction_id % 43 = 0 THEN 'XX' ELSE 'NG' END AS location_country, transaction_id % 5 = 0 AS is_whitelisted_merchant FROM pred)"""

# the conditions once more, as SQL
_SQL = {
    "blocked_user": "coalesce(user_is_blocked, false)", "blocked_device": "coalesce(device_is_blocked, false)",
    "repeat_fraudster": "previous_fraud_flags >= 2", "velocity_1h": "txn_count_1h > 20", "velocity_10m": "txn_count_10m > 5",
    "amount_24h": "amount_sum_24h > 1000000", "vpn_high_amount": "is_vpn AND amount > 50000", "emulator": "is_emulator",
    "new_device_high": "is_new_device AND amount > 100000", "new_user_high": "account_age_days < 3 AND amount > 50000",
    "unverified_high": "NOT is_verified AND amount > 100000",
    "sanctioned_country": "location_country IN ('XX', 'YY')", "velocity_breach": "txn_count_1h > 50",
    "high_amount_new_user": "amount > 100000 AND account_age_days < 7", "new_device_high_amount": "is_new_device AND amount > 50000",
    "whitelisted_merchant": "is_whitelisted_merchant",
}


def _case(names, value, other="NULL"):
    return "CASE " + " ".join(f"WHEN {_SQL[n]} THEN {value(n)}" for n in names) + f" ELSE {other} END"


def _text(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


_ENGINE = {r.name: r for r in R.ENGINE_RULES}
_SPECIAL = {r.name: r for r in R.SPECIAL_RULES}
_CRITICAL = ["blocked_user", "blocked_device", "repeat_fraudster"]
_CHALLENGES = ["velocity_10m", "amount_24h", "vpn_high_amount", "emulator", "new_device_high", "new_user_high", "unverified_high"]


def pre_score_rules(spark, sf_dir):
    out = R.check_before_score(_context(spark, sf_dir), R.engine_rules())
    return out.select("transaction_id", "triggered", "rule_name", "action", "reason")


PRE_SCORE_RULES = "WITH " + CTX + f""" SELECT transaction_id, {_case(_CRITICAL, lambda n: 'true', 'false')} AS triggered,
  {_case(_CRITICAL, _text)} AS rule_name, {_case(_CRITICAL, lambda n: "'block'")} AS action,
  {_case(_CRITICAL, lambda n: _text(_ENGINE[n].description))} AS reason FROM ctx"""


def decisions(spark, sf_dir):
    out = R.decide(_context(spark, sf_dir), R.engine_rules())
    return out.select("transaction_id", "rule_name", "action", "challenge_type", "reason")


def _decide_sql(late, rule_of, limits, otp_only, elevated):
    block = "CASE transaction_type " + " ".join(f"WHEN '{k}' THEN {b}" for k, (_, b) in limits.items()) + f" ELSE {limits['payment'][1]} END"
    chal = "CASE transaction_type " + " ".join(f"WHEN '{k}' THEN {c}" for k, (c, _) in limits.items()) + f" ELSE {limits['payment'][0]} END"

    def pick(value, at_block, at_challenge, otherwise):
        return _case(late, value, f"CASE WHEN score >= {block} THEN {at_block} WHEN score >= {chal} THEN {at_challenge} ELSE {otherwise} END")

    how = "'otp'" if otp_only else "CASE WHEN score < 0.85 THEN 'otp' ELSE 'selfie_verification' END"
    return {
        "rule_name": pick(_text, "'score_block'", "'score_challenge'", "NULL"),
        "action": pick(lambda n: _text(rule_of[n].action), "'block'", "'challenge'", "'allow'"),
        "challenge_type": pick(lambda n: "'otp'" if otp_only else _text(rule_of[n].challenge_type), "NULL", how, "NULL"),
        "reason": pick(lambda n: _text(f"Rule: {n}" if otp_only else rule_of[n].description), "'Risk score too high'", _text(elevated), "'Risk acceptable'"),
    }


_ENGINE_SQL = _decide_sql(_CHALLENGES, _ENGINE, R.ENGINE_THRESHOLDS, False, "Elevated risk")
DECISIONS = "WITH " + CTX + " SELECT transaction_id, " + ", ".join(f"{v} AS {k}" for k, v in _ENGINE_SQL.items()) + " FROM ctx"


def triggered_rules(spark, sf_dir):
    out = R.triggered_rules(_context(spark, sf_dir), R.engine_rules())
    return out.select("transaction_id", F.concat_ws(",", "triggered_rules").alias("triggered_rules"))


TRIGGERED_RULES = "WITH " + CTX + " SELECT transaction_id, concat_ws(',', " + ", ".join(
    f"CASE WHEN {_SQL[n]} THEN '{n}' END" for n in _ENGINE) + ") AS triggered_rules FROM ctx"


def special_rules(spark, sf_dir):
    """The configured overrides with the per-type thresholds; early rules win over the score."""
    ctx = _context(spark, sf_dir)
    rules = R.special_rules()
    early = rules.before_score(ctx.columns)
    v = F.coalesce(early, rules.decide(F.col("score"), ctx.columns))
    return ctx.select("transaction_id", v.alias("_v")).select("transaction_id", "_v.*")


_SPECIAL_EARLY = ["blocked_user", "sanctioned_country", "velocity_breach"]
_SPECIAL_LATE = ["high_amount_new_user", "new_device_high_amount", "whitelisted_merchant"]
_SPECIAL_SQL = _decide_sql(_SPECIAL_LATE, _SPECIAL, R.CONFIG_THRESHOLDS, False, "Elevated risk")
_EARLY_VALUES = {
    "rule_name": _text, "action": lambda n: "'block'", "challenge_type": lambda n: "NULL", "reason": lambda n: _text(_SPECIAL[n].description),
}
SPECIAL_RULES = "WITH " + CTX + " SELECT transaction_id, " + ", ".join(
    f"{_case(_SPECIAL_EARLY, _EARLY_VALUES[k], v)} AS {k}" for k, v in _SPECIAL_SQL.items()) + " FROM ctx"

_SIMPLE_EARLY = ["blocked_user", "blocked_device", "repeat_fraudster", "velocity_1h"]
_SIMPLE_LATE = ["velocity_10m", "vpn_high_amount", "emulator"]


def decision_explained(spark, sf_dir):
    """The full check: early rules, score, late rules, reasons."""
    ctx = _context(spark, sf_dir)
    out = scoring.check_transactions(ctx.drop("score"), _rescored, R.simple_rules(), model_version="v2", score_all=True)
    return out.select(
        "transaction_id", F.round("risk_score", 4).alias("risk_score"), "risk_tier", "action", "challenge_type", "action_reason", "model_version",
        "rule_triggered", F.concat_ws(",", F.transform("risk_reasons", lambda r: F.concat(r["feature"], F.lit(":"), r["severity"]))).alias("reasons"),
    )


def _rescored(df):
    """Stands in for a model: the score of the derived table, recomputed from the row."""
    tid = F.col("transaction_id")
    fraud = F.when((F.col("amount") / 1000 > 150) | ((tid * 31) % 97 == 0), 1).otherwise(0)
    return df.withColumn("score", (((tid * 7919) % 700) + 299 * fraud) / F.lit(1000.0))


_SIMPLE_SQL = _decide_sql(_SIMPLE_LATE, _ENGINE, R.SIMPLE_THRESHOLDS, True, "Elevated risk - verification needed")


def _reason_sql():
    parts = []
    for name, _, weight in scoring.EXPLAINED:
        value = f"{name}::INT" if name.startswith("is_") else name
        cond = f"({value} = 1 OR {value} > 3)" + (f" AND {value} <= 30" if name == "account_age_days" else "")
        parts.append(f"CASE WHEN {cond} THEN '{name}:{'high' if weight > 0.15 else 'medium'}' END")
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)[1:5], ',')"


def _simple(k, early):
    return _case(_SIMPLE_EARLY, early, _SIMPLE_SQL[k])


DECISION_EXPLAINED = "WITH " + CTX + f""", d AS (SELECT *, {_case(_SIMPLE_EARLY, lambda n: 'true', 'false')} AS stopped FROM ctx)
SELECT transaction_id, CASE WHEN stopped THEN 1.0 ELSE round(score, 4) END::DOUBLE AS risk_score,
  CASE WHEN stopped OR score >= 0.85 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS risk_tier,
  {_simple('action', lambda n: "'block'")} AS action, {_simple('challenge_type', lambda n: 'NULL')} AS challenge_type,
  {_simple('reason', lambda n: _text('Rule triggered: ' + n))} AS action_reason, 'v2' AS model_version,
  {_simple('rule_name', _text)} AS rule_triggered, CASE WHEN stopped THEN '' ELSE {_reason_sql()} END AS reasons FROM d"""


def degraded_check(spark, sf_dir):
    """The same check without a model."""
    out = scoring.check_transactions(_context(spark, sf_dir).drop("score"), None, R.simple_rules())
    return out.groupBy("action", "risk_tier", "rule_triggered").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("risk_reasons")).alias("n_reasons"))


DEGRADED_CHECK = "WITH " + CTX + f""", d AS (SELECT {_case(_SIMPLE_EARLY, _text)} AS rule_triggered FROM ctx)
SELECT CASE WHEN rule_triggered IS NULL THEN 'challenge' ELSE 'block' END AS action, CASE WHEN rule_triggered IS NULL THEN 'medium' ELSE 'critical' END AS risk_tier,
  rule_triggered, count(*) AS n, count(*) FILTER (rule_triggered IS NULL) AS n_reasons FROM d GROUP BY ALL"""


def contribution_reasons(spark, sf_dir):
    """Top three of a contribution map derived from each row."""
    ctx = _context(spark, sf_dir)
    given = F.create_map(
        F.lit("is_vpn"), F.when(F.col("is_vpn"), 0.25).otherwise(0.0), F.lit("is_new_device"), F.when(F.col("is_new_device"), 0.18).otherwise(0.0),
        F.lit("txn_count_1h"), F.col("txn_count_1h") / 100, F.lit("account_age_days"), F.col("account_age_days") / -1000,
    )
    values = F.create_map(
        F.lit("is_vpn"), F.col("is_vpn").cast("double"), F.lit("is_new_device"), F.col("is_new_device").cast("double"),
        F.lit("txn_count_1h"), F.col("txn_count_1h").cast("double"), F.lit("account_age_days"), F.col("account_age_days").cast("double"),
    )
    out = scoring.explain_contributions(ctx.withColumns({"contributions": given, "values": values}), top_k=3)
    shown = F.transform("risk_reasons", lambda r: F.concat(r["feature"], F.lit("="), F.format_string("%.3f", r["contribution"]), F.lit("/"), r["severity"]))
    return out.select("transaction_id", F.concat_ws(";", shown).alias("reasons"), F.col("risk_reasons")[0]["description"].alias("first_reason"))


CONTRIBUTION_REASONS = "WITH " + CTX + """, e AS (SELECT transaction_id, unnest([
  {'f': 'is_vpn', 'c': CASE WHEN is_vpn THEN 0.25::DOUBLE ELSE 0 END, 'v': is_vpn::INT}, {'f': 'is_new_device', 'c': CASE WHEN is_new_device THEN 0.18::DOUBLE ELSE 0 END, 'v': is_new_device::INT},
  {'f': 'txn_count_1h', 'c': txn_count_1h / 100, 'v': txn_count_1h}, {'f': 'account_age_days', 'c': account_age_days / -1000, 'v': account_age_days}]) AS u FROM ctx),
k AS (SELECT transaction_id, u.f AS f, u.c AS c, u.v AS v, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(u.c) DESC, u.f) AS r FROM e)
SELECT transaction_id, string_agg(f || '=' || printf('%.3f', c) || '/' || CASE WHEN abs(c) > 0.3 THEN 'critical' WHEN abs(c) > 0.15 THEN 'high' WHEN abs(c) > 0.05 THEN 'medium' ELSE 'low' END, ';' ORDER BY r) AS reasons,
  max(CASE WHEN r = 1 THEN CASE f WHEN 'is_vpn' THEN 'Transaction through VPN or proxy connection' WHEN 'is_new_device' THEN 'Transaction from a device we haven''t seen before'
    WHEN 'txn_count_1h' THEN 'Too many transactions in the last hour (' || v || ')' ELSE 'Account is very new (' || v || ' days old)' END END) AS first_reason
FROM k WHERE r <= 3 GROUP BY transaction_id"""


def simple_predictions(spark, sf_dir):
    scored = predictions(spark, sf_dir).select("transaction_id", F.col("fraud_probability").alias("score"))
    out = scoring.simple_prediction(scored, "v9")
    return out.withColumn("fraud_probability", F.round("fraud_probability", 4))


SIMPLE_PREDICTIONS = "WITH " + PRED_SQL + """ SELECT transaction_id, round(fraud_probability, 4) AS fraud_probability,
  CASE WHEN fraud_probability >= 0.85 THEN 'critical' WHEN fraud_probability >= 0.6 THEN 'high' WHEN fraud_probability >= 0.3 THEN 'medium' ELSE 'low' END AS risk_tier,
  'v9' AS model_version FROM pred"""


def flatten_requests(spark, sf_dir):
    """Nested requests, some without user signals, flattened; later groups overwrite earlier."""
    p = predictions(spark, sf_dir)
    tid = F.col("transaction_id")
    nested = p.select(
        F.struct("transaction_id", "amount", "device_type").alias("transaction"),
        F.when(tid % 3 != 0, F.struct("account_age_days", "previous_fraud_flags")).alias("user_signals"),
        F.when(tid % 2 == 0, F.struct(F.lit("pos").alias("device_type"), "is_vpn")).alias("device_signals"),
    )
    return scoring.flatten_request(nested)


FLATTEN_REQUESTS = "WITH " + PRED_SQL + """ SELECT transaction_id, amount, CASE WHEN transaction_id % 2 = 0 THEN 'pos' ELSE device_type END AS device_type,
  CASE WHEN transaction_id % 3 <> 0 THEN account_age_days END AS account_age_days, CASE WHEN transaction_id % 3 <> 0 THEN previous_fraud_flags END AS previous_fraud_flags,
  CASE WHEN transaction_id % 2 = 0 THEN is_vpn END AS is_vpn FROM pred"""

QUERIES = {
    "pre_score_rules": pre_score_rules, "decisions": decisions, "triggered_rules": triggered_rules, "special_rules": special_rules,
    "decision_explained": decision_explained, "degraded_check": degraded_check, "contribution_reasons": contribution_reasons,
    "simple_predictions": simple_predictions, "flatten_requests": flatten_requests,
}
ORACLE = {
    "pre_score_rules": PRE_SCORE_RULES, "decisions": DECISIONS, "triggered_rules": TRIGGERED_RULES, "special_rules": SPECIAL_RULES,
    "decision_explained": DECISION_EXPLAINED, "degraded_check": DEGRADED_CHECK, "contribution_reasons": CONTRIBUTION_REASONS,
    "simple_predictions": SIMPLE_PREDICTIONS, "flatten_requests": FLATTEN_REQUESTS,
}
