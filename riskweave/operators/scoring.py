"""Score, decide and explain: the decision table from a context table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import band_of
from .rules import RuleSet, simple_rules, with_verdicts

# fixed values: risk tiers as (name, lower bound)
TIERS = (("low", 0.0), ("medium", 0.3), ("high", 0.6), ("critical", 0.85))
# fixed values: explained features with text and weight, in reporting order
EXPLAINED = (
    ("is_vpn", "VPN/proxy detected", 0.2),
    ("is_new_device", "First transaction from this device", 0.15),
    ("is_emulator", "Running on emulator", 0.25),
    ("txn_count_1h", "High transaction frequency", 0.1),
    ("previous_fraud_flags", "Account has fraud history", 0.3),
    ("account_age_days", "New account", 0.1),
)
# fixed values: reason texts by reason key
REASON_TEMPLATES = {
    "amount_zscore_high": "Transaction amount is unusually high for this user",
    "amount_zscore_low": "Transaction amount is unusually low (test transaction?)",
    "is_new_device": "Transaction from a device we haven't seen before",
    "is_vpn": "Transaction through VPN or proxy connection",
    "is_night": "Transaction at unusual hour ({hour}:00)",
    "login_hour_deviation_high": "Login time differs from user's normal pattern",
    "txn_count_1h_high": "Too many transactions in the last hour ({value})",
    "txn_count_24h_high": "Too many transactions in the last 24 hours ({value})",
    "days_since_last_txn_high": "First transaction after long inactivity ({value} days)",
    "account_age_days_low": "Account is very new ({value} days old)",
    "is_verified_false": "Account has not completed verification",
    "merchant_fraud_rate_high": "Merchant has elevated fraud rate",
    "merchant_complaint_rate_high": "Merchant has elevated complaint rate",
    "recipient_fraud_flags": "Recipient has fraud history",
    "shared_devices_count_high": "Device shared across multiple accounts",
    "shared_bank_accounts_high": "Bank account used by multiple users",
    "refund_abuse_score_high": "Pattern consistent with refund abuse",
    "failed_logins_24h_high": "Multiple failed login attempts recently",
    "network_risk_score_high": "Connected to high-risk network cluster",
}
MAX_REASONS = 5

Scorer = Callable[[DataFrame], DataFrame]  # adds a ``score`` column


def risk_tier(score: Column) -> Column:
    return F.coalesce(band_of(score, TIERS), F.lit("critical"))


def rounded_score(score: Column) -> Column:
    return F.bround(score, 4)


def flatten_request(df: DataFrame, groups: Sequence[str] = ("transaction", "user_signals", "device_signals",
                                                            "velocity_signals", "network_signals")) -> DataFrame:
    """One flat context row per nested request; a field of a later, present group replaces an
    earlier one of the same name."""
    chosen: dict[str, Column] = {}
    for g in groups:
        if g not in df.columns:
            continue
        for f in df.schema[g].dataType.fieldNames():
            value = F.col(g)[f]
            if f in chosen:
                value = F.when(F.col(g).isNotNull(), value).otherwise(chosen[f])
            chosen[f] = value
    rest = [c for c in df.columns if c not in groups and c not in chosen]
    return df.select(*[c.alias(n) for n, c in chosen.items()], *rest)


def reasons(columns: Sequence[str]) -> Column:
    """Up to five (feature, description, contribution, value, severity) entries, in fixed order.

    A feature counts when it is 1 or above 3; an account older than 30 days does not.
    """
    entries = []
    for name, text, weight in EXPLAINED:
        if name not in columns:
            continue
        value = F.col(name).cast("double")
        counts = (value == 1) | (value > 3)
        if name == "account_age_days":
            counts = counts & (value <= 30)
        entry = F.struct(
            F.lit(name).alias("feature"), F.lit(text).alias("description"), F.lit(weight).alias("contribution"),
            F.lit("high" if weight > 0.15 else "medium").alias("severity"),
        )
        entries.append(F.when(counts, entry))
    if not entries:
        return F.from_json(F.lit("[]"), "array<struct<feature:string,description:string,contribution:double,severity:string>>")
    return F.slice(F.array_compact(F.array(*entries)), 1, MAX_REASONS)


def check_transactions(
    context: DataFrame, scorer: Scorer | None, rules: RuleSet | None = None, *,
    model_version: str = "v1", explain: bool = True, score_all: bool = False,
) -> DataFrame:
    """The decision table. Rows stopped by an early rule are never scored.

    That takes two branches over what lies below. With ``score_all`` there is one: the scorer, which keeps all columns
    and rows, sees stopped rows too, and their score is not used. Choose it where making the rows costs more than
    scoring the few that are stopped.

    Without a scorer every other row gets score 0.5, action "challenge" and a system reason.
    """
    rules = rules or simple_rules()
    names = context.columns
    tagged = with_verdicts(context, {"_early": rules.before_score(names)})
    early, empty = F.col("_early"), F.slice(reasons(names), 1, 0)
    stopped = early.isNotNull()
    none = F.lit(None).cast("string")

    def either(blocked: Column, other: Column) -> Column:
        return F.when(stopped, blocked).otherwise(other)

    def response(df: DataFrame, score: Column, tier: Column, action: Column, challenge: Column, reason: Column, why: Column, rule: Column) -> DataFrame:
        """Stopped rows answer by their rule, all others as given; one pass over the rows."""
        one = F.lit(1.0)
        return df.select(
            "transaction_id", either(rounded_score(one), rounded_score(score)).alias("risk_score"),
            either(risk_tier(one), tier).alias("risk_tier"), either(early["action"], action).alias("action"),
            either(early["challenge_type"], challenge).alias("challenge_type"), either(early["reason"], reason).alias("action_reason"),
            either(empty, why).alias("risk_reasons"), F.lit(model_version).alias("model_version"),
            either(early["rule_name"], rule).alias("rule_triggered"),
        )

    if scorer is None:
        system = F.array(F.struct(
            F.lit("system").alias("feature"), F.lit("No model available, manual check needed").alias("description"),
            F.lit(0.0).alias("contribution"), F.lit("medium").alias("severity"),
        ))
        return response(
            tagged, F.lit(0.5), F.lit("medium"), F.lit("challenge"), F.lit("otp"), F.lit("Model not loaded"), system, none
        )
    scored = scorer(tagged if score_all else tagged.filter(~stopped))
    # an early rule's row keeps no score, whatever the scorer made of it
    score = F.when(~stopped, F.col("score"))
    late = rules.decide(score, [c for c in scored.columns if c != "_early"])
    decided = with_verdicts(scored, {"_v": late})
    v = F.col("_v")
    why = reasons(names) if explain else empty
    answered = response(decided, score, risk_tier(score), v["action"], v["challenge_type"], v["reason"], why, v["rule_name"])
    if score_all:
        return answered
    blank = F.lit(None).cast("double")
    return answered.unionByName(response(tagged.filter(stopped), blank, none, none, none, none, empty, none))


def simple_prediction(scored: DataFrame, model_version: str = "v1") -> DataFrame:
    """(transaction_id, fraud_probability rounded, risk_tier, model_version) from a scored table."""
    return scored.select(
        "transaction_id", rounded_score(F.col("score")).alias("fraud_probability"),
        risk_tier(F.col("score")).alias("risk_tier"), F.lit(model_version).alias("model_version"),
    )


def reason_text(key: Column, value: Column, hour: Column | None = None,
                templates: Mapping[str, str] = REASON_TEMPLATES) -> Column:
    """The template of a reason key with its placeholders filled; unknown keys read as
    "Unusual value of <key>"."""
    table = F.create_map(*[x for k, t in templates.items() for x in (F.lit(k), F.lit(t))])
    text = F.coalesce(
        F.element_at(table, key), F.element_at(table, F.concat(key, F.lit("_high"))),
        F.element_at(table, F.concat(key, F.lit("_low"))), F.concat(F.lit("Unusual value of "), key),
    )
    shown = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    text = F.replace(text, F.lit("{value}"), F.coalesce(shown, F.lit("")))
    hours = shown if hour is None else hour.cast("string")
    return F.replace(text, F.lit("{hour}"), F.coalesce(hours, F.lit("")))


def top_contributions(contributions: Column, values: Column, top_k: int = MAX_REASONS) -> Column:
    """The ``top_k`` entries of a contribution map by absolute size, ties by name.

    Severity by size: above 0.3 critical, above 0.15 high, above 0.05 medium, else low.
    """
    entries = F.transform(
        F.map_entries(contributions),
        lambda e: F.struct(-F.abs(e["value"]).alias("rank"), e["key"].alias("feature"), e["value"].alias("contribution")),
    )
    best = F.slice(F.array_sort(entries), 1, top_k)

    def describe(e: Column) -> Column:
        value = F.element_at(values, e["feature"])
        size = F.abs(e["contribution"])
        severity = F.when(size > 0.3, "critical").when(size > 0.15, "high").when(size > 0.05, "medium").otherwise("low")
        return F.struct(
            e["feature"].alias("feature"), reason_text(e["feature"], value).alias("description"),
            e["contribution"].alias("contribution"), value.alias("value"), severity.alias("severity"),
        )

    return F.transform(best, describe)


def explain_contributions(df: DataFrame, contributions: str = "contributions", values: str = "values",
                          top_k: int = MAX_REASONS) -> DataFrame:
    """Add ``risk_reasons``; rows without contributions fall back to the fixed value rules."""
    fallback_weights = F.create_map(*[x for n, _, w in EXPLAINED for x in (F.lit(n), F.lit(w))])
    by_rule = F.map_filter(
        fallback_weights,
        lambda name, _: F.coalesce((F.element_at(F.col(values), name) == 1) | (F.element_at(F.col(values), name) > 3), F.lit(False))
        & ~((name == "account_age_days") & (F.coalesce(F.element_at(F.col(values), name), F.lit(0.0)) > 30)),
    )
    used = F.coalesce(F.col(contributions), by_rule)
    return df.withColumn("risk_reasons", top_contributions(used, F.col(values), top_k))


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    """The k most important features of an importance table; k rows at most reach one task."""
    return importance.orderBy(F.desc("importance"), "feature").limit(k)
