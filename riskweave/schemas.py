"""Canonical tables and record rules."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    """One field of a record: type, value used when it is null, bounds, allowed values."""

    name: str
    type: str
    required: bool = False
    default: object = None
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] = ()


# --- fixed values: enumerations -------------------------------------------------------------
TRANSACTION_TYPES = ("payment", "withdrawal", "transfer", "refund", "order", "top_up")
VERIFICATION_LEVELS = ("none", "basic", "standard", "full")
RISK_TIERS = ("low", "medium", "high", "critical")
ACTIONS = ("allow", "challenge", "block", "manual_review")
CHALLENGES = ("otp", "security_question", "selfie_verification", "manual_review", "hold_funds")
MERCHANT_CATEGORIES = (
    "retail", "travel", "entertainment", "groceries", "other", "electronics", "restaurants",
    "utilities", "healthcare", "food", "services", "online", "gaming",
)
DEVICE_TYPES = ("mobile", "desktop", "tablet", "unknown", "pos")
LABEL_SOURCES = (
    "chargeback", "manual_review", "user_report", "automated", "investigation", "auto_confirm", "unknown",
)

# --- fixed values: record fields with their bounds and defaults ------------------------------
TRANSACTION_FIELDS = (
    Field("transaction_id", "string", required=True),
    Field("timestamp", "timestamp", required=True),
    Field("amount", "double", required=True, low=0, high=10_000_000),
    Field("currency", "string", default="NGN"),
    Field("transaction_type", "string", default="payment", allowed=TRANSACTION_TYPES),
    Field("merchant_id", "string", required=True),
    Field("merchant_category", "string", required=True),
    Field("channel", "string", default="app"),
    Field("user_id", "string", required=True),
    Field("device_type", "string"),
    Field("location_country", "string"),
    Field("recipient_id", "string"),
    Field("hour_of_day", "bigint", low=0, high=23),
    Field("day_of_week", "bigint", low=0, high=6),
    Field("is_weekend", "boolean"),
    Field("is_night", "boolean"),
)
LABEL_FIELDS = (
    Field("transaction_id", "string", required=True),
    Field("is_fraud", "bigint", required=True, low=0, high=1),
    Field("label_timestamp", "timestamp", required=True),
    Field("label_source", "string"),
    Field("fraud_type", "string"),
)
USER_FIELDS = (
    Field("user_id", "string", required=True),
    Field("account_age_days", "bigint", default=0, low=0),
    Field("is_verified", "boolean", default=False),
    Field("verification_level", "string", default="none", allowed=VERIFICATION_LEVELS),
    Field("previous_fraud_flags", "bigint", default=0, low=0),
    Field("is_blocked", "boolean", default=False),
    Field("total_lifetime_transactions", "bigint", default=0, low=0),
    Field("total_lifetime_amount", "double", default=0.0, low=0),
    Field("days_since_last_transaction", "bigint", low=0),
    Field("avg_transaction_amount", "double", low=0),
    Field("transaction_frequency_weekly", "double", low=0),
    Field("chargebacks_90d", "bigint", default=0, low=0),
    Field("refunds_90d", "bigint", default=0, low=0),
    Field("disputes_90d", "bigint", default=0, low=0),
)
DEVICE_FIELDS = (
    Field("device_id", "string"),
    Field("is_new_device", "boolean", default=False),
    Field("device_age_days", "bigint", low=0),
    Field("device_type", "string", default="unknown"),
    Field("is_vpn", "boolean", default=False),
    Field("is_emulator", "boolean", default=False),
    Field("is_rooted", "boolean", default=False),
    Field("is_tor", "boolean", default=False),
    Field("ip_address", "string"),
    Field("ip_country", "string"),
    Field("ip_country_mismatch", "boolean", default=False),
    Field("login_hour_deviation", "double"),
    Field("failed_logins_24h", "bigint", default=0, low=0),
    Field("session_duration_minutes", "double", low=0),
    Field("devices_last_30d", "bigint", default=1, low=1),
)
NETWORK_FIELDS = (
    Field("shared_bank_accounts", "bigint", default=0, low=0),
    Field("shared_devices_count", "bigint", default=0, low=0),
    Field("shared_ip_count", "bigint", default=0, low=0),
    Field("shared_phone_count", "bigint", default=0, low=0),
    Field("merchant_age_days", "bigint", low=0),
    Field("merchant_transaction_count", "bigint", low=0),
    Field("merchant_complaint_rate", "double", low=0, high=1),
    Field("merchant_fraud_rate", "double", low=0, high=1),
    Field("merchant_chargeback_rate", "double", low=0, high=1),
    Field("recipient_fraud_flags", "bigint", default=0, low=0),
    Field("recipient_is_new", "boolean", default=False),
    Field("refund_abuse_score", "double", low=0, high=1),
    Field("network_risk_score", "double", low=0, high=1),
)
VELOCITY_FIELDS = (
    Field("txn_count_10m", "bigint", default=0, low=0),
    Field("txn_count_1h", "bigint", default=0, low=0),
    Field("txn_count_6h", "bigint", default=0, low=0),
    Field("txn_count_24h", "bigint", default=0, low=0),
    Field("txn_count_7d", "bigint", default=0, low=0),
    Field("txn_count_30d", "bigint", default=0, low=0),
    Field("amount_sum_10m", "double", default=0.0, low=0),
    Field("amount_sum_1h", "double", default=0.0, low=0),
    Field("amount_sum_24h", "double", default=0.0, low=0),
    Field("amount_sum_7d", "double", default=0.0, low=0),
    Field("unique_merchants_24h", "bigint", default=0, low=0),
    Field("unique_recipients_24h", "bigint", default=0, low=0),
    Field("unique_ips_24h", "bigint", default=0, low=0),
    Field("failed_attempts_1h", "bigint", default=0, low=0),
    Field("declined_count_24h", "bigint", default=0, low=0),
)
# -----------------------------------------------------------------------------------------

RECORDS = {
    "transaction": TRANSACTION_FIELDS,
    "label": LABEL_FIELDS,
    "user": USER_FIELDS,
    "device": DEVICE_FIELDS,
    "network": NETWORK_FIELDS,
    "velocity": VELOCITY_FIELDS,
}


def record_ddl(fields: tuple[Field, ...]) -> str:
    return ", ".join(f"`{f.name}` {f.type}" for f in fields)


STREAM_EVENT = (
    "transaction_id string, user_id string, merchant_id string, merchant_category string, amount double, "
    "device_id string, device_type string, location_country string, timestamp timestamp, "
    "metadata map<string,string>"
)
STREAM_PREDICTION = (
    "transaction_id string, fraud_probability double, decision string, risk_level string, "
    "triggered_rules array<string>, model_version string, latency_ms double, timestamp timestamp"
)
PREDICTION_LOG = (
    "transaction_id string, prediction_timestamp timestamp, predicted_score double"
)
SNAPSHOT = (
    "entity_id string, entity_type string, features map<string,double>, timestamp timestamp, ttl_seconds bigint"
)
ALERT = (
    "name string, severity string, message string, timestamp timestamp, source string, details map<string,string>"
)
TRIGGER = (
    "trigger_id string, reason string, timestamp timestamp, metrics_snapshot map<string,double>, "
    "threshold_violated string, model_version_before string, model_version_after string, status string, notes string"
)
