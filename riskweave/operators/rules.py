"""Business rules as column expressions.

A rule is a name, a condition over the row's columns, an action and a priority. A column the
table does not have, or a null in it, counts as the stated default. All rules of a set compile
into one projection.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRITICAL, HIGH, MEDIUM, LOW = 1, 2, 3, 4


class Row:
    """Resolves a column of the table, or its default."""

    def __init__(self, columns: Sequence[str]):
        self.columns = set(columns)

    def __call__(self, name: str, default) -> Column:
        if name not in self.columns:
            return F.lit(default)
        col = F.col(name)
        if isinstance(default, bool):
            col = col.cast("boolean")
        return F.coalesce(col, F.lit(default))


Condition = Callable[[Row], Column] | str


@dataclass(frozen=True)
class Rule:
    """``condition`` is a function of ``Row`` or SQL text over the table's columns."""

    name: str
    condition: Condition
    action: str
    priority: int = MEDIUM
    challenge_type: str | None = None
    description: str = ""

    def fires(self, row: Row) -> Column:
        cond = F.expr(self.condition) if isinstance(self.condition, str) else self.condition(row)
        return F.coalesce(cond.cast("boolean"), F.lit(False))


def _over(row: Row, name: str, limit: float) -> Column:
    return row(name, 0) > limit


# --- fixed values: the engine's rules, their limits, actions and texts -----------------------
ENGINE_RULES = (
    Rule("blocked_user", lambda r: r("user_is_blocked", False), "block", CRITICAL, None, "User on blocklist"),
    Rule("blocked_device", lambda r: r("device_is_blocked", False), "block", CRITICAL, None, "Device on blocklist"),
    Rule("repeat_fraudster", lambda r: r("previous_fraud_flags", 0) >= 2, "block", CRITICAL, None, "Multiple fraud flags"),
    Rule("velocity_1h", lambda r: _over(r, "txn_count_1h", 20), "block", HIGH, None, ">20 txns in 1 hour"),
    Rule("velocity_10m", lambda r: _over(r, "txn_count_10m", 5), "challenge", HIGH, "otp", ">5 txns in 10 min"),
    Rule("amount_24h", lambda r: _over(r, "amount_sum_24h", 1_000_000), "challenge", HIGH, "manual_review",
         "Daily limit exceeded"),
    Rule("vpn_high_amount", lambda r: r("is_vpn", False) & _over(r, "amount", 50_000), "challenge", HIGH, "otp",
         "VPN + high amount"),
    Rule("emulator", lambda r: r("is_emulator", False), "challenge", HIGH, "selfie_verification", "Emulator detected"),
    Rule("new_device_high", lambda r: r("is_new_device", False) & _over(r, "amount", 100_000), "challenge", MEDIUM, "otp",
         "New device + high amount"),
    Rule("new_user_high", lambda r: (r("account_age_days", 999) < 3) & _over(r, "amount", 50_000), "challenge", MEDIUM,
         "manual_review", "New account + high amount"),
    Rule("unverified_high", lambda r: ~r("is_verified", True) & _over(r, "amount", 100_000), "challenge", MEDIUM,
         "selfie_verification", "Unverified + high amount"),
)
SIMPLE_RULE_NAMES = (
    "blocked_user", "blocked_device", "repeat_fraudster", "velocity_1h", "velocity_10m", "vpn_high_amount", "emulator",
)
SPECIAL_RULES = (
    Rule("blocked_user", lambda r: r("user_is_blocked", False), "block", CRITICAL, None, "User is on blocklist"),
    Rule("sanctioned_country", lambda r: r("location_country", "").isin("XX", "YY"), "block", CRITICAL, None, "Sanctioned country"),
    Rule("velocity_breach", lambda r: _over(r, "txn_count_1h", 50), "block", CRITICAL, None, "Velocity limit exceeded"),
    Rule("high_amount_new_user", lambda r: _over(r, "amount", 100_000) & (r("account_age_days", 999) < 7), "challenge", HIGH,
         "manual_review", "High amount from new account"),
    Rule("new_device_high_amount", lambda r: r("is_new_device", False) & _over(r, "amount", 50_000), "challenge", HIGH, "otp",
         "High amount from new device"),
    Rule("whitelisted_merchant", lambda r: r("is_whitelisted_merchant", False), "allow", MEDIUM, None, "Whitelisted merchant"),
)
# thresholds per transaction type as (challenge from, block from)
ENGINE_THRESHOLDS = {"payment": (0.70, 0.90), "transfer": (0.60, 0.85), "withdrawal": (0.60, 0.85)}
SIMPLE_THRESHOLDS = {"payment": (0.70, 0.90)}
CONFIG_THRESHOLDS = {"payment": (0.70, 0.90), "withdrawal": (0.40, 0.70), "refund": (0.30, 0.60), "transfer": (0.50, 0.75)}
# ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class RuleSet:
    """Rules with score thresholds.

    ``block_before_score``: "critical" lets only critical rules decide before the score (a
    block rule of lower priority is then never evaluated), "all" every block rule.
    """

    rules: tuple[Rule, ...]
    thresholds: Mapping[str, tuple[float, float]] = field(default_factory=lambda: dict(ENGINE_THRESHOLDS))
    block_before_score: str = "critical"
    otp_only: bool = False

    def add(self, rule: Rule) -> "RuleSet":
        """A new set with the rule added; the order is by priority, then by insertion."""
        ordered = tuple(sorted((*self.rules, rule), key=lambda r: r.priority))
        return RuleSet(ordered, self.thresholds, self.block_before_score, self.otp_only)

    def _early(self) -> list[Rule]:
        if self.block_before_score == "all":
            return [r for r in self.rules if r.action == "block" or r.priority == CRITICAL]
        return [r for r in self.rules if r.priority == CRITICAL]

    def _late(self) -> list[Rule]:
        early = self._early()
        return [r for r in self.rules if r not in early and r.action in ("challenge", "allow")]

    def _verdict(self, rule: Rule) -> Column:
        challenge = "otp" if self.otp_only and rule.action == "challenge" else rule.challenge_type
        return verdict(rule.name, rule.action, challenge, rule.description)

    def before_score(self, columns: Sequence[str]) -> Column:
        """The verdict of the first early rule that fires, else null."""
        return self._first(self._early(), columns)

    def _first(self, rules: Sequence[Rule], columns: Sequence[str]) -> Column:
        row = Row(columns)
        empty = F.when(F.lit(False), verdict("", "", None, ""))
        return F.coalesce(*[F.when(r.fires(row), self._verdict(r)) for r in rules], empty)

    def decide(self, score: Column, columns: Sequence[str], kind: str = "transaction_type") -> Column:
        """The verdict after scoring: late rules first, then the score thresholds."""
        kinds = F.col(kind) if kind in columns else F.lit("payment")
        base = self.thresholds["payment"]
        challenge, block = F.lit(base[0]), F.lit(base[1])
        for name, (c, b) in self.thresholds.items():
            challenge = F.when(kinds == name, c).otherwise(challenge)
            block = F.when(kinds == name, b).otherwise(block)
        how = F.lit("otp") if self.otp_only else F.when(score < 0.85, "otp").otherwise("selfie_verification")
        elevated = "Elevated risk - verification needed" if self.otp_only else "Elevated risk"
        by_score = (
            F.when(score >= block, verdict("score_block", "block", None, "Risk score too high"))
            .when(score >= challenge, verdict("score_challenge", "challenge", how, elevated))
            .otherwise(verdict(None, "allow", None, "Risk acceptable"))
        )
        return F.coalesce(self._first(self._late(), columns), by_score)

    def fired(self, columns: Sequence[str]) -> Column:
        """Names of all rules that fire, in order."""
        row = Row(columns)
        return F.array_compact(F.array(*[F.when(r.fires(row), F.lit(r.name)) for r in self.rules]))


def verdict(rule, action, challenge, reason) -> Column:
    challenge = challenge if isinstance(challenge, Column) else F.lit(challenge).cast("string")
    return F.struct(
        F.lit(rule).cast("string").alias("rule_name"), F.lit(action).alias("action"),
        challenge.alias("challenge_type"), F.lit(reason).alias("reason"),
    )


def engine_rules() -> RuleSet:
    return RuleSet(ENGINE_RULES)


def simple_rules() -> RuleSet:
    """The short set: any block rule decides before the score; challenges are always by OTP."""
    chosen = tuple(
        Rule(r.name, r.condition, r.action, r.priority, r.challenge_type,
             f"Rule triggered: {r.name}" if r.action == "block" else f"Rule: {r.name}")
        for r in ENGINE_RULES if r.name in SIMPLE_RULE_NAMES
    )
    return RuleSet(chosen, dict(SIMPLE_THRESHOLDS), "all", True)


def special_rules() -> RuleSet:
    """The configured override rules with the per-type threshold overrides."""
    return RuleSet(SPECIAL_RULES, dict(CONFIG_THRESHOLDS), "all")


def rules_from_config(items: Sequence[Mapping[str, str]]) -> tuple[Rule, ...]:
    """Rules from configuration: name, condition (SQL text), action, challenge_type, reason."""
    rank = {"block": CRITICAL, "challenge": HIGH}
    return tuple(
        Rule(i["name"], i["condition"], i["action"], rank.get(i["action"], MEDIUM), i.get("challenge_type"), i.get("reason", ""))
        for i in items
    )


def unresolved(df: DataFrame, rules: RuleSet) -> list[str]:
    """Names of rules whose condition does not fit the table (an absent column, a wrong type, no valid SQL).

    All are resolved by one analysis; only if that fails each is tried by itself. No job runs.
    """
    row = Row(df.columns)

    def fits(some: Sequence[Rule]) -> bool:
        try:
            df.select(*[rule.fires(row).alias(f"_{i}") for i, rule in enumerate(some)]).schema
        except AnalysisException:
            return False
        return True

    return [] if fits(rules.rules) else [rule.name for rule in rules.rules if not fits([rule])]


@contextmanager
def errors_as_null(spark: SparkSession) -> Iterator[None]:
    """Expressions built inside give null where a row's values would make them fail (a bad cast, a division by zero)."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def with_verdicts(df: DataFrame, verdicts: Mapping[str, Column]) -> DataFrame:
    """Add columns made of rule conditions. A condition that fails on a row does not fire there; the row goes on to the
    next rule and the job goes on."""
    with errors_as_null(df.sparkSession):
        return df.withColumns(dict(verdicts))


def bind(df: DataFrame, rules: RuleSet) -> RuleSet:
    """The set without the rules that do not fit the table; each is reported as a warning and never fires."""
    skipped = set(unresolved(df, rules))
    for name in sorted(skipped):
        warnings.warn(f"rule {name!r} does not fit the table and is skipped", stacklevel=3)
    return replace(rules, rules=tuple(r for r in rules.rules if r.name not in skipped)) if skipped else rules


def check_before_score(df: DataFrame, rules: RuleSet) -> DataFrame:
    """Add ``triggered``, ``rule_name``, ``action`` and ``reason`` of the early rules."""
    rules = bind(df, rules)
    return with_verdicts(df, {"_v": rules.before_score(df.columns)}).select(
        *df.columns, F.col("_v").isNotNull().alias("triggered"), F.col("_v.rule_name").alias("rule_name"),
        F.col("_v.action").alias("action"), F.col("_v.reason").alias("reason"),
    )


def decide(df: DataFrame, rules: RuleSet, score: str = "score", kind: str = "transaction_type") -> DataFrame:
    """Add rule_name, action, challenge_type and reason from late rules and the score."""
    verdicts = {"_v": bind(df, rules).decide(F.col(score), df.columns, kind)}
    return with_verdicts(df, verdicts).select(*df.columns, "_v.*")


def triggered_rules(df: DataFrame, rules: RuleSet) -> DataFrame:
    return with_verdicts(df, {"triggered_rules": bind(df, rules).fired(df.columns)})
