"""Feature expressions and the fit/transform pipeline.

Fitting runs a few aggregates; transforming is one projection, so Spark compiles it into the
scan stage. Each group of features is built only when its input columns exist.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bounded, log1p_floor, one_if
from .scan import HOT_ROWS, exact_quantiles

DEFAULT_CATEGORICAL = ("merchant_category", "device_type")


def time_features(ts: Column) -> dict[str, Column]:
    hour, day = F.hour(ts), F.weekday(ts)
    angle = hour * (2 * math.pi) / 24
    return {
        "hour": hour,
        "day_of_week": day,
        "is_weekend": one_if(day >= 5),
        "is_night": one_if((hour >= 22) | (hour < 6)),
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
    }


def fit_amount(df: DataFrame, column: str = "amount", min_rows: int = HOT_ROWS) -> dict[str, float]:
    """Mean, sample deviation (0 counts as 1) and the interpolated 95th percentile."""
    basic = df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")).first()
    q = exact_quantiles(df, [], column, [0.95], min_rows=min_rows).first()
    return {
        "mean": basic["mean"],
        "std": 1.0 if basic["std"] == 0 else basic["std"],
        "p95": None if q is None else q["q"][0],
    }


def amount_features(amount: Column, fit: dict[str, float] | None = None) -> dict[str, Column]:
    out = {"amount": bounded(amount.cast("double"), 0.0, 1e6), "amount_log": log1p_floor(amount)}
    if fit is not None:
        mean, std, p95 = (F.lit(fit[k]).cast("double") for k in ("mean", "std", "p95"))
        out["amount_zscore"] = (amount - mean) / std
        out["amount_high"] = one_if(amount > p95)
    return out


def fit_categories(df: DataFrame, column: str, top: int = 20) -> list[str]:
    """The most frequent non-null values, ties in value order; at most ``top`` reach the driver."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).count()
    return [r[0] for r in counts.orderBy(F.desc("count"), column).limit(top).collect()]


def one_hot(column: str, categories: Sequence[str]) -> dict[str, Column]:
    """A flag per category and a catch-all, which is also set for null. A literal category
    "other" shares the catch-all's column."""
    col = F.col(column)
    out = {f"{column}_{c}": one_if(col == F.lit(c)) for c in categories if str(c) != "other"}
    named = [c for c in categories if str(c) != "other"]
    rest = ~col.isin(*named) if named else F.lit(True)
    out[f"{column}_other"] = one_if(F.coalesce(rest, F.lit(True)))
    return out


def _clip0(name: str, high: float) -> Column:
    return bounded(F.coalesce(F.col(name), F.lit(0)), 0, high)


def device_features(columns: Sequence[str]) -> dict[str, Column]:
    have = set(columns)
    out = {
        c: F.col(c).cast("int")
        for c in ("is_vpn", "is_new_device", "is_emulator", "is_rooted", "is_foreign")
        if c in have
    }
    if "failed_logins_24h" in have:
        out["failed_logins"] = _clip0("failed_logins_24h", 20)
        out["has_failed_logins"] = one_if(F.col("failed_logins_24h") > 0)
    flags = [c for c in ("is_vpn", "is_new_device", "is_emulator", "is_rooted") if c in have]
    if flags:
        total = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in flags), F.lit(0))
        out["device_risk"] = total / F.lit(float(len(flags)))
    return out


def user_features(columns: Sequence[str]) -> dict[str, Column]:
    have, out = set(columns), {}
    if "account_age_days" in have:
        age = F.coalesce(F.col("account_age_days"), F.lit(0))
        out["account_age"] = bounded(age, 0, 3650)
        out["account_age_log"] = F.log1p(age.cast("double"))
        out["is_new_account"] = one_if(age < 30)
    if "is_verified" in have:
        out["is_verified"] = F.col("is_verified").cast("int")
    if "previous_fraud_flags" in have:
        out["fraud_flags"] = _clip0("previous_fraud_flags", 10)
        out["has_fraud_history"] = one_if(F.col("previous_fraud_flags") > 0)
    for c in ("chargebacks_90d", "refunds_90d"):
        if c in have:
            out[c] = _clip0(c, 20)
    return out


# fixed values: counts above which a window counts as breached
BREACH = {"1h": 5, "24h": 20}


def velocity_columns(columns: Sequence[str]) -> dict[str, Column]:
    have, out = set(columns), {}
    for w in ("1h", "24h", "7d"):
        c = f"txn_count_{w}"
        if c in have:
            out[c] = _clip0(c, 500)
            out[f"{c}_log"] = F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double"))
    for w in ("24h", "7d"):
        c = f"amount_sum_{w}"
        if c in have:
            out[c] = bounded(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 0.0, 1e7)
    for w, limit in BREACH.items():
        if f"txn_count_{w}" in have:
            out[f"velocity_breach_{w}"] = one_if(F.col(f"txn_count_{w}") > limit)
    return out


def network_features(columns: Sequence[str]) -> dict[str, Column]:
    have, out = set(columns), {}
    if "shared_devices_count" in have:
        out["shared_devices"] = _clip0("shared_devices_count", 50)
        out["has_shared_device"] = one_if(F.col("shared_devices_count") > 0)
    if "merchant_fraud_rate" in have:
        rate = F.coalesce(F.col("merchant_fraud_rate").cast("double"), F.lit(0.0))
        out["merchant_fraud_rate"] = bounded(rate, 0.0, 1.0)
        out["high_risk_merchant"] = one_if(rate > 0.1)
    return out


class RiskFeatures(Estimator):
    """Learns amount statistics and category lists; ``fit`` returns a ``RiskFeaturesModel``.

    ``numerical`` columns are passed through as they are; ``categorical`` are one-hot encoded.
    """

    def __init__(
        self,
        categorical: Sequence[str] = DEFAULT_CATEGORICAL,
        numerical: Sequence[str] = (),
        top: int = 20,
        min_rows: int = HOT_ROWS,
    ):
        super().__init__()
        self.categorical, self.numerical = list(categorical), list(numerical)
        self.top, self.min_rows = top, min_rows

    def _fit(self, dataset: DataFrame) -> "RiskFeaturesModel":
        amount = fit_amount(dataset, min_rows=self.min_rows) if "amount" in dataset.columns else None
        cats = {c: fit_categories(dataset, c, self.top) for c in self.categorical if c in dataset.columns}
        model = RiskFeaturesModel(amount, cats, self.numerical)
        model.feature_names = [c for c in model.transform(dataset.limit(0)).columns]
        return model

    def fit_transform(self, dataset: DataFrame) -> DataFrame:
        return self.fit(dataset).transform(dataset)

    def transform(self, dataset: DataFrame) -> DataFrame:
        raise RuntimeError("Call fit() first")


class RiskFeaturesModel(Model):
    """The learned statistics; ``transform`` is one projection with nulls replaced by 0."""

    def __init__(self, amount: dict | None, categories: dict[str, list], numerical: Sequence[str] = ()):
        super().__init__()
        self.amount, self.categories, self.numerical = amount, categories, list(numerical)
        self.feature_names: list[str] = []

    def expressions(self, columns: Sequence[str]) -> dict[str, Column]:
        have, out = set(columns), {}
        if "timestamp" in have:
            out |= time_features(F.col("timestamp"))
        if "amount" in have:
            out |= amount_features(F.col("amount"), self.amount)
        for c, cats in self.categories.items():
            if c in have:
                out |= one_hot(c, cats)
        for group in (device_features, user_features, velocity_columns, network_features):
            out |= group(columns)
        for c in self.numerical:
            if c in have and c not in out:
                out[c] = F.col(c)
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keep = [F.col("transaction_id")] if "transaction_id" in dataset.columns else []
        exprs = self.expressions(dataset.columns)
        return dataset.select(*keep, *[_zero_null(e).alias(n) for n, e in exprs.items()])

    def save(self, path: str, spark: SparkSession) -> None:
        """Write the fitted statistics as a small Parquet table."""
        rows = [("amount", json.dumps(self.amount)), ("numerical", json.dumps(self.numerical)),
                ("feature_names", json.dumps(self.feature_names)), ("categories", json.dumps(self.categories))]
        spark.createDataFrame(rows, "part string, content string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "RiskFeaturesModel":
        parts = {r["part"]: json.loads(r["content"]) for r in spark.read.parquet(path).collect()}
        model = cls(parts["amount"], parts["categories"], parts["numerical"])
        model.feature_names = parts["feature_names"]
        return model


def _zero_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def model_inputs(features: DataFrame) -> list[str]:
    """Numeric columns without the id: what a model is trained on."""
    return [
        f.name
        for f in features.schema.fields
        if f.name != "transaction_id" and isinstance(f.dataType, T.NumericType)
    ]
