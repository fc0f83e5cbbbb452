"""Facts about users, merchants, devices and what they share, plus list membership."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import micros, one_if
from ..session import cut_lineage
from .scan import HOT_ROWS


def entity_frequency(df: DataFrame, column: str, minimum: int = 5) -> DataFrame:
    """(entity, n) of the entities seen at least ``minimum`` times."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= minimum)
    )


#: Entities a sketch follows, and the smallest size its table then has; the sketch's error is this share of all rows.
TRACKED = 20_000


def heavy_hitters(df: DataFrame, column: str, k: int, *, tracked: int = TRACKED) -> DataFrame:
    """(column, n) of the ``k`` most frequent entities, exactly, most frequent first, ties to the smaller value.

    A mergeable frequent-items sketch, one row per task however many entities there are, names the candidates; their
    rows alone are then counted. An entity the sketch leaves out has at most ``missed`` rows. Only if the k-th
    candidate has no more than that could one be missing, and then all entities are counted.
    """
    held = df.filter(F.col(column).isNotNull()).select(column)
    kind = held.schema[column].dataType
    sketch = held.agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_accumulate(`{column}`, {int(tracked)}), {int(tracked)})").alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    found = cut_lineage(sketch)
    total = found.first()["_n"]
    # at most ``tracked`` candidates
    named = found.select(F.explode("_s").alias("_c")).select(F.col("_c.item").cast(kind).alias(column))
    order = (F.desc("n"), F.asc(column))
    exact = cut_lineage(held.join(F.broadcast(named), column, "left_semi").groupBy(column).agg(F.count(F.lit(1)).alias("n")))
    top = exact.orderBy(*order).limit(k)
    last = top.agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).first()
    # the sketch's worst error is 3.5 / size of all rows; what it leaves out may be short by it twice
    missed = math.ceil(2 * 3.5 / tracked * total)
    if total and (last["c"] < k or last["n"] <= missed):
        top = held.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(*order).limit(k)
    return top


def cooccurrence(df: DataFrame, left: str, right: str, minimum: int = 5) -> DataFrame:
    """(left, right, n, weight=log1p(n)) over pairs whose two entities are frequent.

    Pairs are counted first; frequencies are sums over pairs, so the events are shuffled once.
    """
    pairs = df.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))
    known_left = entity_frequency(df, left, minimum).select(left)
    known_right = entity_frequency(df, right, minimum).select(right)
    kept = pairs.join(known_left, left, "left_semi").join(known_right, right, "left_semi")
    return kept.withColumn("weight", F.log1p(F.col("n").cast("double")))


def sharing_counts(
    df: DataFrame, user: str = "user_id", shared: Mapping[str, str] | None = None, approximate: bool = False
) -> dict[str, DataFrame]:
    """Per shared resource the number of accounts using it.

    ``shared`` maps an output column to the resource column; the default covers device, IP,
    bank account and phone where present. ``approximate`` trades exactness for a sketch.
    """
    shared = shared or {
        "shared_devices_count": "device_id", "shared_ip_count": "ip_address",
        "shared_bank_accounts": "bank_account", "shared_phone_count": "phone",
    }
    count = F.approx_count_distinct if approximate else F.count_distinct
    return {
        name: df.filter(F.col(c).isNotNull()).groupBy(c).agg(count(user).alias(name))
        for name, c in shared.items()
        if c in df.columns
    }


def with_sharing(df: DataFrame, user: str = "user_id", shared: Mapping[str, str] | None = None) -> DataFrame:
    """Join the sharing counts back; a missing resource counts 0."""
    out = df
    for name, counts in sharing_counts(df, user, shared).items():
        resource = [c for c in counts.columns if c != name][0]
        out = out.join(counts, resource, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def devices_per_user(df: DataFrame, days: int = 30, min_rows: int = HOT_ROWS) -> DataFrame:
    """Input plus the distinct devices of the user over the ``days`` days before, at least 1."""
    from .velocity import trailing

    w = f"{days}d"
    out = trailing(df, "user_id", {w: days * 86400}, distincts={"_devices": "device_id"}, count_name="_n", min_rows=min_rows)
    return out.select(*df.columns, F.greatest(F.lit(1), F.col(f"_devices_{w}")).alias(f"devices_last_{w}"))


def merchant_rates(
    df: DataFrame, as_of: Column | None = None, flags: Mapping[str, str] | None = None
) -> DataFrame:
    """Per merchant: transactions, age in days and the share of flagged ones (fraud,
    chargeback, complaint where the columns exist)."""
    flags = flags or {
        "merchant_fraud_rate": "is_fraud", "merchant_chargeback_rate": "is_chargeback",
        "merchant_complaint_rate": "is_complaint",
    }
    present = {n: c for n, c in flags.items() if c in df.columns}
    first = F.min(F.col("timestamp"))
    last = F.max(F.col("timestamp")) if as_of is None else as_of
    return df.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("merchant_transaction_count"),
        F.floor((micros(last) - micros(first)) / F.lit(86_400e6)).alias("merchant_age_days"),
        *[F.avg(F.col(c).cast("double")).alias(n) for n, c in present.items()],
    )


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def add_dimension(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join of a dimension; Spark broadcasts it only when its measured size allows."""
    return facts.join(dimension, key, "left")


def membership_flag(df: DataFrame, column: str, listing: DataFrame, name: str) -> DataFrame:
    """Add a boolean telling whether the value is on the list (first column of ``listing``)."""
    item = listing.columns[0]
    marks = listing.select(F.col(item).alias(column)).distinct().withColumn(name, F.lit(True))
    return df.drop(name).join(marks, column, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_list_flags(
    df: DataFrame,
    *,
    blocked_users: DataFrame | None = None,
    blocked_devices: DataFrame | None = None,
    trusted_merchants: DataFrame | None = None,
    sanctioned: Sequence[str] = (),
) -> DataFrame:
    """Flags read by the rules: user_is_blocked, device_is_blocked, is_whitelisted_merchant,
    is_sanctioned_country. ``is_blocked`` of the request also marks the user."""
    out = df
    if blocked_users is not None:
        out = membership_flag(out, "user_id", blocked_users, "user_is_blocked")
    if "is_blocked" in df.columns:
        have = F.col("user_is_blocked") if "user_is_blocked" in out.columns else F.lit(False)
        out = out.withColumn("user_is_blocked", have | F.coalesce("is_blocked", F.lit(False)))
    if blocked_devices is not None:
        out = membership_flag(out, "device_id", blocked_devices, "device_is_blocked")
    if trusted_merchants is not None:
        out = membership_flag(out, "merchant_id", trusted_merchants, "is_whitelisted_merchant")
    if sanctioned and "location_country" in df.columns:
        hit = F.col("location_country").isin(*sanctioned)
        out = out.withColumn("is_sanctioned_country", F.coalesce(hit, F.lit(False)))
    return out


def flagged_share(df: DataFrame, cond: Column, name: str) -> DataFrame:
    return df.agg(F.avg(one_if(cond).cast("double")).alias(name))
