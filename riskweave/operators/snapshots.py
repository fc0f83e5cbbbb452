"""Feature snapshots with a time to live: lookup, upsert, delete and hit statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions import guarded_ratio, micros, one_if
from .scan import HOT_ROWS, running

KEY = ["entity_type", "entity_id"]
DEFAULT_TTL = 3600


def _order(columns, written: str | None) -> list[Column]:
    """Time, then the order of writing if there is one, then the content, so equal times have one result."""
    rest = [F.col(c) for c in ([written] if written else [])]
    return [F.col("timestamp"), *rest, F.xxhash64(F.to_json(F.struct(*sorted(c for c in columns if c not in KEY))))]


def latest_snapshots(snapshots: DataFrame, written: str | None = None) -> DataFrame:
    """The row written last per entity; aggregated map-side, so hot entities are no problem."""
    rest = [c for c in snapshots.columns if c not in KEY]
    last = F.max_by(F.struct(*rest), F.struct(*_order(snapshots.columns, written)))
    return snapshots.groupBy(*KEY).agg(last.alias("_r")).select(*KEY, "_r.*")


def snapshot_lookup(
    requests: DataFrame, snapshots: DataFrame, as_of: str = "as_of", *, written: str | None = None, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Requests plus ``features`` and ``hit``: the latest snapshot of the entity written up to ``as_of``, if
    still alive then (as_of <= timestamp + ttl). Later snapshots are never seen.

    Requests and snapshots are swept together, hot entities in slices; the sweep carries the last snapshot along, so
    each side is shuffled once. Features are a map or any type with an order.
    """
    mapped = isinstance(snapshots.schema["features"].dataType, MapType)
    content = F.map_entries("features") if mapped else F.col("features")
    ties = [o.alias(f"o{i}") for i, o in enumerate(_order(snapshots.columns, written)[1:])]
    kept = F.struct(micros("timestamp").alias("at"), *ties, F.col("ttl_seconds").alias("ttl"), content.alias("features"))
    stored = snapshots.filter("timestamp IS NOT NULL").select(*KEY, micros("timestamp").alias("_us"), F.lit(0).alias("_asked"), kept.alias("_kept"))
    asked = requests.select(*KEY, micros(as_of).alias("_us"), F.lit(1).alias("_asked"), F.struct(*requests.columns).alias("_row"))
    points = asked.unionByName(stored, allowMissingColumns=True)
    found = running(
        points, KEY, "_us", {"_last": ("max", F.col("_kept"))}, ties=["_asked"], include_current=True, min_rows=min_rows,
        probe=points.select(*KEY, "_us"),
    ).filter("_asked = 1")
    last = F.col("_last")
    hit = F.coalesce(F.col("_us") <= last["at"] + last["ttl"] * F.lit(1_000_000), F.lit(False))
    features = F.map_from_entries(last["features"]) if mapped else last["features"]
    return found.select("_row.*", F.when(hit, features).alias("features"), hit.alias("hit"))


def hit_statistics(looked_up: DataFrame, groups=()) -> DataFrame:
    """Hits, misses and hit rate."""
    sums = looked_up.groupBy(*groups).agg(
        F.sum(one_if(F.col("hit"))).alias("hits"), F.sum(one_if(~F.col("hit"))).alias("misses")
    )
    return sums.withColumn("hit_rate", guarded_ratio(F.col("hits"), F.col("hits") + F.col("misses")))


def store_size(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(*KEY).distinct().agg(F.count(F.lit(1)).alias("size"))


def upsert(snapshots: DataFrame, changes: DataFrame) -> DataFrame:
    """Last write per entity wins, the change at equal times; a change without a time to live gets the default."""
    filled = changes.withColumn(
        "ttl_seconds",
        F.coalesce(F.col("ttl_seconds"), F.lit(DEFAULT_TTL)) if "ttl_seconds" in changes.columns else F.lit(DEFAULT_TTL),
    )
    both = snapshots.withColumn("_w", F.lit(0)).unionByName(filled.select(*snapshots.columns, F.lit(1).alias("_w")))
    return latest_snapshots(both, "_w").drop("_w")


def delete(snapshots: DataFrame, keys: DataFrame) -> DataFrame:
    return snapshots.join(keys.select(*KEY), KEY, "left_anti")


def evict_expired(snapshots: DataFrame, as_of) -> DataFrame:
    """Keep only entities whose latest snapshot is alive at ``as_of``."""
    limit = micros("timestamp") + F.col("ttl_seconds") * F.lit(1_000_000)
    return latest_snapshots(snapshots).filter(micros(F.lit(as_of)) <= limit)
