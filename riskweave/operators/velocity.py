"""Trailing per-entity features over event time.

Every trailing aggregate is a sweep: an event enters at its own instant and leaves when the
window has passed over it, so each feature is a running sum over entries and exits. The work
is linear in events x windows, whatever the window holds, and a hot entity is scanned in
slices (see ``scan``). Amounts are summed as whole millionths: nothing is lost by later
subtraction, and the result does not depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bounded, guarded_ratio, micros, nan_to_null, seconds_to_micros
from .scan import HOT_ROWS, NO_HOT_GROUPS, cluster_by, has_hot_group, running, with_neighbours

HOUR = 3600
_EXACT = "decimal(28,10)"


def trailing(
    df: DataFrame,
    key: str,
    windows: Mapping[str, float],
    *,
    ts: str = "timestamp",
    ident: str = "transaction_id",
    sums: Mapping[str, Column] | None = None,
    tallies: Mapping[str, Column] | None = None,
    distincts: Mapping[str, str] | None = None,
    arrival: bool = False,
    digits: int | None = 6,
    count_name: str = "n",
    min_rows: int = HOT_ROWS,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Input columns plus, per window w, ``{count_name}_{w}`` and one column per sum, tally and
    distinct count, named ``{name}_{w}``.

    ``sums`` are amounts, kept to ``digits`` decimal places in a bigint; a running value is the
    content of one window, so it overflows (an error, never a wrong value) only beyond 9e12 in
    a single window. ``digits=None`` sums decimals with 10 places instead. ``tallies`` are sums
    of whole numbers.

    With ``arrival=False`` a row sees the events in [t-w, t): rows at the same instant do not
    see each other. With ``arrival=True`` it sees the events before it in (time, id) order that
    are newer than t-w, the lower bound excluded. ``windows`` maps a suffix to seconds.
    ``probe`` may name a cheaper frame holding the same rows to look for hot entities in.
    """
    distincts = dict(distincts or {})
    held = _EXACT if digits is None else "bigint"
    measures: dict[str, tuple[Column, str]] = {}  # name -> (value per event, type it is held in)
    for name, c in (sums or {}).items():
        value = nan_to_null(c.cast("double")) if digits is not None else c
        scaled = F.round(value * F.lit(float(10**digits))) if digits is not None else value
        measures[name] = (scaled.cast(held), held)
    for name, c in (tallies or {}).items():
        measures[name] = (c.cast("bigint"), "bigint")
    columns = df.columns
    spans = {w: seconds_to_micros(s) for w, s in windows.items()}
    work = df.withColumn("_us", micros(ts))
    source_rows = (df if probe is None else probe).withColumn("_us", micros(ts))
    # no entity is hot: then neither is any (entity, value) pair, and one count settles it all
    if min_rows != NO_HOT_GROUPS and not has_hot_group(source_rows, [key], min_rows):
        min_rows = NO_HOT_GROUPS
    if min_rows == NO_HOT_GROUPS:
        # shuffle the events once, before they multiply; every window below then finds its rows
        # already clustered by the entity
        work = cluster_by(work, key)
    for i, source in enumerate(distincts.values()):
        # values that are null are not counted as distinct, so they need no neighbours
        work = with_neighbours(
            work, [key, source], "_us", [ident], f"_p{i}", f"_x{i}", min_rows,
            probe=source_rows.select(key, source, "_us"),
        )

    def closes(start: str, following: str, span: int) -> str:
        """The next equal value comes before the window has left ``start``."""
        return f"coalesce({following} - {start} {'<' if arrival else '<='} {span}, false)"

    # one entry (window number -1) and one exit per window; only the entry carries the row
    win = F.col("_win")
    entry = win == -1
    shift = F.element_at(F.array(F.lit(0), *[F.lit(s) for s in spans.values()]), win + 2)
    points = work.select(
        F.col(key).alias("_key"), F.col(ident).alias("_id"), "_us",
        *[F.coalesce(c, F.lit(0).cast(t)).alias(f"_s{i}") for i, (c, t) in enumerate(measures.values())],
        *[c for i in range(len(distincts)) for c in (f"_p{i}", f"_x{i}")],
        *[F.col(c).isNotNull().alias(f"_k{i}") for i, c in enumerate(distincts.values())],
        F.struct(*columns).alias("_whole"),
        F.explode(F.array(*[F.lit(j) for j in range(-1, len(spans))])).alias("_win"),
    ).select(
        "*", (F.col("_us") + shift).alias("_at"), entry.cast("int").alias("_kind"),
        F.when(entry, F.col("_whole")).alias("_row"),
    ).drop("_whole")

    aggs: dict[str, tuple[str, Column]] = {}
    names: list[tuple[str, str]] = []  # (output, type)
    for j, (w, span) in enumerate(spans.items()):
        aggs[f"{count_name}_{w}"] = ("sum", F.expr(f"CASE _win WHEN -1 THEN 1 WHEN {j} THEN -1 ELSE 0 END"))
        names.append((f"{count_name}_{w}", "long"))
        for i, (s, (_, kind)) in enumerate(measures.items()):
            moved = f"CASE _win WHEN -1 THEN _s{i} WHEN {j} THEN -_s{i} ELSE CAST(0 AS {kind}) END"
            aggs[f"{s}_{w}"] = ("sum", F.expr(moved))
            names.append((f"{s}_{w}", "double" if s in (sums or {}) else "long"))
        for i, d in enumerate(distincts):
            # a value enters unless an older equal one is still counted, whose turn ends here;
            # it leaves with the window unless an equal value has replaced it before
            moved = (
                f"CASE WHEN NOT _k{i} THEN 0 WHEN _win = -1 THEN IF({closes(f'_p{i}', '_us', span)}, 0, 1) "
                f"WHEN _win = {j} THEN IF({closes('_us', f'_x{i}', span)}, 0, -1) ELSE 0 END"
            )
            aggs[f"{d}_{w}"] = ("sum", F.expr(moved))
            names.append((f"{d}_{w}", "long"))
    swept = running(
        points,
        ["_key"],
        "_at",
        aggs,
        ties=["_kind", "_id"],
        strictly_before=not arrival,
        min_rows=min_rows,
        probe=source_rows.select(F.col(key).alias("_key"), F.col("_us").alias("_at")),
    )
    unit = 1.0 if digits is None else float(10**digits)
    finals = [
        F.expr(f"coalesce(CAST(`{n}` AS DOUBLE), 0D) / {unit!r}D AS `{n}`" if t == "double" else f"coalesce(`{n}`, 0L) AS `{n}`")
        for n, t in names
    ]
    return swept.filter("_kind = 1").select("_row.*", *finals)


def trailing_max(
    df: DataFrame,
    key: str,
    windows: Mapping[str, float],
    value: str,
    name: str,
    *,
    ts: str = "timestamp",
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """``key``, ``ts`` and ``{name}_{w}``: the largest value in [t-w, t), 0 when it is empty, for every instant of
    every entity (rows at one instant share it, whatever their ids).

    Time is cut into blocks of the window's own length. A window then covers the end of one
    block and the start of the next: the start is a running maximum over entries, the end is a
    running maximum, read backwards, over the same events moved forward by one window.
    """
    if min_rows != NO_HOT_GROUPS and not has_hot_group(df, [key], min_rows):
        min_rows = NO_HOT_GROUPS
    spans = [(w, seconds_to_micros(s)) for w, s in windows.items()]
    moves = []
    for j, (_, span) in enumerate(spans):
        moves.append(F.struct(F.lit(j).alias("_win"), F.col("_us").alias("_at"), F.lit(1).alias("_kind"), F.lit(span).alias("_span")))
        moves.append(F.struct(F.lit(j).alias("_win"), (F.col("_us") + F.lit(span)).alias("_at"), F.lit(0).alias("_kind"), F.lit(span).alias("_span")))
    # equal instants are combined before they multiply
    source = df.groupBy(F.col(key).alias("_key"), F.col(ts).alias("_ts")).agg(F.max(nan_to_null(F.col(value).cast("double"))).alias("_v"))
    source = source.withColumn("_us", micros("_ts"))
    points = source.select("_key", "_ts", "_v", F.inline(F.array(*moves)))
    points = points.withColumn("_block", F.floor(F.col("_at") / F.col("_span")))
    part = ["_key", "_win", "_block"]
    entering = F.when(F.col("_kind") == 1, F.col("_v"))
    leaving = F.when(F.col("_kind") == 0, F.col("_v"))
    forward = running(points, part, "_at", {"_head": ("max", entering)}, strictly_before=True, min_rows=min_rows)
    # an exit at exactly t still counts (the lower bound is included), so exits sort first here
    back = running(
        forward, part, "_at", {"_tail": ("max", leaving)}, ties=["_kind"], descending=True, min_rows=min_rows
    )
    best = F.coalesce(F.greatest("_head", "_tail"), F.lit(0.0))
    picked = [
        F.max(F.when(F.col("_win") == j, best)).alias(f"{name}_{w}") for j, (w, _) in enumerate(spans)
    ]
    return back.filter("_kind = 1").groupBy(F.col("_key").alias(key), F.col("_ts").alias(ts)).agg(*picked)


def windowed_features(
    df: DataFrame, hours: Sequence[int] = (1, 6, 24, 168), *, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Per user and window: count, amount, mean amount and distinct merchants over [t-w, t)."""
    if "user_id" not in df.columns or "timestamp" not in df.columns:
        return df.select()
    suffixes = {f"{h}h": h * HOUR for h in hours}
    amount = F.col("amount") if "amount" in df.columns else F.lit(0)
    distincts = {"unique_merchants": "merchant_id"} if "merchant_id" in df.columns else {}
    out = trailing(
        df, "user_id", suffixes, sums={"txn_amount": amount}, distincts=distincts,
        count_name="txn_count", min_rows=min_rows,
    )
    extra = {
        f"avg_amount_{s}": guarded_ratio(F.col(f"txn_amount_{s}"), F.col(f"txn_count_{s}")) for s in suffixes
    }
    if not distincts:
        extra |= {f"unique_merchants_{s}": F.lit(0) for s in suffixes}
    return out.withColumns(extra)


def burst_ratios(df: DataFrame) -> DataFrame:
    """One-hour over 24-hour count and amount; a zero denominator counts as 1."""
    out = df
    for what in ("count", "amount"):
        short, long_ = f"txn_{what}_1h", f"txn_{what}_24h"
        if short in df.columns and long_ in df.columns:
            den = F.when(F.col(long_) == 0, 1).otherwise(F.col(long_))
            out = out.withColumn(f"txn_{what}_ratio_1h_24h", F.col(short) / den)
    return out


def velocity_features(df: DataFrame, hours: Sequence[int] = (1, 6, 24)) -> DataFrame:
    """The short form: windows of 1, 6 and 24 hours with ratios, no baseline."""
    return burst_ratios(windowed_features(df, hours))


SERVING_WINDOWS = {"1h": HOUR, "24h": 24 * HOUR, "7d": 7 * 24 * HOUR}


def serving_velocity(df: DataFrame, *, min_rows: int = HOT_ROWS) -> DataFrame:
    """What a scoring service sees when each event is looked up and then recorded.

    User count, amount, distinct merchants and device count, distinct users over the events
    that came before in (time, id) order and are newer than t-w.
    """
    by_user = trailing(
        df, "user_id", SERVING_WINDOWS, sums={"user_txn_amount": F.col("amount")},
        distincts={"user_unique_merchants": "merchant_id"}, arrival=True,
        count_name="user_txn_count", min_rows=min_rows,
    )
    return trailing(
        by_user, "device_id", SERVING_WINDOWS, distincts={"device_unique_users": "user_id"},
        arrival=True, count_name="device_txn_count", min_rows=min_rows, probe=df,
    )


GRID_WINDOWS = {
    "10m": 600, "1h": HOUR, "6h": 6 * HOUR, "24h": 24 * HOUR, "7d": 168 * HOUR, "30d": 720 * HOUR,
}


def velocity_grid(
    df: DataFrame,
    windows: Mapping[str, float] | None = None,
    *,
    flags: Mapping[str, str] | None = None,
    distincts: Mapping[str, str] | None = None,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """The configurable grid: count, sum, mean and maximum of amount, distinct partners and
    counts of flagged events for every window. Column sets absent from ``df`` are left out."""
    windows = dict(windows or GRID_WINDOWS)
    flags = {"failed_attempts": "is_failed", "declined_count": "is_declined"} if flags is None else flags
    distincts = (
        {"unique_merchants": "merchant_id", "unique_recipients": "recipient_id", "unique_ips": "ip_address"}
        if distincts is None
        else distincts
    )
    present = {n: c for n, c in distincts.items() if c in df.columns}
    flagged = {n: F.col(c).cast("int") for n, c in flags.items() if c in df.columns}
    out = trailing(
        df, "user_id", windows, sums={"amount_sum": F.col("amount")}, tallies=flagged,
        distincts=present, count_name="txn_count", min_rows=min_rows,
    )
    extra = {
        f"amount_avg_{w}": guarded_ratio(F.col(f"amount_sum_{w}"), F.col(f"txn_count_{w}")) for w in windows
    }
    out = out.withColumns(extra)
    peaks = trailing_max(df, "user_id", windows, "amount", "amount_max", min_rows=min_rows)
    peaks = peaks.withColumnsRenamed({"user_id": "_pu", "timestamp": "_pt"})
    same = out["user_id"].eqNullSafe(peaks["_pu"]) & out["timestamp"].eqNullSafe(peaks["_pt"])
    return out.join(peaks, same).drop("_pu", "_pt")


def rolling_amount_profile(
    df: DataFrame, days: int = 30, *, min_rows: int = HOT_ROWS
) -> DataFrame:
    """Mean and sample deviation of the user's amounts over the last ``days`` days, [t-w, t)."""
    w = f"{days}d"
    amount = F.col("amount").cast("decimal(18,6)")
    out = trailing(
        df, "user_id", {w: days * 86400}, sums={"_sum": amount, "_sq": amount * amount}, digits=None,
        count_name="_n", min_rows=min_rows,
    )
    n, s, q = F.col(f"_n_{w}"), F.col(f"_sum_{w}"), F.col(f"_sq_{w}")
    spread = bounded(F.try_divide(q - s * s / F.when(n > 0, n), F.when(n > 1, n - 1)), 0.0)
    return out.select(
        *df.columns,
        F.when(n > 0, s / n).alias(f"avg_amount_{w}"),
        F.sqrt(spread).alias(f"std_amount_{w}"),
    )


def user_history(df: DataFrame, *, min_rows: int = HOT_ROWS) -> DataFrame:
    """Per transaction what was known of the user before it: lifetime count and amount, mean
    amount, whole days since the last transaction and transactions per week."""
    work = df.withColumn("_us", micros("timestamp"))
    out = running(
        work,
        ["user_id"],
        "_us",
        {
            "_cnt": ("sum", F.lit(1)),
            "_amt": ("sum", F.coalesce(nan_to_null(F.col("amount").cast("double")).cast(_EXACT), F.lit(0).cast(_EXACT))),
            "_last": ("max", F.col("_us")),
            "_first": ("min", F.col("_us")),
        },
        ties=["transaction_id"],
        min_rows=min_rows,
    )
    count = F.coalesce(F.col("_cnt"), F.lit(0))
    total = F.coalesce(F.col("_amt").cast("double"), F.lit(0.0))
    day_us = 86_400_000_000
    weeks = (F.col("_us") - F.col("_first")) / F.lit(7.0 * day_us)
    return out.select(
        *df.columns,
        count.alias("total_lifetime_transactions"),
        total.alias("total_lifetime_amount"),
        F.try_divide(total, count).alias("avg_transaction_amount"),
        F.floor((F.col("_us") - F.col("_last")) / F.lit(float(day_us))).alias("days_since_last_transaction"),
        F.when(weeks > 0, count / F.greatest(weeks, F.lit(1.0))).alias("transaction_frequency_weekly"),
    )


def user_baseline(df: DataFrame) -> DataFrame:
    """Count, mean and sample deviation of amount per user, and one ``is_global`` row for all."""
    return (
        df.groupingSets([["user_id"], []], "user_id")
        .agg(
            F.count(F.lit(1)).alias("txn_count"),
            F.avg("amount").alias("avg_amount"),
            F.stddev_samp("amount").alias("std_amount"),
            F.grouping("user_id").cast("boolean").alias("is_global"),
        )
        .filter(F.col("is_global") | F.col("user_id").isNotNull())
    )


def amount_vs_user(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """Add ``amount_vs_user_avg``: the z-score against the user's baseline; unknown users use
    the global row, a missing or zero deviation counts as 1."""
    fallback = baseline.filter("is_global").select("avg_amount", "std_amount").first()
    mean = fallback["avg_amount"] if fallback else None
    std = fallback["std_amount"] if fallback else None
    known = baseline.filter("not is_global").select(
        F.col("user_id"), F.col("avg_amount").alias("_m"), F.col("std_amount").alias("_s"), F.lit(True).alias("_hit")
    )
    joined = df.join(known, "user_id", "left")
    centre = F.when(F.col("_hit"), F.col("_m")).otherwise(F.lit(mean).cast("double"))
    scale = F.when(F.col("_hit"), F.col("_s")).otherwise(F.lit(std).cast("double"))
    scale = F.when(scale > 0, scale).otherwise(1.0)
    return joined.select(*df.columns, ((F.col("amount") - centre) / scale).alias("amount_vs_user_avg"))
