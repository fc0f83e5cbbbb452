"""Running aggregates that stay parallel when one group holds most of the rows.

A window over ``partitionBy(key)`` puts a whole group in one task. Here groups above
``min_rows`` are cut along their order column at approximate quantiles of their own, the slices
are scanned in parallel, and each slice receives the total of the slices before it. Slices that
are still too large are cut again, so there is no most number of groups or slices. Ordinary groups
keep the plain window, so the usual case costs one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Groups beyond this size are sliced.
HOT_ROWS = 1_000_000
# Slices one round of cutting makes of a group; the next round cuts what is still too large.
FAN = 64

# Given as ``min_rows`` where a caller has already ruled hot groups out: nothing is probed.
NO_HOT_GROUPS = -1

_AGG: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(fn: str, local: Column, offset: Column) -> Column:
    if fn == "sum":
        return F.coalesce(local + offset, local, offset)
    return F.greatest(local, offset) if fn == "max" else F.least(local, offset)


def cluster_by(df: DataFrame, key: str) -> DataFrame:
    """Shuffle by key into the session's number of partitions.

    The number is given, not left to be coalesced: callers multiply the rows afterwards, so
    sizes measured at the shuffle would be too small a guide.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(key))


def has_hot_group(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS) -> bool:
    """Whether any group is large enough to be sliced; one map-side-combined count."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_sl_n"))
    return not sizes.filter(F.col("_sl_n") > min_rows).isEmpty()


def slice_hot_groups(
    df: DataFrame,
    keys: Sequence[str],
    slice_on: str,
    min_rows: int = HOT_ROWS,
    probe: DataFrame | None = None,
) -> DataFrame | None:
    """Tag rows with ``_sl_key`` (key hash), ``_sl_gid`` (a second hash of a hot group) and ``_sl_no``.

    ``_sl_gid`` and ``_sl_no`` are -1 for ordinary groups. Returns None when no group is hot.
    Rows with equal ``slice_on`` always share a slice. ``_sl_key`` keeps joins on null keys safe.
    ``probe`` is a cheaper frame with the same keys and order column, from which group sizes
    and cut points are taken instead of ``df``. Cut points stay in tables: one row a hot group.
    """
    if min_rows == NO_HOT_GROUPS:
        return None
    probe = df if probe is None else probe
    if not has_hot_group(probe, keys, min_rows):
        return None
    names = {
        "_sl_key": F.xxhash64(*keys),
        "_sl_gid": F.xxhash64(F.lit("group"), *keys).bitwiseAND(F.lit((1 << 62) - 1)),
        "_sl_no": F.lit(0).cast("long"),
    }
    tagged = df.withColumns({**names, "_sl_at": F.col(slice_on).cast("double")})
    points = probe.select(*[c.alias(n) for n, c in names.items()], F.col(slice_on).cast("double").alias("_sl_at"))
    part = ["_sl_key", "_sl_gid", "_sl_no"]
    steps = F.array(*[F.lit(i / FAN) for i in range(1, FAN)])
    first = True
    while True:
        sizes = points.groupBy(*part).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_sl_at").alias("_lo"), F.max("_sl_at").alias("_hi"),
            F.percentile_approx("_sl_at", steps, F.lit(16 * FAN)).alias("_q"),
        )
        # a slice of one instant cannot be cut further
        large = sizes.filter((F.col("_n") > min_rows) & (F.col("_hi") > F.col("_lo")))
        if not first and large.isEmpty():
            break
        # as many slices as the size asks for; the lowest point is no cut, as rows equal to a cut lie behind it
        wanted = F.least(F.lit(FAN), F.ceil(F.col("_n") / F.lit(max(1, min_rows))))
        picked = F.filter(F.col("_q"), lambda q, i: F.floor((i + 1) * wanted / FAN) > F.floor(i * wanted / FAN))
        cuts = F.filter(F.array_sort(F.array_distinct(picked)), lambda q: q > F.col("_lo"))
        cuts = F.when(F.size(cuts) > 0, cuts).otherwise(F.array("_hi"))
        # only groups that are hot as a whole keep a group name
        hot = cut_lineage(large.select(*part, cuts.alias("_cuts"))) if not first else cut_lineage(
            sizes.filter(F.col("_n") > min_rows).select(*part, F.when(F.col("_hi") > F.col("_lo"), cuts).alias("_cuts"))
        )

        def cut(frame: DataFrame, hot=hot, first=first) -> DataFrame:
            joined = frame.join(hot.withColumn("_sl_hot", F.lit(True)), part, "left")
            inside = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c <= F.col("_sl_at")))
            no = F.col("_sl_no") * (FAN + 1) + inside
            if first:
                is_hot = F.coalesce("_sl_hot", F.lit(False))
                joined = joined.withColumns({
                    "_sl_no": F.when(is_hot, no).otherwise(F.lit(-1)).cast("long"),
                    "_sl_gid": F.when(is_hot, F.col("_sl_gid")).otherwise(F.lit(-1)).cast("long"),
                })
            else:
                joined = joined.withColumn("_sl_no", F.when(F.col("_sl_gid") >= 0, no).otherwise(F.col("_sl_no")).cast("long"))
            return joined.drop("_cuts", "_sl_hot")

        tagged, points = cut(tagged), cut(points).filter("_sl_gid >= 0")
        first = False
    return tagged.drop("_sl_at")


def running(
    df: DataFrame,
    keys: Sequence[str],
    slice_on: str,
    aggs: dict[str, tuple[str, Column]],
    *,
    ties: Sequence[str] = (),
    descending: bool = False,
    include_current: bool = False,
    strictly_before: bool = False,
    min_rows: int = HOT_ROWS,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Add, per group, aggregates over all rows ordered before the current one.

    ``aggs`` maps an output name to (sum | max | min, column). Rows are ordered by
    ``slice_on`` and then ``ties``. ``strictly_before`` leaves out every row with an equal
    ``slice_on`` (a bigint then); ``include_current`` adds the current row. Frames only ever
    start at the group's first row, so the work is linear in the rows.
    """
    keys = list(keys)
    lead = F.col(slice_on)
    order = [lead.desc() if descending else lead.asc(), *[F.col(t) for t in ties]]

    def framed(base):
        if strictly_before:
            return base.orderBy(order[0]).rangeBetween(Window.unboundedPreceding, -1)
        last = 0 if include_current else -1
        return base.orderBy(*order).rowsBetween(Window.unboundedPreceding, last)

    sliced = slice_hot_groups(df, keys, slice_on, min_rows, probe)
    if sliced is None:
        w = framed(Window.partitionBy(*keys))
        return df.select("*", *[_AGG[fn](c).over(w).alias(n) for n, (fn, c) in aggs.items()])

    part = ["_sl_key", "_sl_gid", "_sl_no"]
    scanned, values = sliced, aggs
    if strictly_before:
        # rows at one instant share their result: scan instants, so copies and equal instants
        # are combined before the shuffle and never meet in one window
        scanned = sliced.groupBy(*part, *keys, slice_on).agg(*[_AGG[fn](c).alias(f"_v_{n}") for n, (fn, c) in aggs.items()])
        values = {n: (fn, F.col(f"_v_{n}")) for n, (fn, _) in aggs.items()}
    w = framed(Window.partitionBy(*part, *keys))
    local = scanned.select("*", *[_AGG[fn](c).over(w).alias(f"_l_{n}") for n, (fn, c) in values.items()])
    totals = (
        scanned.filter("_sl_gid >= 0")
        .groupBy(*part)
        .agg(*[_AGG[fn](c).alias(f"_t_{n}") for n, (fn, c) in values.items()])
    )
    step = F.col("_sl_no").desc() if descending else F.col("_sl_no").asc()
    earlier = Window.partitionBy("_sl_key", "_sl_gid").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *part, *[_AGG[fn](F.col(f"_t_{n}")).over(earlier).alias(f"_o_{n}") for n, (fn, _) in aggs.items()]
    )
    results = [_merge(fn, F.col(f"_l_{n}"), F.col(f"_o_{n}")).alias(n) for n, (fn, _) in aggs.items()]
    merged = local.join(offsets, part, "left")
    if not strictly_before:
        return merged.select(*df.columns, *results)
    same = [*part, *keys, slice_on]
    found = merged.select(*[F.col(c).alias(f"_m_{i}") for i, c in enumerate(same)], *results)
    match = F.lit(True)
    for i, c in enumerate(same):
        match = match & F.col(c).eqNullSafe(F.col(f"_m_{i}"))
    # the crowded instant is on one side only, where adaptive execution splits its partition
    return sliced.join(found, match, "left").select(*df.columns, *list(aggs))


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    ties: Sequence[str],
    prev_name: str,
    next_name: str,
    min_rows: int = HOT_ROWS,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Add the ``at`` value of the previous and the next row of the same group."""
    keys = list(keys)
    order = [F.col(at), *[F.col(t) for t in ties]]
    sliced = slice_hot_groups(df, keys, at, min_rows, probe)
    if sliced is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", F.lag(at).over(w).alias(prev_name), F.lead(at).over(w).alias(next_name))
    part = ["_sl_key", "_sl_gid", "_sl_no"]
    w = Window.partitionBy(*part, *keys).orderBy(*order)
    local = sliced.select("*", F.lag(at).over(w).alias("_lp"), F.lead(at).over(w).alias("_ln"))
    totals = sliced.filter("_sl_gid >= 0").groupBy(*part).agg(F.max(at).alias("_hi"), F.min(at).alias("_lo"))
    by_slice = Window.partitionBy("_sl_key", "_sl_gid").orderBy("_sl_no")
    edges = totals.select(
        *part,
        F.lag("_hi").over(by_slice).alias("_op"),
        F.lead("_lo").over(by_slice).alias("_on"),
    )
    return local.join(edges, part, "left").select(
        *df.columns,
        F.coalesce("_lp", "_op").alias(prev_name),
        F.coalesce("_ln", "_on").alias(next_name),
    )


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Sequence[float],
    *,
    rule: str = "linear",
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Exact quantiles per group as an array column ``q`` plus ``n``.

    ``rule="linear"`` interpolates at (n-1)*p; ``rule="floor"`` takes the row at
    min(floor(n*p), n-1). Distinct values with counts are ranked by ``running``, so neither
    one buffer nor one task ever holds all values.
    """
    groups = list(groups)
    base = df.filter(F.col(value).isNotNull())
    keys = groups or ["_all"]
    if not groups:
        base = base.withColumn("_all", F.lit(0))
    counts = base.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    # raw rows bound the distinct values of every group and slice, so they serve as the probe
    ranked = running(
        counts, keys, value, {"_before": ("sum", F.col("_c"))}, min_rows=min_rows, probe=base.select(*keys, value)
    )
    ranked = ranked.withColumn("_before", F.coalesce("_before", F.lit(0)))
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    joined = ranked.join(sizes if groups else F.broadcast(sizes), keys)  # without groups the size is one row

    # SQL text keeps the many small expressions cheap to build
    def at_rank(rank: str) -> str:
        return f"max(CASE WHEN _before <= {rank} AND {rank} < _before + _c THEN `{value}` END)"

    picks, finals = [], []
    for i, p in enumerate(probs):
        if rule == "floor":
            # the product comes first, then the division by 100, as the rule is defined on percents
            rank = f"least(floor(_size * {p * 100!r}D / 100), _size - 1)"
            picks.append(F.expr(f"{at_rank(rank)} AS _a{i}"))
            finals.append(f"CAST(_a{i} AS DOUBLE)")
            continue
        h = f"((_size - 1) * {float(p)!r}D)"
        picks.append(F.expr(f"{at_rank(f'floor({h})')} AS _a{i}"))
        picks.append(F.expr(f"{at_rank(f'ceil({h})')} AS _b{i}"))
        picks.append(F.expr(f"max({h}) AS _h{i}"))
        finals.append(f"CAST(_a{i} AS DOUBLE) + (CAST(_b{i} AS DOUBLE) - CAST(_a{i} AS DOUBLE)) * (_h{i} - floor(_h{i}))")
    picked = joined.groupBy(*keys).agg(F.max("_size").alias("n"), *picks)
    return picked.select(*groups, "n", F.expr(f"array({', '.join(finals)})").alias("q"))


def value_at_rank(df: DataFrame, value: str, rank: int, min_rows: int = HOT_ROWS):
    """The ``rank``-th smallest value (0-based) of a numeric column, or None."""
    base = df.filter(F.col(value).isNotNull()).withColumn("_all", F.lit(0))
    counts = base.groupBy("_all", value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running(
        counts, ["_all"], value, {"_before": ("sum", F.col("_c"))}, min_rows=min_rows, probe=base.select("_all", value)
    )
    before = F.coalesce(F.col("_before"), F.lit(0))
    hit = ranked.filter((before <= rank) & (F.lit(rank) < before + F.col("_c"))).select(value).first()
    return None if hit is None else hit[0]
