"""Distribution drift between a reference and a current table, for all features at once.

Wide tables are turned into (feature, value) rows; every measure is then a group-by on the
feature, whatever the number of features.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import one_if
from ..session import cut_lineage
from .labels import between_dates
from .scan import HOT_ROWS, NO_HOT_GROUPS, exact_quantiles, has_hot_group, running

EPS = 1e-10
# fixed values: limits of the drift verdicts
PSI_WARNING, PSI_CRITICAL, KS_ALPHA, KL_THRESHOLD = 0.1, 0.2, 0.05, 0.1
PROFILE_PERCENTS = (1, 5, 25, 50, 75, 95, 99)
MIN_CURRENT_ROWS = 10
# Most values on a side for which KS p-values are exact.
EXACT_KS_ROWS = 10_000


def drift_columns(reference: DataFrame, current: DataFrame | None = None, any_numeric: bool = False) -> list[str]:
    """Columns compared: doubles and bigints of both tables, or every numeric column."""
    kinds = T.NumericType if any_numeric else (T.DoubleType, T.LongType)
    names = [f.name for f in reference.schema.fields if isinstance(f.dataType, kinds)]
    if current is not None:
        other = {f.name for f in current.schema.fields if isinstance(f.dataType, kinds)}
        names = [n for n in names if n in other]
    return names


def melt(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value) rows; null and NaN values are left out."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    long = df.select(F.inline(F.array(*cells)))
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def feature_profile(df: DataFrame, columns: Sequence[str] | None = None, min_rows: int = HOT_ROWS) -> DataFrame:
    """Per feature: mean, std, min, max and the percentiles 1/5/25/50/75/95/99."""
    long = melt(df, columns or drift_columns(df))
    basic = long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    points = exact_quantiles(long, ["feature"], "value", [p / 100 for p in PROFILE_PERCENTS], min_rows=min_rows)
    named = points.select("feature", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate(PROFILE_PERCENTS)])
    return basic.join(named, "feature")


def _tagged(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(feature, value, ref, cur): one row per observation, marked by its side."""
    one, zero = F.lit(1), F.lit(0)
    return reference.select("feature", "value", one.alias("ref"), zero.alias("cur")).unionByName(
        current.select("feature", "value", zero.alias("ref"), one.alias("cur"))
    )


class Comparison:
    """Both sides as one stored table of (feature, value, ref, cur) counts, from which every measure is taken.

    The sources are read once. Totals and cut points are one row per feature, so what is broadcast is as large as the
    column list, not as the data.
    """

    def __init__(self, reference: DataFrame, current: DataFrame, min_rows: int = HOT_ROWS):
        counts = _tagged(reference, current).groupBy("feature", "value").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
        self.counts = cut_lineage(counts)
        if min_rows != NO_HOT_GROUPS and not has_hot_group(self.counts, ["feature"], min_rows):
            min_rows = NO_HOT_GROUPS
        self.min_rows = min_rows
        mean = lambda n: F.try_divide(F.sum(F.col("value") * F.col(n)), F.sum(n))
        held = F.col("ref") + F.col("cur") > 0
        self.totals = self.counts.groupBy("feature").agg(
            F.sum("ref").alias("nr"), F.sum("cur").alias("nc"), mean("ref").alias("ref_mean"), mean("cur").alias("cur_mean"),
            F.min(F.when(held, F.col("value"))).alias("lo"), F.max(F.when(held, F.col("value"))).alias("hi"),
        )

    def ladder(self, n_bins: int = 10) -> DataFrame:
        """Per feature ``edges``, the reference's distinct quantiles, ``gap``, the largest distance of the two
        distribution functions, and for small samples ``steps``, the gap in units of 1 / (nr * nc)."""
        seen = running(
            self.counts, ["feature"], "value", {"_r": ("sum", F.col("ref")), "_c": ("sum", F.col("cur"))},
            include_current=True, min_rows=self.min_rows,
        )
        rows = seen.join(F.broadcast(self.totals.select("feature", "nr", "nc")), "feature")
        gap = F.abs(F.try_divide(F.col("_r"), F.col("nr")) - F.try_divide(F.col("_c"), F.col("nc")))
        small = (F.col("nr") <= EXACT_KS_ROWS) & (F.col("nc") <= EXACT_KS_ROWS)
        picks, ends = [], []
        for i in range(n_bins + 1):
            h = f"((nr - 1) * {i / n_bins!r}D)"
            for name, rank in (("_a", f"floor({h})"), ("_b", f"ceil({h})")):
                picks.append(F.expr(f"max(CASE WHEN ref > 0 AND _r - ref <= {rank} AND {rank} < _r THEN value END) AS {name}{i}"))
            ends.append(f"_a{i} + (_b{i} - _a{i}) * ({h} - floor({h}))")
        best = rows.groupBy("feature", "nr", "nc").agg(
            F.max(gap).alias("gap"), F.max(F.when(small, F.abs(F.col("_r") * F.col("nc") - F.col("_c") * F.col("nr")))).alias("steps"), *picks
        )
        edges = F.array_distinct(F.filter(F.expr(f"array({', '.join(ends)})"), lambda x: x.isNotNull()))
        return best.select("feature", "nr", "nc", "gap", "steps", edges.alias("edges"))

    def histograms(self, edges: DataFrame) -> DataFrame:
        """Per feature the arrays ``r`` and ``c`` of counts per bin, plus ``nr``, ``nc``.

        ``edges`` holds one ascending array per feature. Bins are closed on the left, the last also on the right;
        values outside count only in ``nr`` / ``nc``.
        """
        j = self.counts.join(F.broadcast(edges.select("feature", "edges")), "feature")
        v, e = F.col("value"), F.col("edges")
        last = F.size(e) - 1
        below = F.size(F.filter(e, lambda x: x <= v))
        inside = (v >= F.try_element_at(e, F.lit(1))) & (v <= F.try_element_at(e, F.lit(-1)))
        index = F.when(inside, F.least(below - 1, last - 1)).otherwise(F.lit(-1))
        cells = j.groupBy("feature", "edges", index.alias("bin")).agg(F.sum("ref").alias("r"), F.sum("cur").alias("c"))
        per = cells.groupBy("feature", "edges").agg(
            # one entry per bin
            F.map_from_entries(F.collect_list(F.struct("bin", "r"))).alias("_r"),
            F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("_c"),
            F.sum("r").alias("nr"), F.sum("c").alias("nc"),
        )
        bins = F.when(F.size("edges") >= 2, F.sequence(F.lit(0), F.size("edges") - 2)).otherwise(F.array().cast("array<int>"))
        pick = lambda m: F.transform(bins, lambda i: F.coalesce(F.try_element_at(F.col(m), i), F.lit(0)))
        return per.select("feature", "edges", pick("_r").alias("r"), pick("_c").alias("c"), "nr", "nc")

    def psi(self, ladder: DataFrame) -> DataFrame:
        """(feature, psi): edges are the reference's quantiles without repeats; fewer than two give 0, as does an empty side."""
        h = self.histograms(ladder)
        n = F.size("r")
        share = lambda counts, total: F.transform(
            counts, lambda x: (x + F.lit(EPS)) / (total + F.lit(EPS) * n)
        )
        terms = F.zip_with(share(F.col("c"), F.col("nc")), share(F.col("r"), F.col("nr")), lambda a, b: (a - b) * F.log(a / b))
        usable = (F.size("edges") >= 2) & (F.col("nr") > 0) & (F.col("nc") > 0)
        return h.select("feature", F.when(usable, _total(terms)).otherwise(0.0).alias("psi"))

    def ks(self, ladder: DataFrame) -> DataFrame:
        """(feature, ks_statistic, ks_pvalue); (0, 1) if a side is empty."""
        d = F.coalesce(F.col("gap"), F.lit(0.0))
        both = (F.col("nr") > 0) & (F.col("nc") > 0)
        exact = exact_ks_p_value()(F.when(both, F.col("steps")), F.col("nr"), F.col("nc"))
        p = F.when(both, F.coalesce(exact, ks_p_value(d, F.col("nr"), F.col("nc")))).otherwise(1.0)
        return ladder.select("feature", d.alias("ks_statistic"), p.alias("ks_pvalue"))

    def kl(self, n_bins: int = 10) -> DataFrame:
        """(feature, kl_divergence) of current from reference over equal-width bins of the joint range."""
        flat = F.col("lo") == F.col("hi")
        lo = F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo"))
        hi = F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))
        step = (hi - lo) / F.lit(float(n_bins))
        edges = self.totals.select(
            "feature",
            F.transform(F.sequence(F.lit(0), F.lit(n_bins)), lambda i: F.when(i == n_bins, hi).otherwise(lo + i * step)).alias("edges"),
        )
        h = self.histograms(edges)
        width = (F.element_at("edges", -1) - F.col("edges")[0]) / F.lit(float(n_bins))
        density = lambda counts, total: F.transform(counts, lambda x: x / (total * width) + F.lit(EPS))
        d = h.withColumns({"_p": density(F.col("c"), F.col("nc")), "_q": density(F.col("r"), F.col("nr"))})
        sp, sq = _total(F.col("_p")), _total(F.col("_q"))
        terms = F.zip_with("_p", "_q", lambda a, b: (a / sp) * F.log((a / sp) / (b / sq)))
        usable = (F.col("nr") > 0) & (F.col("nc") > 0)
        return d.select("feature", F.when(usable, _total(terms)).otherwise(0.0).alias("kl_divergence"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def psi(reference: DataFrame, current: DataFrame, n_bins: int = 10, min_rows: int = HOT_ROWS) -> DataFrame:
    """(feature, psi) from two (feature, value) tables."""
    both = Comparison(reference, current, min_rows)
    return both.psi(both.ladder(n_bins))


def ks_p_value(statistic: Column, n_ref: Column, n_cur: Column, terms: int = 100) -> Column:
    """Two-sided p-value from the limiting Kolmogorov distribution."""
    lam = statistic * F.sqrt(n_ref.cast("double") * n_cur.cast("double") / (n_ref + n_cur))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    # below 0.1 the distribution is 1 to double precision and the series converges too slowly
    return F.when(lam < 0.1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))


def exact_ks_p_value():
    """A function of (steps, n_ref, n_cur): the chance that two samples of one distribution lie ``steps / (n_ref * n_cur)``
    or more apart; null where ``steps`` is.

    The order of both samples is a lattice path from (0, 0) to (n_ref, n_cur), all equally likely. Of the paths to a
    point (i, j) with |i * n_cur - j * n_ref| >= steps all have been that far apart; elsewhere the share follows from
    the two points before it, which are passed with chances i / (i + j) and j / (i + j). The shares of one diagonal
    i + j are one vector, of which only the part nearer than ``steps`` is worked out.
    """

    # a function of its own scope, so that workers get it by value and need no package
    def of_paths(steps: int, m: int, n: int) -> float:
        import numpy

        m, n = min(m, n), max(m, n)
        if steps <= 0:
            return 1.0
        share = numpy.ones(m + 2)  # share[i + 1] belongs to i; ones stand for all that lies outside
        share[1] = 0.0
        low = high = 0
        for s in range(1, m + n + 1):
            # |i * (m + n) - s * m| < steps, within the rectangle
            first = max(0, s - n, (s * m - steps) // (m + n) + 1)
            last = min(m, s, -((-s * m - steps) // (m + n)) - 1)
            if first > last:
                return 1.0
            i = numpy.arange(first, last + 1)
            fresh = share[first : last + 1] * (i / s) + share[first + 1 : last + 2] * ((s - i) / s)
            share[low + 1 : high + 2] = 1.0
            share[first + 1 : last + 2] = fresh
            low, high = first, last
        return float(min(1.0, share[m + 1]))

    @F.pandas_udf("double")
    def p_value(steps: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
        import pandas

        return pandas.Series([None if pandas.isna(h) else of_paths(int(h), int(a), int(b)) for h, a, b in zip(steps, m, n)], dtype="float64")

    return p_value


def ks(reference: DataFrame, current: DataFrame, min_rows: int = HOT_ROWS) -> DataFrame:
    """(feature, ks_statistic, ks_pvalue) from two (feature, value) tables; (0, 1) if one is empty.

    The p-value is exact up to ``EXACT_KS_ROWS`` values on both sides, beyond it follows the limiting distribution.
    """
    both = Comparison(reference, current, min_rows)
    return both.ks(both.ladder())


def kl(reference: DataFrame, current: DataFrame, n_bins: int = 10) -> DataFrame:
    """(feature, kl_divergence) of current from reference over equal-width bins of the joint range."""
    return Comparison(reference, current, NO_HOT_GROUPS).kl(n_bins)


def feature_drift(
    reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None, *,
    psi_warning: float = PSI_WARNING, psi_critical: float = PSI_CRITICAL, ks_alpha: float = KS_ALPHA,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per feature with at least ten current values: PSI, KS, both means and a severity."""
    columns = columns or drift_columns(reference, current)
    both = Comparison(melt(reference, columns), melt(current, columns), min_rows)
    ladder = cut_lineage(both.ladder())  # one row per feature
    joined = (
        both.totals.filter(F.col("nc") >= MIN_CURRENT_ROWS)
        .join(F.broadcast(both.psi(ladder)), "feature", "left")
        .join(F.broadcast(both.ks(ladder)), "feature", "left")
        .withColumn("psi", F.coalesce("psi", F.lit(0.0)))
    )
    severity = (
        F.when(F.col("psi") >= psi_critical, "critical")
        .when((F.col("psi") >= psi_warning) | (F.col("ks_pvalue") < ks_alpha), "warning")
        .otherwise("none")
    )
    return joined.select(
        F.lit("feature").alias("drift_type"), "feature", severity.alias("severity"), F.col("psi").alias("statistic"),
        F.lit(psi_warning).alias("threshold"), F.col("ks_pvalue").alias("p_value"), "ks_statistic", "ref_mean", "cur_mean",
    )


def prediction_drift(
    reference: DataFrame, current: DataFrame, score: str = "score", *, psi_warning: float = PSI_WARNING,
    psi_critical: float = PSI_CRITICAL, kl_threshold: float = KL_THRESHOLD, min_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row for the score column: PSI, KL divergence, both means and a severity."""
    ref = melt(reference.withColumnRenamed(score, "predictions"), ["predictions"])
    cur = melt(current.withColumnRenamed(score, "predictions"), ["predictions"])
    both = Comparison(ref, cur, min_rows)
    j = both.totals.join(F.broadcast(both.psi(both.ladder())), "feature", "left").join(F.broadcast(both.kl()), "feature", "left")
    severity = (
        F.when((F.col("psi") >= psi_critical) | (F.col("kl_divergence") >= 2 * kl_threshold), "critical")
        .when((F.col("psi") >= psi_warning) | (F.col("kl_divergence") >= kl_threshold), "warning")
        .otherwise("none")
    )
    return j.select(
        F.lit("prediction").alias("drift_type"), "feature", severity.alias("severity"),
        F.col("psi").alias("statistic"), F.lit(psi_warning).alias("threshold"), "kl_divergence", "ref_mean", "cur_mean",
    )


def drift_table(results: DataFrame) -> DataFrame:
    """The result rows with ``is_drifted``."""
    return results.withColumn("is_drifted", F.col("severity") != "none")


def detect_drift(reference: DataFrame, current: DataFrame, psi_threshold: float = PSI_CRITICAL, **kw) -> DataFrame:
    return drift_table(feature_drift(reference, current, psi_critical=psi_threshold, **kw))


def drift_gate(results: DataFrame) -> DataFrame:
    """One row: critical features by name and whether the check passes (none is critical)."""
    critical = F.when(F.col("severity") == "critical", F.col("feature"))
    return results.agg(F.array_sort(F.collect_list(critical)).alias("critical_features")).withColumn(
        "passed", F.size("critical_features") == 0
    )


def drifting_share(results: DataFrame) -> DataFrame:
    """One row: the largest PSI and the percentage of drifting features."""
    return results.agg(
        F.max("statistic").alias("psi"), (F.avg(one_if(F.col("severity") != "none").cast("double")) * 100).alias("drifting_features_pct")
    )


def split_windows(
    df: DataFrame, as_of: datetime, ts: str = "timestamp", reference_days: int = 30, current_days: int = 7
) -> tuple[DataFrame, DataFrame]:
    """(reference, current): the last ``current_days`` days and the ``reference_days`` before them."""
    border = as_of - timedelta(days=current_days)
    return (
        between_dates(df, ts, border - timedelta(days=reference_days), border),
        between_dates(df, ts, border, as_of),
    )


