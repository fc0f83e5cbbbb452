"""Model evaluation over a scored, labelled table (columns ``label`` and ``score``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import guarded_ratio, one_if
from .ranking import precision_at_k, ranking_quality
from .scan import HOT_ROWS, exact_quantiles

# fixed values: clip of the log loss
LOG_LOSS_EPS = 1e-15
# fixed values: operating points examined by default
DEFAULT_THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
MIN_SLICE_ROWS = 10


def outcomes(positive: Column, label: Column) -> dict[str, Column]:
    """1 or 0 per row for each cell of the confusion matrix."""
    y = label == 1
    return {
        "true_positives": one_if(y & positive), "false_positives": one_if(~y & positive),
        "true_negatives": one_if(~y & ~positive), "false_negatives": one_if(y & ~positive),
    }


def rates() -> dict[str, Column]:
    tp, fp = F.col("true_positives"), F.col("false_positives")
    tn, fn = F.col("true_negatives"), F.col("false_negatives")
    return {
        "precision": guarded_ratio(tp, tp + fp),
        "recall": guarded_ratio(tp, tp + fn),
        "f1": guarded_ratio(2 * tp, 2 * tp + fp + fn),
        "specificity": guarded_ratio(tn, tn + fp),
    }


def threshold_metrics(
    df: DataFrame, groups: Sequence[str] = (), *, score: str = "score", label: str = "label",
    prediction: str | None = None, threshold: float = 0.5,
) -> DataFrame:
    """Confusion counts, precision, recall, f1, specificity, Brier score, log loss, rates, n.

    ``prediction`` names a column of given 0/1 predictions; without it score >= threshold.
    """
    parts = _parts(score, label, prediction, threshold)
    return _finished(df.groupBy(*groups).agg(*[F.sum(c).alias(n) for n, c in parts.items()]))


def _parts(score: str, label: str, prediction: str | None, threshold: float) -> dict[str, Column]:
    """What each row adds to the metrics; all of them are sums."""
    y, p = F.col(label), F.col(score)
    positive = (F.col(prediction) == 1) if prediction else (p >= threshold)
    q = F.greatest(F.lit(LOG_LOSS_EPS), F.least(p, F.lit(1 - LOG_LOSS_EPS)))
    loss = -F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))
    return {
        **outcomes(positive, y),
        "_square": (p - y) * (p - y), "_loss": loss, "_known": one_if(p.isNotNull() & y.isNotNull()),
        "_y": y.cast("double"), "_labelled": one_if(y.isNotNull()), "_flagged": one_if(positive), "n_samples": F.lit(1),
    }


def _finished(sums: DataFrame) -> DataFrame:
    def mean(total: str, n: str) -> Column:
        return F.try_divide(F.col(total).cast("double"), F.col(n).cast("double"))

    return sums.withColumns(
        {
            "brier_score": mean("_square", "_known"), "log_loss": mean("_loss", "_known"),
            "positive_rate": mean("_y", "_labelled"), "predicted_positive_rate": mean("_flagged", "n_samples"), **rates(),
        }
    ).drop("_square", "_loss", "_known", "_y", "_labelled", "_flagged")


def classification_metrics(
    df: DataFrame, *, score: str = "score", label: str = "label", prediction: str | None = None,
    threshold: float = 0.5, min_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row with every global metric, ranking measures included; one pass over the rows."""
    base = df.withColumn("_g", F.lit(0))
    sums = ranking_quality(base, ["_g"], score, label, min_rows, _parts(score, label, prediction, threshold))
    return _finished(sums).drop("_g")


def slice_metrics(
    df: DataFrame, slices: Sequence[str], *, score: str = "score", label: str = "label",
    prediction: str | None = None, threshold: float = 0.5, min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Metrics per value of each slice column: (slice_name, slice, metrics...).

    Values with fewer than 10 rows and null values are left out.
    """
    kept = [label, score] + ([prediction] if prediction else [])
    long = df.select(
        *kept,
        F.inline(F.array(*[F.struct(F.lit(s).alias("slice_name"), F.col(s).cast("string").alias("slice")) for s in slices])),
    ).filter(F.col("slice").isNotNull())
    keys = ["slice_name", "slice"]
    sums = ranking_quality(long, keys, score, label, min_rows, _parts(score, label, prediction, threshold))
    return _finished(sums.filter(F.col("n_samples") >= MIN_SLICE_ROWS))


def _edges(n_bins: int) -> Column:
    return F.array(*[F.lit(i * (1.0 / n_bins)) for i in range(1, n_bins)])


def calibration_curve(
    df: DataFrame, *, score: str = "score", label: str = "label", n_bins: int = 10
) -> DataFrame:
    """(bin, n, prob_true, prob_pred) of the non-empty bins; a score on an edge falls below it."""
    p = F.col(score)
    index = F.size(F.filter(_edges(n_bins), lambda e: e < p))
    return df.groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(label).cast("double")).alias("prob_true"),
        F.avg(p).alias("prob_pred"),
    )


def calibration_errors(
    df: DataFrame, *, score: str = "score", label: str = "label", n_bins: int = 10
) -> DataFrame:
    """One row: ``ece`` (bins closed on the left, so a score of 1 is in none), ``mce`` (the
    widest gap of the calibration curve) and ``brier_score``."""
    p, y = F.col(score), F.col(label).cast("double")
    left = F.when(p < 1.0, F.size(F.filter(_edges(n_bins), lambda e: e <= p)))
    right = F.size(F.filter(_edges(n_bins), lambda e: e < p))
    # one pass: both bin numbers are grouped together, at most a few dozen rows come out
    cells = df.groupBy(left.alias("_l"), right.alias("_r")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_y"), F.sum(p).alias("_p"),
        F.sum((p - y) * (p - y)).alias("_b"),
    )
    sides = cells.select(
        "_n", "_y", "_p",
        F.inline(F.array(
            F.struct(F.lit("ece").alias("side"), F.col("_l").alias("bin"), F.lit(0.0).alias("_b")),
            F.struct(F.lit("mce").alias("side"), F.col("_r").alias("bin"), F.col("_b").alias("_b")),
        )),
    )
    bins = sides.groupBy("side", "bin").agg(
        F.sum("_n").alias("_n"), F.sum("_y").alias("_y"), F.sum("_p").alias("_p"), F.sum("_b").alias("_b")
    )
    gap = F.abs(F.col("_y") / F.col("_n") - F.col("_p") / F.col("_n"))
    is_ece, is_mce = F.col("side") == "ece", F.col("side") == "mce"
    total = F.sum(F.when(is_mce, F.col("_n")))
    weighted = F.sum(F.when(is_ece & F.col("bin").isNotNull(), F.col("_n") * gap))
    return bins.agg(
        guarded_ratio(weighted, total).alias("ece"),
        F.coalesce(F.max(F.when(is_mce, gap)), F.lit(0.0)).alias("mce"),
        F.try_divide(F.sum("_b"), total).alias("brier_score"),
    )


def threshold_analysis(
    df: DataFrame, *, score: str = "score", label: str = "label",
    thresholds: Sequence[float] = DEFAULT_THRESHOLDS,
) -> DataFrame:
    """Precision, recall, f1, confusion counts and flagged share at each threshold.

    One pass: every threshold is a pair of conditional sums; the single row is then unfolded.
    """
    p, y = F.col(score), F.col(label)
    sums = [F.count(F.lit(1)).alias("_n"), F.sum(one_if(y == 1)).alias("_y")]
    for i, t in enumerate(thresholds):
        sums.append(F.sum(one_if(p >= F.lit(float(t)))).alias(f"_f{i}"))
        sums.append(F.sum(one_if((p >= F.lit(float(t))) & (y == 1))).alias(f"_t{i}"))
    wide = df.agg(*sums)
    rows = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.col(f"_t{i}").alias("true_positives"),
            (F.col(f"_f{i}") - F.col(f"_t{i}")).alias("false_positives"),
            (F.col("_y") - F.col(f"_t{i}")).alias("false_negatives"),
            (F.col("_n") - F.col("_y") - F.col(f"_f{i}") + F.col(f"_t{i}")).alias("true_negatives"),
        )
        for i, t in enumerate(thresholds)
    ]
    out = wide.select("_n", F.inline(F.array(*rows)))
    r = rates()
    flagged = F.col("true_positives") + F.col("false_positives")
    return out.select(
        "threshold", r["precision"].alias("precision"), r["recall"].alias("recall"), r["f1"].alias("f1"),
        "true_positives", "false_positives", "false_negatives", "true_negatives",
        guarded_ratio(flagged, F.col("_n")).alias("predicted_positive_rate"),
    )


def as_metric_rows(metrics: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Turn metric columns into rows (keep..., metric, value)."""
    cells = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return metrics.select(*keep, F.inline(F.array(*cells)))


# fixed values: minimum metrics of the release gate
GATES = {"precision": 0.70, "recall": 0.60, "pr_auc": 0.75}


def metric_gates(metrics: DataFrame, gates: Mapping[str, float] = GATES) -> DataFrame:
    """(metric, value, minimum, passed) for each gated metric, one row per metric row."""
    rows = as_metric_rows(metrics, list(gates))
    minimum = F.element_at(F.create_map(*[x for k, v in gates.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("metric"))
    return rows.withColumn("minimum", minimum).withColumn(
        "passed", F.coalesce(F.col("value") >= F.col("minimum"), F.lit(False))
    )


# fixed values: largest tolerated change against the previous run
REGRESSION_LIMITS = {"precision": 0.02, "recall": 0.02, "latency_p95": 10.0}
# fixed values: drop that counts as performance drift
PERFORMANCE_DRIFT = {"precision": 0.10, "recall": 0.10}


def regression_gates(
    current: DataFrame, previous: DataFrame, limits: Mapping[str, float] = REGRESSION_LIMITS,
    rising_is_bad: Sequence[str] = ("latency_p95",),
) -> DataFrame:
    """Compare metric rows (metric, value) with those of the previous run.

    ``change`` is the worsening: a fall for quality metrics, a rise for latency.
    """
    pairs = current.select("metric", F.col("value").alias("current")).join(
        previous.select("metric", F.col("value").alias("previous")), "metric"
    ).filter(F.col("metric").isin(list(limits)))
    limit = F.element_at(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("metric"))
    worse = F.when(F.col("metric").isin(list(rising_is_bad)), F.col("current") - F.col("previous")).otherwise(
        F.col("previous") - F.col("current")
    )
    return pairs.withColumns({"change": worse, "limit": limit}).withColumn(
        "passed", F.coalesce(F.col("change") <= F.col("limit"), F.lit(False))
    )


def latency_summary(
    df: DataFrame, groups: Sequence[str] = (), *, latency: str = "latency_ms",
    ts: str = "prediction_timestamp", failed: Column | None = None, min_rows: int = HOT_ROWS,
) -> DataFrame:
    """p50 / p95 / p99 (value at index floor(n*p/100)), mean, min, max, rows per second, error rate.

    ``failed`` marks rows that are errors; their latency is left out, as it measures nothing.
    """
    bad = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    keys = list(groups) or ["_all"]
    base = (df if groups else df.withColumn("_all", F.lit(0))).withColumn("_ok", F.when(~bad, F.col(latency)))
    span = F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))
    flat = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_requests"),
        F.avg("_ok").alias("latency_mean_ms"), F.min("_ok").alias("latency_min_ms"), F.max("_ok").alias("latency_max_ms"),
        F.try_divide(F.count(F.lit(1)).cast("double"), span / F.lit(1e6)).alias("requests_per_second"),
        F.sum(one_if(bad)).alias("error_count"), F.avg(one_if(bad).cast("double")).alias("error_rate"),
    )
    points = exact_quantiles(base, keys, "_ok", [0.50, 0.95, 0.99], rule="floor", min_rows=min_rows)
    # without groups both sides are one row
    joined = flat.join(points if groups else F.broadcast(points), keys, "left")
    pct = {f"latency_{n}_ms": F.coalesce(F.col("q")[i], F.lit(0.0)) for i, n in enumerate(("p50", "p95", "p99"))}
    return joined.withColumns(pct).drop("q", "n", "_all")


def money_value(
    metrics: DataFrame, *, fraud_rate: Column | float = 0.02, platform_cost: float,
    avg_fraud_amount: Column | float = 500.0, review_cost: float = 5.0, loss_rate: float = 1.0,
    volume: str = "transactions",
) -> DataFrame:
    """Add the monthly money figures to a table of (precision, recall, volume) rows."""
    rate = fraud_rate if isinstance(fraud_rate, Column) else F.lit(float(fraud_rate))
    stake = avg_fraud_amount if isinstance(avg_fraud_amount, Column) else F.lit(float(avg_fraud_amount))
    precision, recall, n = F.col("precision"), F.col("recall"), F.col(volume).cast("double")
    caught = n * rate * recall
    missed = n * rate * (1 - recall)
    odds = F.try_divide(1 - precision, precision)  # false alarms per caught fraud
    prevented = caught * stake * loss_rate
    alarms = F.coalesce(caught * odds, F.lit(0.0)) * review_cost
    net = prevented - alarms - F.lit(float(platform_cost))
    if platform_cost > 0:
        roi = net / F.lit(float(platform_cost)) * 100
    else:
        roi = F.when(net > 0, F.lit(float("inf"))).otherwise(0.0)
    per_row = F.coalesce(rate * recall * stake - odds * review_cost, F.lit(0.0))
    even = F.when(per_row > 0, F.floor(F.try_divide(F.lit(float(platform_cost)), per_row))).otherwise(F.lit(-1))
    return metrics.withColumns(
        {
            "fraud_prevented": F.round(prevented, 2), "fraud_missed": F.round(missed * stake * loss_rate, 2),
            "false_alarm_cost": F.round(alarms, 2), "gross_savings": F.round(prevented, 2),
            "net_savings": F.round(net, 2), "roi_percentage": F.round(roi, 1),
            "break_even_predictions": even.cast("long"),
        }
    )


def unit_cost(df: DataFrame, platform_cost: float, volume: str = "transactions") -> DataFrame:
    """Cost per prediction and per million predictions from the volume column."""
    each = guarded_ratio(F.lit(float(platform_cost)), F.col(volume))
    return df.withColumns({"cost_per_prediction": each, "cost_per_million": F.round(each * 1_000_000, 2)})


# fixed values: amount bands of the sliced report, as (name, lower bound)
AMOUNT_BANDS = (("low", 0.0), ("medium", 100.0), ("high", 1000.0), ("very_high", 10000.0))
# fixed values: times of day of the sliced report, as (name, first hour)
DAY_PARTS = (("night", 0), ("morning", 6), ("afternoon", 12), ("evening", 18))


def band_of(value: Column, bands: Sequence[tuple[str, float]]) -> Column:
    """The last band whose lower bound is reached; null below the first."""
    out = F.lit(None).cast("string")
    for name, low in bands:
        out = F.when(value >= low, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def amount_bucket(amount: Column) -> Column:
    return band_of(amount, AMOUNT_BANDS)


def time_of_day(ts: Column) -> Column:
    return band_of(F.hour(ts), DAY_PARTS)


@dataclass
class EvaluationReport:
    """The tables of one evaluation; every field stays a DataFrame."""

    model_version: str
    global_metrics: DataFrame
    slice_metrics: DataFrame | None
    calibration: DataFrame
    curve: DataFrame
    thresholds: DataFrame
    precision_at_k: DataFrame
    warnings: DataFrame

    def sections(self) -> dict[str, DataFrame]:
        parts = {
            "global_metrics": self.global_metrics, "calibration": self.calibration, "calibration_curve": self.curve,
            "threshold_analysis": self.thresholds, "precision_at_k": self.precision_at_k, "warnings": self.warnings,
        }
        if self.slice_metrics is not None:
            parts["slice_metrics"] = self.slice_metrics
        return parts


def report_warnings(global_metrics: DataFrame, slices: DataFrame | None, calibration: DataFrame) -> DataFrame:
    """Message rows: weak global precision or recall, weak slices, poor calibration."""
    p, r = F.col("precision"), F.col("recall")
    found = global_metrics.select(F.explode(F.array_compact(F.array(
        F.when(p < 0.5, F.format_string("Low precision (%.2f) - high false positive rate", p)),
        F.when(r < 0.5, F.format_string("Low recall (%.2f) - missing many fraud cases", r)),
    ))).alias("message"))
    if slices is not None:
        weak = slices.filter((r < 0.3) & (F.col("n_samples") > 100))
        found = found.unionByName(weak.select(
            F.format_string("Very low recall (%.2f) for %s=%s", r, F.col("slice_name"), F.col("slice")).alias("message")
        ))
    poor = calibration.filter(F.col("ece") > 0.1)
    return found.unionByName(poor.select(F.format_string("Poor calibration (ECE=%.3f)", F.col("ece")).alias("message")))


def evaluation_report(
    df: DataFrame, *, model_version: str = "v1", score: str = "score", label: str = "label",
    ident: str = "transaction_id", threshold: float = 0.5, slices: Sequence[str] = (),
    min_rows: int = HOT_ROWS,
) -> EvaluationReport:
    """All sections of the evaluation of one scored table."""
    overall = classification_metrics(df, score=score, label=label, threshold=threshold, min_rows=min_rows)
    by_slice = (
        slice_metrics(df, slices, score=score, label=label, threshold=threshold, min_rows=min_rows) if slices else None
    )
    calibration = calibration_errors(df, score=score, label=label)
    return EvaluationReport(
        model_version=model_version,
        global_metrics=overall.withColumn("model_version", F.lit(model_version)),
        slice_metrics=by_slice,
        calibration=calibration,
        curve=calibration_curve(df, score=score, label=label),
        thresholds=threshold_analysis(df, score=score, label=label),
        precision_at_k=precision_at_k(df, score, label, ident, min_rows=min_rows),
        warnings=report_warnings(overall, by_slice, calibration),
    )
