"""Stress tests on a scored table: noisy labels, perturbed and missing inputs, rare positives."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hash_unit, ranked_hash
from .evaluation import classification_metrics
from .features import model_inputs
from .sampling import chosen_flag, hash_cutoffs

RESULT = "name string, description string, passed boolean, baseline double, stressed double, degradation double, threshold double"
Scorer = Callable[[DataFrame], DataFrame]
SEED = 42


def _metric(df: DataFrame, metric: str, label: str, score: str, threshold: float = 0.5) -> float:
    row = classification_metrics(df, score=score, label=label, threshold=threshold).select(metric).first()
    return 0.0 if row is None or row[0] is None else float(row[0])


def _degradation(base: float, stressed: float) -> float:
    return (base - stressed) / base if base > 0 else 0.0


# --- fixed values: default rates and limits of the tests ---------------------------------------------
NOISE_RATE, NOISE_LIMIT = 0.1, 0.1
PERTURBED_RATE, PERTURBED_LIMIT = 0.1, 0.15
BLANK_RATE, BLANK_LIMIT = 0.2, 0.2
RARE_TARGET, RARE_LIMIT = 0.01, 0.5
# ------------------------------------------------------------------------------------------


def _result(df: DataFrame, name: str, text: str, passed: bool, base: float, stressed: float, limit: float) -> DataFrame:
    row = (name, text, passed, base, stressed, _degradation(base, stressed), limit)
    return df.sparkSession.createDataFrame([row], RESULT)


def noisy_labels(df: DataFrame, rate: float = NOISE_RATE, *, label: str = "label", ident: str = "transaction_id", seed: int = SEED) -> DataFrame:
    """Flip floor(n * rate) labels."""
    n = df.count()
    flip = chosen_flag(df, ident, int(n * rate), n, f"labels-{seed}")
    return df.withColumn(label, F.when(flip, 1 - F.col(label)).otherwise(F.col(label)))


def label_noise(df: DataFrame, rate: float = NOISE_RATE, *, metric: str = "pr_auc", max_degradation: float = NOISE_LIMIT,
                score: str = "score", label: str = "label", ident: str = "transaction_id", seed: int = SEED,
                baseline: float | None = None) -> DataFrame:
    base = _metric(df, metric, label, score) if baseline is None else baseline
    stressed = _metric(noisy_labels(df, rate, label=label, ident=ident, seed=seed), metric, label, score)
    ok = _degradation(base, stressed) <= max_degradation
    return _result(df, "label_noise", f"{rate:.0%} of the labels flipped", ok, base, stressed, max_degradation)


def _inputs(df: DataFrame, columns: Sequence[str] | None, label: str, score: str) -> list[str]:
    return list(columns) if columns else [c for c in model_inputs(df) if c not in (label, score)]


def _per_column(df: DataFrame, columns: Sequence[str], rate: float, ident: str, kind: str, seed: int) -> dict[str, Column]:
    n = df.count()
    salts = {c: f"{kind}-{c}-{seed}" for c in columns}
    cuts = hash_cutoffs(df, ident, int(n * rate), n, list(salts.values()))
    if int(n * rate) <= 0:
        return {c: F.lit(False) for c in columns}
    return {c: ranked_hash(F.col(ident), s) <= F.lit(cuts[s]) for c, s in salts.items()}


def perturbed_features(df: DataFrame, columns: Sequence[str], rate: float = PERTURBED_RATE, *, ident: str = "transaction_id", seed: int = SEED) -> DataFrame:
    """Per column, add normal noise of half its deviation to floor(n * rate) rows.

    The noise is a function of id and column, so a task that runs again produces it again.
    """
    chosen = _per_column(df, columns, rate, ident, "noise", seed)
    std = df.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    out = {}
    for c in columns:
        u, v = hash_unit(F.col(ident), c, seed, "u"), hash_unit(F.col(ident), c, seed, "v")
        normal = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
        noise = normal * F.lit((std[c] or 0.0) * 0.5)
        out[c] = F.when(chosen[c], F.col(c) + noise).otherwise(F.col(c).cast("double"))
    return df.withColumns(out)


def feature_perturbation(df: DataFrame, scorer: Scorer, rate: float = PERTURBED_RATE, *, columns: Sequence[str] | None = None,
                         metric: str = "pr_auc", max_degradation: float = PERTURBED_LIMIT, score: str = "score",
                         label: str = "label", ident: str = "transaction_id", seed: int = SEED,
                         baseline: float | None = None) -> DataFrame:
    base = _metric(df, metric, label, score) if baseline is None else baseline
    changed = perturbed_features(df.drop(score), _inputs(df, columns, label, score), rate, ident=ident, seed=seed)
    stressed = _metric(scorer(changed), metric, label, score)
    ok = _degradation(base, stressed) <= max_degradation
    return _result(df, "feature_perturbation", f"noise in {rate:.0%} of each feature", ok, base, stressed, max_degradation)


def blanked_features(df: DataFrame, columns: Sequence[str], rate: float = BLANK_RATE, *, ident: str = "transaction_id", seed: int = SEED) -> DataFrame:
    """Per column, set floor(n * rate) rows to 0."""
    chosen = _per_column(df, columns, rate, ident, "blank", seed)
    return df.withColumns({c: F.when(chosen[c], F.lit(0)).otherwise(F.col(c)) for c in columns})


def missing_features(df: DataFrame, scorer: Scorer, rate: float = BLANK_RATE, *, columns: Sequence[str] | None = None,
                     metric: str = "pr_auc", max_degradation: float = BLANK_LIMIT, score: str = "score",
                     label: str = "label", ident: str = "transaction_id", seed: int = SEED,
                     baseline: float | None = None) -> DataFrame:
    base = _metric(df, metric, label, score) if baseline is None else baseline
    changed = blanked_features(df.drop(score), _inputs(df, columns, label, score), rate, ident=ident, seed=seed)
    stressed = _metric(scorer(changed), metric, label, score)
    ok = _degradation(base, stressed) <= max_degradation
    return _result(df, "missing_features", f"{rate:.0%} of each feature blanked", ok, base, stressed, max_degradation)


def rarer_positives(df: DataFrame, target: float = RARE_TARGET, *, label: str = "label", ident: str = "transaction_id", seed: int = SEED) -> DataFrame:
    """All positives with as many negatives as bring their share to ``target``."""
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("p")).first()
    positives, negatives = int(counts["p"] or 0), int(counts["n"] - (counts["p"] or 0))
    wanted = min(int(positives / target - positives), negatives)
    keep = chosen_flag(df.filter(F.col(label) == 0), ident, wanted, max(negatives, 1), f"imbalance-{seed}")
    return df.filter((F.col(label) == 1) | keep)


def class_imbalance(df: DataFrame, target: float = RARE_TARGET, *, metric: str = "recall", min_performance: float = RARE_LIMIT,
                    score: str = "score", label: str = "label", ident: str = "transaction_id", seed: int = SEED) -> DataFrame:
    base = _metric(df, metric, label, score)
    rate = df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    if rate <= target:
        return _result(df, "class_imbalance", f"positives are already rare ({rate:.2%})", True, base, base, min_performance)
    stressed = _metric(rarer_positives(df, target, label=label, ident=ident, seed=seed), metric, label, score)
    return _result(df, "class_imbalance", f"positives thinned out to {target:.2%}", stressed >= min_performance, base, stressed, min_performance)


def run_suite(df: DataFrame, scorer: Scorer, *, score: str = "score", label: str = "label", **kw) -> DataFrame:
    """One result row per test. The scored table is stored while the tests read it."""
    stored = df.persist(StorageLevel.DISK_ONLY)
    try:
        kw = {"score": score, "label": label, **kw}
        base = _metric(stored, "pr_auc", label, score)
        return (
            label_noise(stored, baseline=base, **kw)
            .unionByName(feature_perturbation(stored, scorer, baseline=base, **kw))
            .unionByName(missing_features(stored, scorer, baseline=base, **kw))
            .unionByName(class_imbalance(stored, **kw))
        )
    finally:
        stored.unpersist()
