"""Rank-based measures over a score, built on distinct scores and running counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranked_hash
from .scan import HOT_ROWS, NO_HOT_GROUPS, running, value_at_rank


def score_ladder(
    df: DataFrame, groups: Sequence[str], score: str, label: str, min_rows: int = HOT_ROWS,
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per (group, score): counts at the score and counts strictly above it, with the sums of ``totals``."""
    keys = list(groups)
    counts = df.groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_pos"),
        *[F.sum(c).alias(n) for n, c in (totals or {}).items()],
    )
    ladder = running(
        counts, keys, score,
        {"_n_above": ("sum", F.col("_n")), "_pos_above": ("sum", F.col("_pos"))},
        descending=True, min_rows=min_rows, probe=df.select(*keys, score),
    )
    return ladder.na.fill(0, ["_n_above", "_pos_above"])


def ranking_quality(
    df: DataFrame, groups: Sequence[str], score: str = "score", label: str = "label",
    min_rows: int = HOT_ROWS, totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``roc_auc`` (ties count half) and ``pr_auc`` (average precision) per group, both null when the group
    holds only one class, and the sums of the columns of ``totals``: all from one pass over the rows.
    """
    totals = dict(totals or {})
    keys = list(groups) or ["_all"]
    base = df if groups else df.withColumn("_all", F.lit(0))
    ladder = score_ladder(base, keys, score, label, min_rows, totals)
    neg = F.col("_n") - F.col("_pos")
    won = neg.cast("double") * (F.col("_pos_above") + F.col("_pos") / 2.0)
    precision = (F.col("_pos_above") + F.col("_pos")) / (F.col("_n_above") + F.col("_n"))
    sums = ladder.groupBy(*keys).agg(
        F.sum("_pos").alias("_p"), F.sum(neg).alias("_q"),
        F.sum(won).alias("_won"), F.sum(F.col("_pos") * precision).alias("_ap"), *[F.sum(n).alias(n) for n in totals],
    )
    both = (F.col("_p") > 0) & (F.col("_q") > 0)
    auc = F.try_divide(F.col("_won"), F.col("_p").cast("double") * F.col("_q").cast("double"))
    ap = F.try_divide(F.col("_ap"), F.col("_p").cast("double"))
    return sums.select(*groups, *totals, F.when(both, auc).alias("roc_auc"), F.when(both, ap).alias("pr_auc"))


def precision_at_k(
    df: DataFrame,
    score: str = "score",
    label: str = "label",
    ident: str = "transaction_id",
    k_values: Sequence[int] | None = None,
    min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows (k, precision_at_k): the mean label of the k highest scores, ties by id.

    k may be a fifth of the table, so no top-k list is built: for each k the score at that rank
    is looked up, then the id at the remaining rank among equal scores, then one aggregate
    counts what lies above that point.
    """
    n = df.count()
    if n <= min_rows:
        min_rows = NO_HOT_GROUPS
    # fixed values: default review shares
    shares = [0.01, 0.05, 0.1, 0.2]
    ks = [int(n * s) for s in shares] if k_values is None else list(k_values)
    ks = [k for k in ks if 0 < k <= n]
    ks = list(dict.fromkeys(ks))
    spark = df.sparkSession
    if not ks:
        return spark.createDataFrame([], "k long, precision_at_k double")
    ladder = score_ladder(df.withColumn("_all", F.lit(0)), ["_all"], score, label, min_rows)
    hits = []
    for k in ks:
        inside = (F.col("_n_above") < k) & (F.lit(k) <= F.col("_n_above") + F.col("_n"))
        hits.append(F.max(F.when(inside, F.struct(F.col(score), F.col("_n_above"), F.col("_pos_above"), F.col("_n"), F.col("_pos")))))
    cuts = ladder.agg(*[h.alias(f"k{i}") for i, h in enumerate(hits)]).first()
    numeric = dict(df.dtypes)[ident] in ("bigint", "int", "smallint", "tinyint", "double", "float")
    rows = []
    for i, k in enumerate(ks):
        at, above, pos_above, tied, tied_pos = cuts[f"k{i}"]
        rest = k - above
        if rest == tied:
            positives = pos_above + tied_pos
        else:
            ties = df.filter(F.col(score) == F.lit(at)).withColumn(
                "_tie", F.col(ident) if numeric else ranked_hash(F.col(ident))
            )
            last = value_at_rank(ties, "_tie", rest - 1, min_rows)
            extra = ties.filter(F.col("_tie") <= F.lit(last)).agg(F.sum(label)).first()[0] or 0
            positives = pos_above + int(extra)
        rows.append((k, positives / k))
    return spark.createDataFrame(rows, "k long, precision_at_k double")
