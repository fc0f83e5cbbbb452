"""Choosing exactly n rows by a hash of their id: repeatable on any partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import one_if, ranked_hash
from .scan import running


def hash_cutoffs(df: DataFrame, ident: str, n: int, total: int, salts: Sequence[str]) -> dict[str, int]:
    """Per salt the n-th smallest hash among the rows.

    Hashes are uniform, so that rank lies close to n/total of the range. One scan counts the
    hashes below a bracket of twelve deviations around it; only those inside are ranked. Should
    the bracket miss, everything is ranked.
    """
    if n <= 0:
        return {s: -(2**63) for s in salts}
    share = n / total
    slack = 12 * math.sqrt(max(share * (1 - share), 1.0 / total) / total)
    low = int(max(-1.0, 2 * (share - slack) - 1) * 2**63)
    high = int(min(1.0, 2 * (share + slack) - 1) * 2**63)
    low, high = max(low, -(2**63)), min(high, 2**63 - 1)
    hashes = {s: ranked_hash(F.col(ident), s) for s in salts}
    counts = df.agg(*[c for i, (s, h) in enumerate(hashes.items()) for c in (
        F.sum(one_if(h < F.lit(low))).alias(f"b{i}"), F.sum(one_if(h <= F.lit(high))).alias(f"t{i}"))]).first()
    near, ranks = [], []
    for i, (s, h) in enumerate(hashes.items()):
        below, upto = counts[f"b{i}"] or 0, counts[f"t{i}"] or 0
        lo, hi, rank = low, high, n - 1 - below
        if not below < n <= upto:
            lo, hi, rank = -(2**63), 2**63 - 1, n - 1
        inside = (h >= F.lit(lo)) & (h <= F.lit(hi))
        near.append(F.struct(F.lit(i).alias("_salt"), F.when(inside, h).alias("_h")))
        ranks.append(rank)
    rows = df.select(F.inline(F.array(*near))).filter(F.col("_h").isNotNull())
    ranked = running(rows, ["_salt"], "_h", {"_rank": ("sum", F.lit(1))})
    wanted = F.array(*[F.lit(r) for r in ranks])[F.col("_salt")]
    # one row per salt comes back
    hits = {r["_salt"]: r["_h"] for r in ranked.filter(F.coalesce("_rank", F.lit(0)) == wanted).select("_salt", "_h").collect()}
    return {s: hits.get(i, 2**63 - 1) for i, s in enumerate(hashes)}


def chosen_flag(df: DataFrame, ident: str, n: int, total: int, salt: str) -> Column:
    """A condition that holds for the n rows of ``df`` with the smallest salted hash.

    Ids are taken to be unique; rows that share an id are chosen or left together.
    """
    if n <= 0:
        return F.lit(False)
    cut = hash_cutoffs(df, ident, n, total, [salt])[salt]
    return ranked_hash(F.col(ident), salt) <= F.lit(cut)
