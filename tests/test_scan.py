import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskweave.operators.sampling import chosen_flag, hash_cutoffs
from riskweave.operators.scan import HOT_ROWS, exact_quantiles, running, value_at_rank, with_neighbours

PATHS = pytest.mark.parametrize("min_rows", [HOT_ROWS, 5], ids=["plain", "sliced"])


def frame(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    rows = [(None if k == "c" else str(k), int(t), int(i), float(v)) for i, (k, t, v) in enumerate(zip(key, rng.integers(0, 60, n), rng.normal(size=n)))]
    return spark.createDataFrame(rows, "k string, t bigint, id bigint, v double"), pd.DataFrame(rows, columns=["k", "t", "id", "v"])


@PATHS
@pytest.mark.parametrize("mode", ["rows", "strict", "current", "down"])
def test_running_matches_brute_force(spark, min_rows, mode):
    df, pdf = frame(spark)
    kw = {"strict": {"strictly_before": True}, "current": {"include_current": True}, "down": {"descending": True}}.get(mode, {})
    aggs = {"s": ("sum", F.col("id")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))}
    ties = [] if mode == "strict" else ["id"]
    got = running(df, ["k"], "t", aggs, ties=ties, min_rows=min_rows, **kw).toPandas().set_index("id")
    pdf["k"] = pdf["k"].fillna("-")
    for r in pdf.itertuples():
        same = pdf[pdf.k == r.k]
        if mode == "strict":
            past = same[same.t < r.t]
        elif mode == "down":
            past = same[(same.t > r.t) | ((same.t == r.t) & (same.id < r.id))]
        else:
            past = same[(same.t < r.t) | ((same.t == r.t) & (same.id < r.id))]
            if mode == "current":
                past = pd.concat([past, same[same.id == r.id]])
        g = got.loc[r.id]
        if past.empty:
            assert pd.isna(g.s) and pd.isna(g.hi) and pd.isna(g.lo)
        else:
            assert g.s == past.id.sum() and g.hi == past.v.max() and g.lo == past.v.min()


@PATHS
def test_neighbours(spark, min_rows):
    df, pdf = frame(spark)
    got = with_neighbours(df, ["k"], "t", ["id"], "p", "n", min_rows).toPandas().set_index("id")
    for _, g in pdf.fillna("-").sort_values(["t", "id"]).groupby("k"):
        ids, ts = g.id.tolist(), g.t.tolist()
        for i, ident in enumerate(ids):
            p, n = got.loc[ident, "p"], got.loc[ident, "n"]
            assert (pd.isna(p) if i == 0 else p == ts[i - 1]) and (pd.isna(n) if i == len(ids) - 1 else n == ts[i + 1])


@PATHS
def test_quantiles_match_numpy(spark, min_rows):
    df, pdf = frame(spark)
    probs = [0, 0.1, 0.3, 0.5, 0.95, 1]
    got = exact_quantiles(df, [], "v", probs, min_rows=min_rows).first()
    assert got["n"] == len(pdf) and np.allclose(got["q"], np.quantile(pdf.v, probs), rtol=1e-12)
    per = {r["k"]: r["q"] for r in exact_quantiles(df.filter("k is not null"), ["k"], "v", probs, min_rows=min_rows).collect()}
    for k, g in pdf.dropna().groupby("k"):
        assert np.allclose(per[k], np.quantile(g.v, probs), rtol=1e-12)


def test_floor_quantile_and_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert exact_quantiles(df, [], "v", [0.5, 0.95, 0.99, 1.0], rule="floor").first()["q"] == [5.0, 9.0, 9.0, 9.0]
    assert value_at_rank(df, "v", 3) == 3.0 and value_at_rank(df, "v", 10) is None
    assert exact_quantiles(df.filter("v < 0"), [], "v", [0.5]).first() is None


@pytest.mark.parametrize("n", [0, 1, 137, 4000, 5000])
def test_exact_choice(spark, n):
    df = spark.range(5000)
    assert df.filter(chosen_flag(df, "id", n, 5000, "s")).count() == n


def test_choice_differs_by_salt_and_repeats(spark):
    df = spark.range(3000)
    cuts = hash_cutoffs(df, "id", 300, 3000, ["a", "b"])
    assert cuts["a"] != cuts["b"] and cuts == hash_cutoffs(df.repartition(7), "id", 300, 3000, ["a", "b"])


def test_every_hot_group_is_sliced_by_its_own_values(spark):
    from riskweave.operators.scan import slice_hot_groups

    df = spark.range(2_000 * 40).select((F.col("id") % 2_000).alias("k"), (F.col("id") % 2_000 * 10_000 + F.floor(F.col("id") / 2_000)).alias("t"))
    sizes = slice_hot_groups(df, ["k"], "t", 10).groupBy("k", "_sl_gid", "_sl_no").count()
    worst = sizes.agg(F.max("count"), F.count(F.lit(1)), F.min("_sl_gid")).first()
    assert worst[0] <= 20 and worst[1] >= 8_000 and worst[2] >= 0


def test_slices_too_large_for_one_round_are_cut_again(spark):
    from riskweave.operators.scan import slice_hot_groups

    df = spark.range(3_000).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("t"))
    sliced = slice_hot_groups(df, ["k"], "t", 5)
    assert sliced.groupBy("_sl_no").count().agg(F.max("count")).first()[0] <= 10
    edges = sliced.groupBy("_sl_no").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("_sl_no").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(edges, edges[1:]))


def test_step_tables_can_be_forgotten(spark):
    from riskweave.session import cut_lineage, forget_steps

    forget_steps(spark)
    kept = cut_lineage(spark.range(5))
    assert kept.count() == 5 and forget_steps(spark) == 1 and forget_steps(spark) == 0
