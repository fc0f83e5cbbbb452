import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import boosting, model

NUMBER = re.compile(r"-?\d+\.\d+(?:E-?\d+)?")
FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        a, b, c = float(rng.random() * 10), float(rng.normal()), int(rng.integers(0, 5))
        rows.append((i, a, b, c, int(a / 10 + 0.3 * b + c / 10 + rng.random() * 0.8 > 1.2), 1.0 + i % 3))
    df = spark.createDataFrame(rows, "transaction_id bigint, a double, b double, c int, label int, share double").repartition(3, "transaction_id").cache()
    return df.filter("transaction_id % 3 <> 0"), df.filter("transaction_id % 3 = 0")


@pytest.fixture
def packed(monkeypatch):
    """Tables of more than a hundred rows are fitted on packed rows."""
    monkeypatch.setattr(model, "ROWS_PER_PARTITION", 100)


def _trees(fitted):
    return fitted.model.toDebugString.split("\n", 1)[1]


@pytest.mark.parametrize("weight, jobs", [(None, False), ("share", True)])
def test_packed_rows_grow_the_trees_of_sparks_learner(spark, parts, weight, jobs, monkeypatch):
    train, valid = parts
    params = {"trees": 4, "depth": 4, "stop_rounds": 9, "row_share": 1.0, "column_share": 1.0}
    kw = dict(features=FEATURES, valid=valid, params=params, with_metrics=False, weight=weight)
    plain = model.fit_model(train, **kw)
    with monkeypatch.context() as m:
        m.setattr(model, "ROWS_PER_PARTITION", 100)
        m.setattr(boosting, "STEP_ROWS", 64)
        m.setattr(boosting, "MOST_CODES", 70)
        m.setattr(boosting, "BLOCK_ROWS", 100)
        m.setattr(boosting, "CHUNK_ROWS", 50)
        m.setattr(boosting, "CHECKPOINT_TREES", 3)
        if jobs:
            m.setattr(boosting, "exchange_folder", lambda spark: None)
        mine = model.fit_model(train, **kw)
    assert NUMBER.sub("#", _trees(mine)) == NUMBER.sub("#", _trees(plain))
    numbers = [[float(x) for x in NUMBER.findall(_trees(m))] for m in (mine, plain)]
    assert np.allclose(*numbers, rtol=1e-9, atol=1e-12)
    assert np.allclose(mine.model.featureImportances.toArray(), plain.model.featureImportances.toArray(), rtol=1e-9)
    both = [[r["score"] for r in m.score(valid).orderBy("transaction_id").collect()] for m in (mine, plain)]
    assert np.allclose(*both, rtol=1e-9)
    assert mine.model.getMaxIter() == 4 and mine.model.getMaxDepth() == 4


def test_losses_are_those_of_the_model(spark, parts, packed, monkeypatch):
    train, valid = parts
    seen = []
    monkeypatch.setattr(model, "best_round", lambda losses, stop: seen.append(list(losses)) or len(losses))
    fitted = model.fit_model(train, features=FEATURES, valid=valid, params={"trees": 3, "depth": 2}, with_metrics=False)
    staged = model._assemble(valid.withColumn("_w", F.when(F.col("label") == 1, 10.0).otherwise(1.0)), FEATURES)
    want = fitted.model.evaluateEachIteration(staged.withColumn("_y", F.col("label").cast("double")))
    assert np.allclose(seen[-1], want)


def test_a_large_fit_ends_with_the_tree_that_settles_the_best_round(spark, packed, monkeypatch):
    rows = spark.range(0, 300, 1, 1).selectExpr("id AS transaction_id", "rand(1) AS a", "rand(2) AS b", "int(rand(3) > 0.6) AS label")
    train, valid = rows.filter("transaction_id % 3 <> 0"), rows.filter("transaction_id % 3 = 0")
    seen, search = [], model.best_round
    monkeypatch.setattr(model, "best_round", lambda losses, stop: seen.append(len(losses)) or search(losses, stop))
    fitted = model.fit_model(train, features=["a", "b"], valid=valid, params={"trees": 40, "depth": 3, "stop_rounds": 2}, with_metrics=False)
    assert max(seen) == fitted.model.getNumTrees + 2 < 20


def test_draws_do_not_follow_the_blocks(spark, parts, packed, monkeypatch):
    train, valid = parts
    params, found = {"trees": 3, "depth": 3, "column_share": 0.6}, []
    for blocks in (1, 3):
        monkeypatch.setattr(model, "concurrent_tasks", lambda spark, n=blocks: n)
        found.append(model.fit_model(train, features=FEATURES, valid=valid, params=params, with_metrics=False))
    one, three = (_trees(m) for m in found)
    assert NUMBER.sub("#", one) == NUMBER.sub("#", three)
    whole = model.fit_model(train, features=FEATURES, valid=valid, params={**params, "row_share": 1.0}, with_metrics=False)
    assert _trees(whole) != three
    bag = boosting._bag([(0, 0, 4_000), (1, 0, 4_000)], 1, 42, 0.8)
    assert 0.77 < np.unpackbits(bag, count=8_000).mean() < 0.83


def test_rows_the_learner_refuses(spark, packed):
    rows = spark.range(0, 300, 1, 2).selectExpr("double(id) AS a", "int(id % 2) AS label")
    for bad in (rows.withColumn("label", F.lit(2)), rows.withColumn("label", F.lit(None).cast("int")),
                rows.withColumn("a", F.lit(float("nan"))), rows.withColumn("w", F.lit(-1.0))):
        with pytest.raises(Exception, match="labels must be|not a number|weights must be"):
            model.fit_model(bad, features=["a"], weight="w" if "w" in bad.columns else None, params={"trees": 2, "depth": 2}, with_metrics=False)


def test_nothing_to_split_on_gives_one_leaf(spark, packed):
    rows = spark.range(0, 300, 1, 2).selectExpr("1.0D AS a", "int(id % 3 = 0) AS label")
    fitted = model.fit_model(rows, features=["a"], params={"trees": 1, "depth": 3, "row_share": 1.0}, with_metrics=False)
    assert fitted.model.totalNumNodes == 1
    mean = (10 * 100 - 200) / (10 * 100 + 200)
    assert fitted.score(rows).first()["score"] == pytest.approx(1 / (1 + np.exp(-2 * mean)))


def test_joint_codes_stand_for_the_bins(monkeypatch):
    monkeypatch.setattr(boosting, "MOST_CODES", 40)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 32, 500)
    bins = np.array([x, x // 8, rng.integers(0, 32, 500), x > 30, rng.integers(0, 2, 500)], np.uint8)
    codes, columns = boosting.joint_codes(bins, [32, 4, 32, 2, 2])
    assert [m for m, _ in columns] == [[0, 1, 3], [2], [4]]
    for code, (members, stands) in zip(codes, columns):
        assert (stands[code].T == bins[members]).all()


def test_thresholds_share_the_weight(spark, monkeypatch):
    assert boosting.thresholds_of(np.array([1.0, 2.0, 4.0]), np.ones(3), 32).tolist() == [1.5, 3.0]
    monkeypatch.setattr(boosting, "SUMMARY_ROWS", 1_000)
    monkeypatch.setattr(boosting, "SUMMARIES", 3)
    rows = spark.range(0, 20_000, 1, 3).selectExpr("rand(4) * 100 AS _f0", "double(id % 300) AS _f1", "0.0D AS _f2", "0.0D AS _y", "double(1 + 9 * int(id % 10 = 0)) AS _w")
    first, second, third = boosting.candidate_thresholds(rows, 3, 32)
    data = np.array(rows.select("_f0", "_w").collect())
    shares = [data[data[:, 0] <= c, 1].sum() / data[:, 1].sum() for c in first]
    assert len(first) == 31 and np.allclose(shares, np.arange(1, 32) / 32, atol=0.01)
    assert len(second) in (30, 31) and (np.diff(second) > 0).all() and len(third) == 0
