import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import embeddings, model, stress
from riskweave.operators.evaluation import classification_metrics
from riskweave.operators.features import model_inputs

SMALL = {"trees": 5, "depth": 3}


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        y = int(rng.random() < 0.15)
        rows.append((i, float(rng.normal(3 * y, 1)), float(rng.normal()), int(rng.integers(0, 24)), y))
    return spark.createDataFrame(rows, "transaction_id bigint, signal double, noise double, hour int, label int").cache()


@pytest.fixture(scope="module")
def fitted(train):
    return model.train_model(train, params=SMALL)


def test_scores(spark, train, fitted):
    scored = fitted.predict(train)
    low, high, bad = scored.agg(F.min("score"), F.max("score"), F.sum(F.isnan("score").cast("int"))).first()
    assert 0 <= low <= high <= 1 and bad == 0
    assert classification_metrics(scored).first()["roc_auc"] > 0.9
    assert fitted.importance(spark).first()["feature"] == "signal"
    assert set(fitted.metrics) == {"precision", "recall", "f1", "roc_auc", "pr_auc", "brier_score"}
    extreme = spark.createDataFrame([(1, 1e12, -1e12, 3)], "transaction_id int, signal double, noise double, hour int")
    assert 0 <= fitted.score(extreme).first()["score"] <= 1


def test_save_and_load(spark, train, fitted, tmp_path):
    fitted.save(str(tmp_path / "m"), spark)
    again = model.ScoreModel.load(str(tmp_path / "m"), spark)
    assert again.features == fitted.features and again.params == fitted.params
    assert again.score(train).agg(F.sum("score")).first()[0] == pytest.approx(fitted.score(train).agg(F.sum("score")).first()[0])


def test_splits(train):
    a, b = model.stratified_split(train)
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    assert {r["label"]: r["count"] for r in b.groupBy("label").count().collect()} == {k: round(v * 0.2) for k, v in sizes.items()}
    assert a.join(b, "transaction_id").count() == 0 and a.count() + b.count() == 600
    timed = train.withColumn("timestamp", F.timestamp_seconds("transaction_id"))
    early, late = model.time_split(timed)
    assert early.count() == 480 and late.count() == 120


def test_stress(train, fitted):
    scored = fitted.score(train)
    flipped = stress.noisy_labels(scored).select("transaction_id", F.col("label").alias("y")).join(scored, "transaction_id")
    assert flipped.filter("y <> label").count() == 60
    cols = [c for c in model_inputs(train) if c != "label"]
    blank = stress.blanked_features(train, ["signal"]).join(train.select("transaction_id", F.col("signal").alias("s")), "transaction_id")
    assert blank.filter("signal = 0 and s <> 0").count() == 120
    moved = stress.perturbed_features(train, ["signal"]).join(train.select("transaction_id", F.col("signal").alias("s")), "transaction_id")
    assert moved.filter("signal <> s").count() == 60
    noise = moved.filter("signal <> s").agg(F.stddev(F.col("signal") - F.col("s"))).first()[0]
    assert 0.3 < noise / train.agg(F.stddev("signal")).first()[0] < 0.7
    out = {r["name"]: r for r in stress.run_suite(scored, fitted.score, ).collect()}
    assert set(out) == {"label_noise", "feature_perturbation", "missing_features", "class_imbalance"} and cols
    rare = stress.rarer_positives(scored, 0.05)
    assert rare.filter("label = 1").count() == scored.filter("label = 1").count()
    assert stress.class_imbalance(scored, target=0.9).first()["description"].startswith("positives are already rare")


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(4)
    dense = rng.poisson(1.0, (30, 12)).astype(float)
    rows = [(f"r{i}", f"c{j}", float(np.log1p(dense[i, j]))) for i in range(30) for j in range(12) if dense[i, j]]
    pairs = spark.createDataFrame(rows, "r string, c string, weight double")
    got = embeddings.truncated_svd(pairs, "r", "c", 4)
    u, s, vt = np.linalg.svd(np.log1p(dense), full_matrices=False)
    assert np.allclose(got.singular, s[:4], rtol=1e-8)
    cols = {r["c"]: r["v"] for r in got.columns.collect()}
    for k in range(4):
        mine, ref = np.array([cols[f"c{j}"][k] for j in range(12)]), vt[k] * s[k]
        assert np.allclose(np.abs(mine), np.abs(ref), atol=1e-6) and mine[np.argmax(np.abs(mine))] > 0
    rws = {r["r"]: r["v"] for r in got.rows.collect()}
    approx = np.array([rws[f"r{i}"] for i in range(30)]) / np.array(got.singular) @ np.array([cols[f"c{j}"] for j in range(12)]).T
    assert np.allclose(approx, u[:, :4] * s[:4] @ vt[:4], atol=1e-6)


def test_embeddings_lookup(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(i, f"u{rng.integers(0, 12)}", f"m{rng.integers(0, 7)}", f"d{rng.integers(0, 9)}") for i in range(500)]
    df = spark.createDataFrame(rows, "transaction_id int, user_id string, merchant_id string, device_id string")
    emb = embeddings.fit_embeddings(df, rounds=2)
    assert {k: len(v) for k, v in emb.defaults.items()} == {"user": 6, "merchant": 7, "device": 9}
    emb.save(str(tmp_path / "e"))
    again = embeddings.EntityEmbeddings.load(str(tmp_path / "e"), spark)
    new = spark.createDataFrame([(1, "u1", "nobody")], "transaction_id int, user_id string, merchant_id string")
    row = again.features(new).first()
    assert row["merchant_emb_0"] == pytest.approx(emb.defaults["merchant"][0]) and row["device_emb_0"] == pytest.approx(emb.defaults["device"][0])
    known = emb.vectors.filter("entity_type = 'user' and entity_id = 'u1'").first()["vector"]
    assert row["user_emb_0"] == pytest.approx(known[0])


def test_early_stop_counts_rounds_without_gain():
    from riskweave.operators.model import best_round

    assert best_round([5.0, 4.0, 4.5, 4.6, 3.0], 3) == 5
    assert best_round([5.0, 4.0, 4.5, 4.6, 3.0], 2) == 2
    assert best_round([1.0], 20) == 1


def test_registered_queries_fit_the_default_model_with_early_stop(train, monkeypatch):
    from riskweave.plans import model_queries

    seen = {}

    def fit(rows, **kw):
        seen.update(kw, train=rows)

    monkeypatch.setattr(model, "fit_model", fit)
    _, test = model_queries._fitted(train)
    assert {**model.DEFAULT_PARAMS, **(seen.get("params") or {})} == model.DEFAULT_PARAMS
    assert seen["valid"] is test and seen["train"].join(test, "transaction_id").count() == 0


def test_a_cut_ensemble_equals_a_second_fit(spark, tmp_path):
    rows = spark.range(500).selectExpr("id AS transaction_id", "rand(1) AS a", "rand(2) AS b")
    df = rows.withColumn("label", (F.col("a") + F.rand(5) * 0.8 > 0.9).cast("int"))
    train, valid = df.filter("transaction_id % 3 <> 0"), df.filter("transaction_id % 3 = 0")
    params = {"trees": 12, "depth": 3, "stop_rounds": 3}
    short = model.fit_model(train, features=["a", "b"], valid=valid, params=params, with_metrics=False)
    n = short.model.getNumTrees
    assert 1 <= n <= 12
    again = model.fit_model(train, features=["a", "b"], params={**params, "trees": n}, with_metrics=False)
    trees = lambda m: m.model.toDebugString.split("\n", 1)[1]
    assert trees(short) == trees(again)
    both = short.score(valid).withColumnRenamed("score", "s").join(again.score(valid).select("transaction_id", "score"), "transaction_id")
    assert both.agg(F.max(F.abs(F.col("s") - F.col("score")))).first()[0] == 0
    short.save(str(tmp_path / "m"), spark)
    loaded = model.ScoreModel.load(str(tmp_path / "m"), spark)
    assert loaded.model.getNumTrees == n and sorted(map(tuple, loaded.importance(spark).collect())) == sorted(map(tuple, short.importance(spark).collect()))
    assert model.first_trees(short.model, n + 5) is short.model


def test_rows_of_one_file_are_dealt_over_all_fit_partitions(spark, monkeypatch):
    monkeypatch.setattr(model, "ROWS_PER_PARTITION", 100)
    rows = spark.range(0, 1_000, 1, 1).toDF("id")
    with model._held(rows) as held:
        sizes = [r["count"] for r in held.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 2 * min(sizes) and sum(sizes) == 1_000
    monkeypatch.undo()
    with model._held(rows) as held:
        assert held.rdd.getNumPartitions() == 1
    assert model.fit_partitions(0) == 1 and model.fit_partitions(10**6) == model.EVEN_PARTITIONS
    assert model.fit_partitions(10**9) == -(-(10**9) // model.MOST_ROWS)


def test_trees_after_the_stop_are_not_fitted(spark, monkeypatch):
    rows = spark.range(0, 300, 1, 1).selectExpr("id AS transaction_id", "rand(1) AS a", "rand(2) AS b", "int(rand(3) > 0.6) AS label")
    train, valid = rows.filter("transaction_id % 3 <> 0"), rows.filter("transaction_id % 3 = 0")
    seen, search = [], model.best_round

    def counted(losses, stop_rounds):
        seen.append(len(losses))
        return search(losses, stop_rounds)

    monkeypatch.setattr(model, "best_round", counted)
    params = {"trees": 16, "depth": 3, "stop_rounds": 2}
    short = model.fit_model(train, features=["a", "b"], valid=valid, params=params, with_metrics=False)
    assert seen == [8] and short.model.getNumTrees <= 6
    again = model.fit_model(train, features=["a", "b"], params={**params, "trees": 16}, with_metrics=False)
    trees = lambda m: m.toDebugString.split("\n", 1)[1]
    assert trees(model.first_trees(again.model, short.model.getNumTrees)) == trees(short.model)
    seen.clear()
    model.fit_model(train, features=["a", "b"], valid=valid, params={**params, "trees": 4, "stop_rounds": 20}, with_metrics=False)
    assert seen == [2, 4]
