"""Queries that train, embed or draw rows; their results have no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import embeddings, features, model, stress
from ..session import cut_lineage
from .evaluation_queries import scored
from .views import transactions


def _table(spark, sf_dir):
    t = transactions(spark, sf_dir)
    out = features.RiskFeatures().fit_transform(t)
    return cut_lineage(out.join(t.select("transaction_id", F.col("is_fraud").alias("label")), "transaction_id"))


def _fitted(table):
    """Default parameters; the part held out picks the number of trees, as in ``model.train_model``."""
    train, test = model.stratified_split(table)
    names = [c for c in features.model_inputs(table) if c != "label"]
    return model.fit_model(train, features=names, valid=test, with_metrics=False), test


def model_scores(spark, sf_dir):
    table = _table(spark, sf_dir)
    return _fitted(table)[0].predict(table).select("transaction_id", "score", "prediction")


def feature_importance(spark, sf_dir):
    fitted, _ = _fitted(_table(spark, sf_dir))
    return fitted.importance(spark)


def embeddings_lookup(spark, sf_dir):
    t = transactions(spark, sf_dir).select("transaction_id", "user_id", "merchant_id", "device_id")
    return embeddings.fit_embeddings(t).features(t)


def label_noise(spark, sf_dir):
    return stress.label_noise(scored(spark, sf_dir))


def class_imbalance(spark, sf_dir):
    return stress.class_imbalance(scored(spark, sf_dir))


def stress_suite(spark, sf_dir):
    table = _table(spark, sf_dir)
    fitted, test = _fitted(table)
    return stress.run_suite(fitted.score(test), fitted.score)


QUERIES = {
    "model_scores": model_scores, "feature_importance": feature_importance, "embeddings_lookup": embeddings_lookup,
    "label_noise": label_noise, "class_imbalance": class_imbalance, "stress_suite": stress_suite,
}
ORACLE: dict[str, str] = {}
