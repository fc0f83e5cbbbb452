"""Boosted-tree scoring on JVM classes: fit, score, importance, splits, persistence."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime

from pyspark import SparkContext, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import micros
from ..session import shared_root
from .boosting import MOST_DEPTH, boosted_rounds, concurrent_tasks, spark_model
from .evaluation import classification_metrics
from .features import model_inputs
from .sampling import chosen_flag
from .scan import HOT_ROWS, exact_quantiles

# fixed values: default training parameters
DEFAULT_PARAMS = {
    "trees": 200, "depth": 6, "rate": 0.1, "min_rows_per_leaf": 5, "row_share": 0.8,
    "column_share": 0.8, "positive_weight": 10.0, "seed": 42, "stop_rounds": 20,
}


# values of a class label at most
MOST_CLASSES = 1_000


@dataclass
class ScoreModel:
    """A fitted model with the names of its inputs."""

    model: GBTClassificationModel
    features: list[str]
    params: dict
    threshold: float = 0.5
    version: str = "v1"
    metrics: dict[str, float] = field(default_factory=dict)
    trained_at: str | None = None

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the probability of fraud; columns the table lacks count as 0."""
        return score_with(self.model, self.features, df)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``score`` and the thresholded ``prediction``."""
        return self.score(df).withColumn("prediction", (F.col("score") >= self.threshold).cast("int"))

    def importance(self, spark: SparkSession) -> DataFrame:
        """(feature, importance), one row per input column."""
        weights = self.model.featureImportances.toArray().tolist()
        return spark.createDataFrame(list(zip(self.features, weights)), "feature string, importance double").orderBy(
            F.desc("importance"), "feature"
        )

    def save(self, path: str, spark: SparkSession) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        meta = {"features": self.features, "params": self.params, "threshold": self.threshold,
                "version": self.version, "metrics": self.metrics, "trained_at": self.trained_at}
        row = spark.createDataFrame([(json.dumps(meta),)], "content string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "ScoreModel":
        meta = json.loads(spark.read.parquet(f"{path}/metadata").first()["content"])
        return cls(GBTClassificationModel.load(f"{path}/model"), **meta)


def _inputs(df: DataFrame, features: Sequence[str]) -> list[Column]:
    """The features as doubles named by their place; null or missing counts as 0."""
    return [
        (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(f"_f{i}")
        for i, c in enumerate(features)
    ]


def _assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    staged = df.select("*", *_inputs(df, features))
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_x").transform(staged).drop(
        *[f"_f{i}" for i in range(len(features))]
    )


def score_with(model: GBTClassificationModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    out = model.transform(_assemble(df, features))
    return out.select(*df.columns, vector_to_array("probability")[1].alias("score"))


def best_round(losses: Sequence[float], stop_rounds: int) -> int:
    """Number of rounds with the smallest loss seen before ``stop_rounds`` rounds in a row brought no gain."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= stop_rounds:
            break
    return best + 1


def first_trees(model: GBTClassificationModel, count: int) -> GBTClassificationModel:
    """The ensemble of the first ``count`` trees, with the same parameters."""
    weights = model.treeWeights
    if count >= len(weights):
        return model
    gateway, fitted = model._java_obj, model._java_obj.trees()
    sc = SparkContext._active_spark_context
    trees = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, count)
    kept = sc._gateway.new_array(sc._gateway.jvm.double, count)
    for i in range(count):
        trees[i], kept[i] = fitted[i], float(weights[i])
    made = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(gateway.uid(), trees, kept, gateway.numFeatures(), gateway.numClasses())
    short = GBTClassificationModel(made)
    model._copyValues(short)
    short._transfer_params_to_java()
    return short


#: Rows of a training partition: tables of fewer stay in one; beyond ``EVEN_PARTITIONS`` of them partitions grow up to ``MOST_ROWS``.
ROWS_PER_PARTITION, EVEN_PARTITIONS, MOST_ROWS = 40_000, 12, 1_200_000


def fit_partitions(rows: int) -> int:
    """Partitions of a fit. They follow from the rows alone: each draws its own bag of rows. Every tree runs a job per
    level over all of them, so there are only as many as keep the cores busy and a partition in memory."""
    return max(1, min(-(-rows // ROWS_PER_PARTITION), EVEN_PARTITIONS), -(-rows // MOST_ROWS))


@contextmanager
def _held(rows: DataFrame) -> Iterator[DataFrame]:
    """The rows dealt evenly over ``fit_partitions`` and kept on disk while in use, however few files they come from;
    memory is left to the learner's own binned copy."""
    parts = fit_partitions(rows.count())
    held = (rows.repartition(parts) if parts > 1 else rows.coalesce(1)).persist(StorageLevel.DISK_ONLY)
    try:
        yield held
    finally:
        held.unpersist()


def _best_ensemble(learner: GBTClassifier, rows: DataFrame, unseen: DataFrame, trees: int, stop_rounds: int) -> GBTClassificationModel:
    """The ensemble of ``trees`` rounds cut at the best round on ``unseen`` rows.

    Half the rounds come first. If the search for the best round stops within them, later trees could not count, and
    they are not fitted; otherwise all rounds are fitted.
    """
    for count in sorted({max(1, trees // 2), trees}):
        fitted = learner.copy({learner.maxIter: count}).fit(rows)
        best = best_round(fitted.evaluateEachIteration(unseen), stop_rounds)
        if count - best >= stop_rounds:
            break
    return first_trees(fitted, best)


def fit_model(
    train: DataFrame, label: str = "label", *, features: Sequence[str] | None = None, valid: DataFrame | None = None,
    weight: str | None = None, params: dict | None = None, threshold: float = 0.5, version: str = "v1",
    with_metrics: bool = True, trained_at: datetime | None = None,
) -> ScoreModel:
    """Fit boosted trees. With ``valid`` the number of trees is the best on it before ``stop_rounds`` trees brought
    no gain (early stop); the fitted ensemble is cut there, as later trees do not change earlier ones (``_best_ensemble``).

    Tables of one training partition go to Spark's learner: the assembled table is held for the fit. Larger ones are
    fitted by ``boosting.boosted_rounds``, the same rounds on packed rows, ten trees a job, until the best is settled.
    Rows walk down the few levels of a tree again at each level, which costs less than to store their nodes; the sums of
    their trees are written to the shared folder every ten trees, so a lost executor costs ten at most. Trees deeper than
    ``MOST_DEPTH`` are left to Spark's learner whatever the table.
    """
    p = {**DEFAULT_PARAMS, **(params or {})}
    features = list(features or [c for c in model_inputs(train) if c not in (label, weight)])
    own = F.col(weight).cast("double") if weight else F.lit(1.0)
    keep = [*features, label, *([weight] if weight else [])]

    weighed = (own * F.when(F.col(label) == 1, float(p["positive_weight"])).otherwise(1.0)).alias("_w")
    marked = F.col(label).cast("double").alias("_y")

    def staged(rows: DataFrame) -> DataFrame:
        return _assemble(rows.select(*keep).select("*", weighed), features).select("_x", marked, "_w")

    def plain(rows: DataFrame) -> DataFrame:
        known = rows.select(*keep)
        return known.select(*_inputs(known, features), marked, weighed)

    learner = GBTClassifier(
        featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=p["trees"], maxDepth=p["depth"], stepSize=p["rate"],
        minInstancesPerNode=p["min_rows_per_leaf"], subsamplingRate=p["row_share"],
        featureSubsetStrategy=str(p["column_share"]), seed=p["seed"], cacheNodeIds=False, checkpointInterval=10,
    )
    shared_root(train.sparkSession)
    total = train.count()
    parts = min(-(-total // ROWS_PER_PARTITION), concurrent_tasks(train.sparkSession))
    if fit_partitions(total) > 1 and 1 <= p["depth"] <= MOST_DEPTH:
        trees, cuts, losses = boosted_rounds(
            plain(train), None if valid is None else plain(valid), len(features), parts, p, learner.getMaxBins(),
            lambda seen: len(seen) - best_round(seen, p["stop_rounds"]) >= p["stop_rounds"],
        )
        kept = trees if valid is None else trees[: best_round(losses, p["stop_rounds"])]
        fitted = spark_model(train.sparkSession, learner, kept, cuts, p["rate"])
    else:
        with _held(staged(train)) as rows:
            if valid is None:
                fitted = learner.fit(rows)
            else:
                with _held(staged(valid)) as unseen:
                    fitted = _best_ensemble(learner, rows, unseen, p["trees"], p["stop_rounds"])
    out = ScoreModel(fitted, features, p, threshold, version, {}, trained_at.isoformat() if trained_at else None)
    if with_metrics:
        row = classification_metrics(out.score(train), label=label, threshold=threshold).first()
        out.metrics = {k: row[k] for k in ("precision", "recall", "f1", "roc_auc", "pr_auc", "brier_score")}
    return out


def time_split(df: DataFrame, ts: str = "timestamp", share: float = 0.8, min_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(train, test) around the exact quantile of time; the quantile itself is in train."""
    at = split_point(df, ts, share, min_rows)
    return df.filter(micros(ts) <= F.lit(at)), df.filter(micros(ts) > F.lit(at))


def split_point(df: DataFrame, ts: str = "timestamp", share: float = 0.8, min_rows: int = HOT_ROWS) -> float:
    q = exact_quantiles(df.select(micros(ts).alias("_us")), [], "_us", [share], min_rows=min_rows).first()
    return float("nan") if q is None else q["q"][0]


def stratified_split(
    df: DataFrame, label: str = "label", ident: str = "transaction_id", test_share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, test) with the same share of every class in test; repeatable by id and seed."""
    classes = df.groupBy(label).count().limit(MOST_CLASSES + 1).collect()
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"{label!r} has more than {MOST_CLASSES} values and is no class label")
    counts = {r[label]: r["count"] for r in classes}
    test = F.lit(False)
    for value, n in counts.items():
        cond = F.col(label) == F.lit(value)
        test = test | (cond & chosen_flag(df.filter(cond), ident, int(round(n * test_share)), n, f"split-{seed}"))
    return df.filter(~test), df.filter(test)


def train_model(df: DataFrame, label: str = "label", ident: str = "transaction_id", test_share: float = 0.2, **kw) -> ScoreModel:
    """Stratified split, then a fit that is validated on the held-out part."""
    train, test = stratified_split(df, label, ident, test_share)
    features = kw.pop("features", None) or [c for c in model_inputs(df) if c not in (label, ident)]
    return fit_model(train, label, features=features, valid=test, **kw)
