import numpy as np
import pytest

from riskweave.operators import evaluation as E
from riskweave.operators.ranking import precision_at_k, ranking_quality
from riskweave.operators.scan import HOT_ROWS

PATHS = pytest.mark.parametrize("min_rows", [HOT_ROWS, 20], ids=["plain", "sliced"])


def table(spark, y, p, **extra):
    names = list(extra)
    data = [(i, int(a), float(b), *[extra[n][i] for n in names]) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(data, "transaction_id bigint, label int, score double" + "".join(f", {n} string" for n in names))


def brute(y, p):
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap = 0.0
    for s in np.unique(p)[::-1]:
        ap += y[p == s].sum() / y.sum() * y[p >= s].mean()
    return auc, ap


@PATHS
def test_ranking_with_ties(spark, min_rows):
    rng = np.random.default_rng(0)
    y = (rng.random(300) < 0.3).astype(int)
    p = np.round(np.clip(rng.beta(2, 5, 300) + 0.2 * y, 0, 1), 2)
    got = ranking_quality(table(spark, y, p), [], min_rows=min_rows).first()
    auc, ap = brute(y, p)
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-12) and got["pr_auc"] == pytest.approx(ap, abs=1e-12)


def test_perfect_and_one_class(spark):
    got = E.classification_metrics(table(spark, [0, 0, 0, 1, 1], [0.1, 0.1, 0.1, 0.9, 0.9])).first()
    assert got["roc_auc"] == 1 and got["pr_auc"] == 1 and got["precision"] == 1 and got["recall"] == 1
    one = E.classification_metrics(table(spark, [0, 0], [0.2, 0.7])).first()
    assert one["roc_auc"] is None and one["pr_auc"] is None and one["recall"] == 0 and one["false_positives"] == 1


@PATHS
def test_precision_at_k(spark, min_rows):
    y = [1, 1] + [0] * 8
    p = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05]
    got = {r["k"]: r["precision_at_k"] for r in precision_at_k(table(spark, y, p), k_values=[2, 5, 11], min_rows=min_rows).collect()}
    assert got == {2: 1.0, 5: 0.4}
    tied = {r["k"]: r["precision_at_k"] for r in precision_at_k(table(spark, [0, 1, 1, 0], [0.5] * 4), k_values=[1, 2, 3, 4]).collect()}
    assert tied == {1: 0.0, 2: 0.5, 3: pytest.approx(2 / 3), 4: 0.5}


def test_default_k_of_a_small_table(spark):
    assert {r["k"] for r in precision_at_k(table(spark, [0, 1] * 10, np.linspace(0, 1, 20))).collect()} == {1, 2, 4}


def test_slices(spark):
    y = [0, 1] * 10 + [0] * 9 + [0] * 12
    cats = ["a"] * 20 + ["tiny"] * 9 + ["one"] * 12
    got = {r["slice"]: r for r in E.slice_metrics(table(spark, y, np.linspace(0, 1, 41), c=cats), ["c"]).collect()}
    assert set(got) == {"a", "one"} and got["one"]["roc_auc"] is None and got["a"]["n_samples"] == 20
    nulls = table(spark, [0, 1] * 10, [0.5] * 20, c=[None] * 20)
    assert E.slice_metrics(nulls, ["c"]).count() == 0


def test_bins_on_edges(spark):
    """Curve bins are closed on the right, error bins on the left; a score of 1 is in no error bin."""
    edges = [i * 0.1 for i in range(11)]
    curve = {r["bin"]: r["n"] for r in E.calibration_curve(table(spark, [0] * 11, edges)).collect()}
    assert curve[0] == 2 and sum(curve.values()) == 11 and max(curve) == 9
    err = E.calibration_errors(table(spark, [1, 0], [1.0, 0.0])).first()
    assert err["ece"] == 0.0 and err["mce"] == 0.0
    off = E.calibration_errors(table(spark, [0, 0], [1.0, 0.05])).first()
    assert off["ece"] == pytest.approx(0.025) and off["mce"] == pytest.approx(1.0)


def test_threshold_table(spark):
    rows = {r["threshold"]: r for r in E.threshold_analysis(table(spark, [0, 1, 1], [0.2, 0.5, 0.95])).collect()}
    assert len(rows) == 9 and rows[0.5]["true_positives"] == 2 and rows[0.2]["false_positives"] == 1
    assert rows[0.9]["recall"] == 0.5 and rows[0.9]["predicted_positive_rate"] == pytest.approx(1 / 3)


def test_report_has_all_sections(spark, tmp_path):
    from riskweave.sources.state import save_report

    rng = np.random.default_rng(5)
    y = (rng.random(200) < 0.2).astype(int)
    cats = rng.choice(["x", "y"], 200).tolist()
    report = E.evaluation_report(table(spark, y, rng.random(200), c=cats), slices=["c"])
    assert {"global_metrics", "slice_metrics", "calibration", "threshold_analysis", "precision_at_k", "warnings"} <= set(report.sections())
    messages = [r["message"] for r in report.warnings.collect()]
    assert any("precision" in m for m in messages) and any("calibration" in m for m in messages)
    save_report(report, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "threshold_analysis")).count() == 9


def test_money_with_no_precision(spark):
    m = spark.createDataFrame([(0.0, 0.0, 1000), (0.5, 0.8, 1000)], "precision double, recall double, transactions long")
    out = E.money_value(m, platform_cost=100.0).orderBy("precision").collect()
    assert out[0]["break_even_predictions"] == -1 and out[0]["false_alarm_cost"] == 0
    assert out[1]["fraud_prevented"] == 8000 and out[1]["net_savings"] == 8000 - 80 - 100 and out[1]["roi_percentage"] == 7820.0


def test_gates(spark):
    m = spark.createDataFrame([(0.71, 0.5, None)], "precision double, recall double, pr_auc double")
    assert {r["metric"]: r["passed"] for r in E.metric_gates(m).collect()} == {"precision": True, "recall": False, "pr_auc": False}


def test_bands(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.0,), (99.9,), (100.0,), (10000.0,), (-1.0,), (None,)], "a double")
    assert [r[0] for r in df.select(E.amount_bucket(F.col("a"))).collect()] == ["low", "low", "medium", "very_high", None, None]
