from datetime import datetime, timedelta

import numpy as np
import pytest

from riskweave.operators import alerts as A
from riskweave.operators import drift as D
from riskweave.operators import retrain as R
from riskweave.operators.scan import HOT_ROWS

PATHS = pytest.mark.parametrize("min_rows", [HOT_ROWS, 50], ids=["plain", "sliced"])
NOW = datetime(2024, 5, 1, 12)


def one(spark, values, name="x"):
    return spark.createDataFrame([(name, float(v)) for v in values], "feature string, value double")


def np_psi(ref, cur, n=10):
    eps, bins = 1e-10, np.unique(np.percentile(ref, np.linspace(0, 100, n + 1)))
    if len(bins) < 2:
        return 0.0
    r, c = np.histogram(ref, bins)[0], np.histogram(cur, bins)[0]
    r, c = (r + eps) / (len(ref) + eps * len(r)), (c + eps) / (len(cur) + eps * len(c))
    return float(np.sum((c - r) * np.log(c / r)))


def np_ks(ref, cur):
    every = np.concatenate([ref, cur])
    a = np.searchsorted(np.sort(ref), every, side="right") / len(ref)
    b = np.searchsorted(np.sort(cur), every, side="right") / len(cur)
    return np.max(np.abs(a - b))


def np_kl(ref, cur, n=10):
    bins = np.histogram_bin_edges(np.concatenate([ref, cur]), bins=n)
    r, c = (np.histogram(v, bins=bins, density=True)[0] + 1e-10 for v in (ref, cur))
    r, c = r / r.sum(), c / c.sum()
    return float(np.sum(c * np.log(c / r)))


@PATHS
@pytest.mark.parametrize("shift", [0.0, 0.4, 3.0])
def test_measures_match_numpy(spark, min_rows, shift):
    rng = np.random.default_rng(7)
    ref, cur = rng.normal(0, 1, 400), rng.normal(shift, 1, 300)
    a, b = one(spark, ref), one(spark, cur)
    assert D.psi(a, b, min_rows=min_rows).first()["psi"] == pytest.approx(np_psi(ref, cur), rel=1e-9)
    ks = D.ks(a, b, min_rows).first()
    assert ks["ks_statistic"] == pytest.approx(np_ks(ref, cur), abs=1e-12)
    assert (ks["ks_pvalue"] < 0.05) == (shift > 0)
    assert D.kl(a, b).first()["kl_divergence"] == pytest.approx(np_kl(ref, cur), rel=1e-9)


def test_identical_constant_and_outside(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 500)
    assert D.psi(one(spark, x), one(spark, x)).first()["psi"] < 0.01
    assert D.psi(one(spark, [2.0] * 50), one(spark, x)).first()["psi"] == 0
    assert D.kl(one(spark, [2.0] * 5), one(spark, [2.0] * 5)).first()["kl_divergence"] == 0
    assert D.psi(one(spark, x), one(spark, x + 100)).first()["psi"] == pytest.approx(np_psi(x, x + 100), rel=1e-9)
    same = D.ks(one(spark, x), one(spark, x)).first()
    assert same["ks_statistic"] == 0 and same["ks_pvalue"] == 1


def test_psi_is_never_negative(spark):
    for seed in range(4):
        rng = np.random.default_rng(seed)
        assert D.psi(one(spark, rng.normal(size=100)), one(spark, rng.normal(size=100))).first()["psi"] >= 0


def sides(spark, factor):
    rng = np.random.default_rng(2)
    ref = [(float(v), int(i % 24), i) for i, v in enumerate(rng.lognormal(4, 1, 300))]
    cur = [(float(v) * factor, int(i % 24), i) for i, v in enumerate(rng.lognormal(4, 1, 300))]
    ddl = "amount double, hour int, n bigint"
    return spark.createDataFrame(ref, ddl), spark.createDataFrame(cur, ddl)


def test_feature_drift_severity(spark):
    ref, cur = sides(spark, 10)
    rows = {r["feature"]: r for r in D.detect_drift(ref, cur).collect()}
    assert set(rows) == {"amount", "n"} and rows["amount"]["severity"] == "critical" and not rows["n"]["is_drifted"]
    assert set(D.drift_columns(ref, cur, any_numeric=True)) == {"amount", "hour", "n"}
    assert D.feature_drift(ref, cur.limit(9)).count() == 0
    gate = D.drift_gate(D.feature_drift(ref, cur)).first()
    assert gate["critical_features"] == ["amount"] and not gate["passed"]
    assert D.drifting_share(D.feature_drift(ref, cur)).first()["drifting_features_pct"] == 50.0


def test_alerts_and_log(spark, tmp_path):
    from riskweave.schemas import ALERT
    from riskweave.sources.state import append_alerts, clear_alerts

    ref, cur = sides(spark, 10)
    found = A.drift_alerts(D.feature_drift(ref, cur), NOW)
    row = found.first()
    assert row["name"] == "drift_detected" and row["severity"] == "critical" and row["details"]["feature"] == "amount"
    late = A.latency_alerts(spark.createDataFrame([(80.0,), (20.0,)], "latency_p99_ms double"), NOW)
    assert late.first()["message"] == "Latency degraded: p99=80.0ms (target: 50.0ms)" and late.count() == 1
    every = found.unionByName(late)
    assert A.at_least(every, "critical").count() == 1 and A.recent_alerts(every, 1).count() == 1
    path = str(tmp_path / "alerts")
    append_alerts(every, path)
    append_alerts(every, path)
    assert spark.read.schema(ALERT).json(path).count() == 4
    clear_alerts(spark, ALERT, path)
    assert spark.read.schema(ALERT).json(path).count() == 0


def test_performance_and_drift_triggers(spark):
    m = spark.createDataFrame([(0.4, 0.8, 0.6)], "precision double, recall double, pr_auc double")
    row = R.performance_trigger(m, NOW).first()
    assert row["threshold_violated"] == "precision=0.400 < 0.5; pr_auc=0.600 < 0.75" and row["trigger_id"] == "perf_20240501_120000"
    fine = spark.createDataFrame([(0.6, 0.8, 0.0)], "precision double, recall double, pr_auc double")
    assert R.performance_trigger(fine, NOW).count() == 0
    recent = R.RetrainState(last_retrain=NOW - timedelta(hours=23))
    assert R.performance_trigger(m, NOW, recent).count() == 0
    share = spark.createDataFrame([(0.05, 12.5)], "psi double, drifting_features_pct double")
    assert R.drift_trigger(share, NOW).first()["threshold_violated"] == "feature_drift=12.5% > 10.0%"


def test_rate_schedule_and_log(spark, tmp_path):
    from riskweave.sources.state import append_triggers, load_retrain_state, load_triggers, save_retrain_state

    rate = spark.createDataFrame([(0.03,)], "fraud_rate double")
    assert R.fraud_rate_trigger(rate, NOW).count() == 0
    state = R.fraud_rate_state(rate, R.RetrainState())
    assert state.baseline_fraud_rate == 0.03
    spike = spark.createDataFrame([(0.06,)], "fraud_rate double")
    assert R.fraud_rate_trigger(spike, NOW, state).first()["threshold_violated"] == "fraud_rate_change=100.0% > 20.0%"
    assert R.schedule_trigger(spark, NOW, R.RetrainState()).count() == 0
    old = R.RetrainState(last_retrain=NOW - timedelta(days=30))
    sched = R.schedule_trigger(spark, NOW, old)
    assert sched.first()["threshold_violated"] == "days_since_retrain=30 > 30"
    path = str(tmp_path / "retrain")
    assert load_triggers(spark, path).count() == 0
    append_triggers(sched, path)
    append_triggers(R.outcome(sched, NOW + timedelta(hours=1), "completed", "v2"), path)
    log = load_triggers(spark, path)
    assert R.trigger_status(log).first()["status"] == "completed" and R.trigger_counts(log).first()["n"] == 1
    after = R.state_from_log(log)
    assert after.model_version == "v2" and after.last_retrain == NOW + timedelta(hours=1)
    save_retrain_state(spark, after, path)
    assert load_retrain_state(spark, path) == after
    assert R.manual_trigger(spark, NOW, "why").first()["notes"] == "why"


def exact_by_enumeration(ref, cur):
    """Share of all orders of two samples without ties that lie as far apart as these."""
    from itertools import combinations

    m, n = len(ref), len(cur)
    steps = round(np_ks(np.array(ref, float), np.array(cur, float)) * m * n)
    hit = total = 0
    for chosen in combinations(range(m + n), m):
        i = far = 0
        for k in range(m + n):
            i += k in chosen
            far = max(far, abs(i * n - (k + 1 - i) * m))
        hit, total = hit + (far >= steps), total + 1
    return hit / total


@pytest.mark.parametrize(
    "ref,cur",
    [([1, 2, 3, 4, 5, 6], [4.5, 5.5, 6.5, 7.5, 8.5, 9.5]), ([1, 2, 3], [1.5, 2.5, 9, 10, 11]), ([1, 2, 2, 3], [2, 2, 3, 3, 4]), ([5], [1, 2, 3, 4]), ([1, 2], [1, 2])],
)
def test_small_samples_have_exact_p_values(spark, ref, cur):
    got = D.ks(one(spark, ref), one(spark, cur)).first()
    assert got["ks_pvalue"] == pytest.approx(exact_by_enumeration(ref, cur), abs=1e-12)


def test_known_exact_p_values_and_their_severity(spark):
    """Two samples of six whose distance is two thirds: 132 of the 924 orders lie as far apart, 0.142857."""
    got = D.ks(one(spark, range(1, 7)), one(spark, [4.5, 5.5, 6.5, 7.5, 8.5, 9.5])).first()
    assert got["ks_statistic"] == pytest.approx(2 / 3) and got["ks_pvalue"] == pytest.approx(132 / 924)
    # completely apart: two of all orders; also for samples of unequal size and very small chances
    got = D.ks(one(spark, range(300)), one(spark, range(1000, 1200))).first()
    assert 0 < got["ks_pvalue"] < 1e-100


def test_exact_and_limiting_values_meet(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a, b = one(spark, rng.normal(0, 1, 3000)), one(spark, rng.normal(0.04, 1, 2500))
    exact = D.ks(a, b).first()["ks_pvalue"]
    monkeypatch.setattr(D, "EXACT_KS_ROWS", 100)
    assert D.ks(a, b).first()["ks_pvalue"] == pytest.approx(exact, abs=0.02)


def test_severity_follows_the_exact_value(spark):
    ref, cur = [float(i) for i in range(10)], [5.5 + i for i in range(10)]
    exact = exact_by_enumeration(ref, cur)
    a = spark.createDataFrame([(x,) for x in ref], "x double")
    b = spark.createDataFrame([(x,) for x in cur], "x double")
    row = D.feature_drift(a, b, ["x"], psi_warning=1e9, psi_critical=1e9).first()
    assert row["p_value"] == pytest.approx(exact, abs=1e-12)
    for alpha, severity in ((exact * 0.999, "none"), (exact * 1.001, "warning")):
        assert D.feature_drift(a, b, ["x"], psi_warning=1e9, psi_critical=1e9, ks_alpha=alpha).first()["severity"] == severity
