from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskweave.operators import features, labels, quality, records, rules, scoring, snapshots
from riskweave.operators.entities import with_list_flags
from riskweave.schemas import LABEL_FIELDS, RECORDS, TRANSACTION_FIELDS, USER_FIELDS, record_ddl
from riskweave.sources import messages, state, tables

T0 = datetime(2024, 1, 1, 12)
PRED = "transaction_id string, fraud_probability double, decision string, model_version string, prediction_timestamp timestamp, amount double"
LAB = "transaction_id string, is_fraud int, label_timestamp timestamp"


# ---- contracts and records -------------------------------------------------------------
def failed(df, contract):
    return {(r["column"], r["check"]) for r in contract.check(df).filter("not passed").collect()}


def test_constraints(spark):
    df = spark.createDataFrame([(0.25, 7, "x"), (8.5, None, "y"), (-0.75, 7, "?")], "v double, n bigint, s string")
    contract = quality.DataContract(
        "c", required_columns=["v", "gone"], column_types={"v": float, "n": int, "s": str},
        constraints={"v": [quality.Range(-0.5, 8)], "n": [quality.NotNull(), quality.Unique()], "s": [quality.InSet(["x", "y"])]},
    )
    assert failed(df, contract) == {("gone", "required"), ("v", "within_-0.5_to_8"), ("n", "filled"), ("n", "distinct"), ("s", "known_value")}
    assert failed(df.filter("v < 0"), quality.DataContract("c", constraints={"v": [quality.Range(None, 8)]})) == set()
    with pytest.raises(ValueError):
        quality.require_valid(df, contract)
    result = quality.require_valid(df, contract, fail_on_error=False)
    assert not result.valid and len(result.errors) == 5 and result.stats["rows"] == 3


def test_empty_and_all_null(spark):
    contract = quality.DataContract("c", constraints={"v": [quality.NotNull(), quality.Range(0, 1)]})
    empty = spark.createDataFrame([], "v double")
    assert failed(empty, contract) == {("v", "filled")}
    nulls = spark.createDataFrame([(None,), (None,)], "v double")
    assert failed(nulls, contract) == {("v", "filled")}
    soft = quality.DataContract("c", statistics=[quality.null_rate(0.05)])
    res = soft.validate(nulls)
    assert res.valid and len(res.warnings) == 1 and res.stats["v_null_rate"] == 1.0


def test_custom_constraint(spark):
    class Positive(quality.Constraint):
        name, message = "positive", "must be positive"

        def measures(self, col):
            return [F.min(col)]

        def passed(self, parts):
            return parts[0] > 0

    df = spark.createDataFrame([(1.0,), (0.0,)], "v double")
    assert failed(df, quality.DataContract("c", constraints={"v": [Positive()]})) == {("v", "positive")}


def test_a_check_that_cannot_run_leaves_the_others(spark):
    df = spark.createDataFrame([("x", 7.0), ("y", -2.0)], "v string, w double")
    cast_all = quality.ColumnStatistic("x", lambda c: F.sum(c.cast("int")), high=1)
    res = quality.DataContract("c", constraints={"w": [quality.Range(0, 5)]}, statistics=[cast_all]).validate(df)
    assert not res.valid and len(res.errors) == 1 and res.errors[0].startswith("w ")
    assert any("could not evaluate 'x'" in m for m in res.warnings)

    class Broken(quality.Constraint):
        name, message = "broken", "never"

        def measures(self, col):
            raise ValueError("no measure")

    res = quality.DataContract("c", constraints={"w": [Broken()], "v": [quality.NotNull()]}).validate(df)
    assert not res.valid and len(res.errors) == 1 and "broken" in res.errors[0]
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND"):
        gone = spark.read.schema("w double").parquet("/nowhere/at/all")
        quality.DataContract("c", constraints={"w": [quality.NotNull()]}).validate(gone)


def test_rules_that_do_not_fit_the_table_are_skipped(spark):
    df = spark.createDataFrame([(1, 20.0, "payment", 0.1)], "id int, amount double, transaction_type string, score double")
    bad = rules.Rule("absent", "no_such_column > 3", "block", rules.CRITICAL)
    worse = rules.Rule("no_sql", "amount >>> (", "block", rules.CRITICAL)
    good = rules.Rule("large", "amount > 10", "block", rules.CRITICAL)
    chosen = rules.RuleSet((bad, worse, good))
    assert rules.unresolved(df, chosen) == ["absent", "no_sql"]
    with pytest.warns(UserWarning):
        assert rules.check_before_score(df, chosen).first()["rule_name"] == "large"
        assert rules.triggered_rules(df, chosen).first()["triggered_rules"] == ["large"]


def test_records(spark):
    df = spark.createDataFrame([("t1", T0, 5.0, "m", "RETAIL", "u", "Watch"), ("t2", T0, 2e7, "m", None, "u", None)],
                               "transaction_id string, timestamp timestamp, amount double, merchant_id string, merchant_category string, user_id string, device_type string")
    good, bad = records.split_records(df, TRANSACTION_FIELDS, "transaction")
    g, b = good.first(), bad.first()
    assert g["merchant_category"] == "retail" and g["device_type"] == "unknown" and g["currency"] == "NGN" and g["transaction_type"] == "payment"
    assert b["failed_fields"] == ["amount", "merchant_category"] and b["device_type"] is None
    lab = spark.createDataFrame([("t", 1, T0)], LAB)
    assert records.split_records(lab, LABEL_FIELDS, "label")[0].first()["label_source"] == "unknown"
    users = spark.createDataFrame([("u", -1, "gold"), ("v", None, None)], "user_id string, account_age_days bigint, verification_level string")
    rows = {r["user_id"]: r for r in records.check_records(users, USER_FIELDS, "user").collect()}
    assert rows["u"]["failed_fields"] == ["account_age_days", "verification_level"] and rows["v"]["account_age_days"] == 0
    assert all(spark.createDataFrame([], record_ddl(f)).columns for f in RECORDS.values())


# ---- features --------------------------------------------------------------------------
def test_feature_edges(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", T0, 0.0, "other", None), ("b", T0, 10.0, "retail", "mobile"), ("c", T0, -4.0, None, "mobile"), ("d", None, None, "retail", "new")],
        "transaction_id string, timestamp timestamp, amount double, merchant_category string, device_type string",
    )
    with pytest.raises(RuntimeError):
        features.RiskFeatures().transform(df)
    model = features.RiskFeatures().fit(df.filter("transaction_id != 'd'"))
    out = {r["transaction_id"]: r for r in model.transform(df).collect()}
    assert out["a"]["merchant_category_other"] == 1 and "merchant_category_retail" in model.feature_names
    assert out["c"]["merchant_category_other"] == 1 and out["c"]["amount"] == 0 and out["c"]["amount_log"] == 0
    assert out["d"]["device_type_other"] == 1 and out["d"]["amount_zscore"] == 0 and out["d"]["hour"] == 0
    path = str(tmp_path / "fit")
    model.save(path, spark)
    again = features.RiskFeaturesModel.load(path, spark)
    assert again.transform(df).collect() == model.transform(df).collect() and again.feature_names == model.feature_names
    same = spark.createDataFrame([(5.0,), (5.0,)], "amount double")
    assert features.fit_amount(same)["std"] == 1.0


# ---- rules and decisions ---------------------------------------------------------------
CTX = ("transaction_id string, transaction_type string, amount double, is_vpn boolean, is_emulator boolean, is_new_device boolean, "
       "account_age_days bigint, previous_fraud_flags bigint, txn_count_1h bigint, score double")


def decide(spark, rows, ruleset=None):
    df = spark.createDataFrame(rows, CTX)
    return {r["transaction_id"]: r for r in rules.decide(df, ruleset or rules.engine_rules()).collect()}


def test_thresholds_by_type(spark):
    calm = (False, False, False, 365, 0, 1)
    got = decide(spark, [
        ("p1", "payment", 10.0, *calm, 0.69), ("p2", "payment", 10.0, *calm, 0.7), ("p3", "payment", 10.0, *calm, 0.85), ("p4", "payment", 10.0, *calm, 0.9),
        ("t1", "transfer", 10.0, *calm, 0.6), ("t2", "transfer", 10.0, *calm, 0.85), ("x", "refund", 10.0, *calm, 0.85), ("v", "payment", 10.0, False, False, False, 365, 0, 30, 0.1),
    ])
    assert [got[k]["action"] for k in ("p1", "p2", "p3", "p4", "t1", "t2", "x")] == ["allow", "challenge", "challenge", "block", "challenge", "block", "challenge"]
    assert got["p2"]["challenge_type"] == "otp" and got["p3"]["challenge_type"] == "selfie_verification"
    assert got["v"]["action"] == "allow"  # a block rule below critical is evaluated by neither step of this set
    cfg = decide(spark, [("r", "refund", 10.0, *calm, 0.35)], rules.special_rules())
    assert cfg["r"]["action"] == "challenge"


def test_rule_order_and_custom_rules(spark):
    row = ("a", "payment", 60000.0, True, True, True, 1, 0, 1, 0.99)
    assert decide(spark, [row])["a"]["rule_name"] == "vpn_high_amount"
    extra = rules.engine_rules().add(rules.Rule("vip", "amount > 50000", "challenge", rules.CRITICAL + 1, "manual_review", "vip"))
    df = spark.createDataFrame([row], CTX)
    assert "vip" in rules.triggered_rules(df, extra).first()["triggered_rules"]
    conf = rules.rules_from_config([{"name": "n", "condition": "amount > 1", "action": "block", "reason": "r"}])
    first = rules.check_before_score(df, rules.RuleSet(conf)).first()
    assert first["triggered"] and first["reason"] == "r"
    bare = spark.createDataFrame([("a",)], "transaction_id string")
    assert rules.triggered_rules(bare, rules.engine_rules()).first()["triggered_rules"] == []


def test_check_splits_before_scoring(spark):
    rows = [("stop", "payment", 1.0, False, False, False, 365, 2, 1, 0.0), ("go", "payment", 1.0, True, False, True, 5, 0, 2, 0.0)]
    df = spark.createDataFrame(rows, CTX).drop("score")
    seen = []

    def scorer(rest):
        seen.append([r["transaction_id"] for r in rest.collect()])
        return rest.withColumn("score", F.lit(0.123456))

    out = {r["transaction_id"]: r for r in scoring.check_transactions(df, scorer).collect()}
    assert seen == [["go"]]
    assert out["stop"]["risk_score"] == 1.0 and out["stop"]["risk_tier"] == "critical" and out["stop"]["risk_reasons"] == []
    assert out["stop"]["action_reason"] == "Rule triggered: repeat_fraudster"
    assert out["go"]["risk_score"] == 0.1235 and [r["feature"] for r in out["go"]["risk_reasons"]] == ["is_vpn", "is_new_device", "account_age_days"]
    none = {r["transaction_id"]: r for r in scoring.check_transactions(df, None).collect()}
    assert none["go"]["action"] == "challenge" and none["go"]["risk_reasons"][0]["feature"] == "system"


def test_contribution_explanation(spark):
    pushes = {"zz": -0.4, "is_emulator": 0.3, "amount_log": 0.02, "txn_count_24h": -0.11, "account_age_days": 0.22, "yy": 0.05}
    values = {"zz": 2.0, "is_emulator": 1.0, "amount_log": 3.5, "txn_count_24h": 8.0, "account_age_days": 12.0, "yy": 1.0}
    df = spark.createDataFrame([(1, pushes, values), (2, None, {"is_vpn": 1.0}), (3, {}, {})], "id int, contributions map<string,double>, values map<string,double>")
    got = {r["id"]: r["risk_reasons"] for r in scoring.explain_contributions(df).collect()}
    ranked = sorted(pushes, key=lambda k: -abs(pushes[k]))[:5]
    assert [r["feature"] for r in got[1]] == ranked
    assert "12 days" in {r["feature"]: r["description"] for r in got[1]}["account_age_days"]
    assert [r["feature"] for r in got[2]] == ["is_vpn"] and got[3] == []


def test_lists(spark):
    df = spark.createDataFrame([("u1", "d1", True), ("u2", None, None)], "user_id string, device_id string, is_blocked boolean")
    out = {r["user_id"]: r for r in with_list_flags(df, blocked_devices=spark.createDataFrame([("d1",), ("d1",)], "d string")).collect()}
    assert out["u1"]["user_is_blocked"] and out["u1"]["device_is_blocked"] and not out["u2"]["user_is_blocked"] and not out["u2"]["device_is_blocked"]


# ---- labels ----------------------------------------------------------------------------
def test_label_before_prediction_and_duplicates(spark):
    p = spark.createDataFrame([("a", .9, "block", "v", T0, 5.0), ("a", .1, "allow", "v", T0 + timedelta(hours=1), 5.0), ("b", .5, "review", "v", T0, 7.0)], PRED)
    q = spark.createDataFrame([("a", 1, T0 - timedelta(hours=1)), ("a", 0, T0 + timedelta(days=2)), ("zz", 1, T0)], LAB)
    j = labels.join_labels(p, q)
    assert j.count() == 5 and j.agg(F.min("label_delay_days")).first()[0] == -1
    assert j.filter("transaction_id = 'b'").first()["label_too_late"] is False
    rec = labels.reconcile(p, q).collect()
    assert len(rec) == 1 and rec[0]["actual_fraud"] and not rec[0]["predicted_fraud"] and not rec[0]["correct"]
    stats = labels.reconcile_stats(p, q).first()
    assert (stats["pending_predictions"], stats["labels_received"], stats["labels_matched"]) == (1, 3, 1)
    assert [r["transaction_id"] for r in labels.pending(p, q).collect()] == ["b"]
    assert [r["transaction_id"] for r in labels.unmatched_labels(p, q).collect()] == ["zz"]
    assert labels.join_labels(p, q.limit(0)).count() == 0 and labels.join_labels(p.limit(0), q).count() == 0
    assert labels.expire_pending(p, T0 + timedelta(days=120, minutes=1)).count() == 1


def test_single_class_performance(spark):
    p = spark.createDataFrame([("a", .9, "block", "v", T0, 5.0)], PRED)
    q = spark.createDataFrame([("a", 1, T0 + timedelta(days=1))], LAB)
    row = labels.performance(labels.reconcile(p, q)).first()
    assert row["roc_auc"] is None and row["recall"] == 1 and row["avg_label_delay_days"] == 1.0


# ---- snapshots -------------------------------------------------------------------------
def test_lookups_see_no_later_snapshot(spark):
    ddl = "entity_type string, entity_id string, features map<string,double>, timestamp timestamp, ttl_seconds bigint"
    day = timedelta(days=1)
    s = spark.createDataFrame([("user", "a", {"x": 1.0}, T0, 3600), ("user", "a", {"x": 5.0}, T0 + 4 * day, 3600)], ddl)
    times = [T0 - timedelta(seconds=1), T0, T0 + timedelta(minutes=30), T0 + 2 * day, T0 + 4 * day]
    ask = spark.createDataFrame([("user", "a", t) for t in times], "entity_type string, entity_id string, as_of timestamp")
    for min_rows in (1_000_000, 2):
        got = {r["as_of"]: (r["features"] or {}).get("x") for r in snapshots.snapshot_lookup(ask, s, min_rows=min_rows).collect()}
        assert [got[t] for t in times] == [None, 1.0, 1.0, None, 5.0]
    again = snapshots.upsert(s, spark.createDataFrame([("user", "a", {"x": 0.0}, T0 + 4 * day, 1)], ddl))
    assert again.first()["features"] == {"x": 0.0}


def test_snapshot_expiry_is_inclusive(spark):
    ddl = "entity_type string, entity_id string, features map<string,double>, timestamp timestamp, ttl_seconds bigint"
    s = spark.createDataFrame([("user", "a", {"x": 1.0}, T0, 60), ("user", "a", {"x": 2.0}, T0 + timedelta(seconds=5), 60), ("user", "b", {"x": 3.0}, T0, 60)], ddl)
    ask = spark.createDataFrame([("user", "a", T0 + timedelta(seconds=65)), ("user", "b", T0 + timedelta(seconds=61)), ("user", "c", T0)],
                                "entity_type string, entity_id string, as_of timestamp")
    got = {r["entity_id"]: r for r in snapshots.snapshot_lookup(ask, s).collect()}
    assert got["a"]["features"] == {"x": 2.0} and not got["b"]["hit"] and got["c"]["features"] is None
    assert snapshots.hit_statistics(snapshots.snapshot_lookup(ask, s)).first()["hit_rate"] == pytest.approx(1 / 3)
    new = spark.createDataFrame([("user", "b", {"x": 9.0}, T0 + timedelta(hours=1))], ddl.replace(", ttl_seconds bigint", ""))
    merged = snapshots.upsert(s, new)
    assert merged.count() == 2 and merged.filter("entity_id = 'b'").first()["ttl_seconds"] == 3600
    assert snapshots.delete(merged, ask.select("entity_type", "entity_id").filter("entity_id = 'a'")).count() == 1
    assert snapshots.store_size(s).first()["size"] == 2 and snapshots.evict_expired(s, T0 + timedelta(seconds=62)).count() == 1


# ---- sources and state -----------------------------------------------------------------
def test_loaders(spark, tmp_path):
    root = str(tmp_path)
    assert tables.load_transactions(spark, root).count() == 0 and tables.load_predictions(spark, root).columns[0] == "transaction_id"
    cols = "transaction_id string, timestamp timestamp, amount double, merchant_id string, merchant_category string, user_id string"
    a = spark.createDataFrame([("1", T0, 5.0, "m", "food", "u"), ("2", T0 + timedelta(days=1), 5.0, "m", "food", "u")], cols)
    b = a.limit(1).withColumn("transaction_id", F.lit("3")).withColumn("channel", F.lit("web"))
    a.write.csv(f"{root}/raw/transactions_1.csv", header=True)
    assert tables.load_transactions(spark, root, validate=False).count() == 2
    a.write.parquet(f"{root}/raw/transactions_1.parquet")
    b.write.parquet(f"{root}/raw/transactions_2.parquet")
    every = tables.load_transactions(spark, root)
    assert every.count() == 3 and "channel" in every.columns
    part = tables.load_transactions(spark, root, start_date=T0, end_date=T0 + timedelta(days=1))
    assert part.count() == 2
    assert "GreaterThanOrEqual(timestamp" in part._jdf.queryExecution().executedPlan().toString()
    a.withColumn("amount", F.lit(-1.0)).write.mode("overwrite").parquet(f"{root}/raw/transactions_1.parquet")
    with pytest.raises(ValueError):
        tables.load_transactions(spark, root)


def test_messages(spark):
    ok = '{"transaction_id":"1","user_id":"u","merchant_id":"m","merchant_category":"c","amount":1.5,"device_id":"d","device_type":"x","location_country":"NG","timestamp":"2024-01-01T10:00:00"}'
    raw = spark.createDataFrame([(ok,), ("{broken",), ('{"transaction_id":"2"}',)], "value string")
    good = messages.good_events(raw).collect()
    assert len(good) == 1 and good[0]["metadata"] == {} and good[0]["timestamp"] == datetime(2024, 1, 1, 10)
    assert messages.dead_letters(raw).count() == 2
    snap = spark.createDataFrame([("u", "user", {"a": 1.0}, T0, 60)], "entity_id string, entity_type string, features map<string,double>, timestamp timestamp, ttl_seconds bigint")
    back = messages.snapshots_from_messages(messages.to_messages(snap, "entity_id"))
    assert back.collect() == snap.collect()
    pred = spark.createDataFrame([("1", 0.5, "allow", "low", ["a"], "v1", 1.0, T0)],
                                 "transaction_id string, fraud_probability double, decision string, risk_level string, triggered_rules array<string>, model_version string, latency_ms double, timestamp timestamp")
    assert messages.predictions_from_messages(messages.to_messages(pred)).collect() == pred.collect()


def test_versioned_state(spark, tmp_path):
    path = str(tmp_path / "rec")
    assert state.load_reconciler(spark, path) == (None, None)
    p = spark.createDataFrame([("a", {"x": 1.0})], "transaction_id string, features_snapshot map<string,double>")
    state.save_reconciler(path, p, p)
    first = state.load_reconciler(spark, path)[0]
    state.save_reconciler(path, first.unionByName(p), p)
    assert state.load_reconciler(spark, path)[0].count() == 2 and first.count() == 1


def test_a_condition_that_fails_on_a_row_is_skipped_there(spark):
    df = spark.createDataFrame(
        [("a", "12", 1.0), ("b", "many", 1.0), ("c", None, 0.0), ("d", "3", 0.0)], "transaction_id string, note string, amount double"
    )
    cast = rules.Rule("bad_cast", "CAST(note AS INT) > 5", "block", rules.CRITICAL, None, "cast")
    ratio = rules.Rule("ratio", "10 / amount > 5", "block", rules.CRITICAL, None, "ratio")
    odd = rules.Rule("no_column", "nothing > 1", "block", rules.CRITICAL)
    found = rules.RuleSet((cast, ratio, odd))
    with pytest.warns(UserWarning, match="no_column"):
        got = {r["transaction_id"]: r["rule_name"] for r in rules.check_before_score(df, found).collect()}
    assert got == {"a": "bad_cast", "b": "ratio", "c": None, "d": None}
    with pytest.warns(UserWarning):
        fired = {r["transaction_id"]: r["triggered_rules"] for r in rules.triggered_rules(df, found).collect()}
    assert fired == {"a": ["bad_cast", "ratio"], "b": ["ratio"], "c": [], "d": []}
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    late = rules.RuleSet((rules.Rule("late", "CAST(note AS INT) > 5", "challenge", rules.HIGH, "otp", "late"),))
    decided = {r["transaction_id"]: r["rule_name"] for r in rules.decide(df.withColumn("score", F.lit(0.1)), late).collect()}
    assert decided == {"a": "late", "b": None, "c": None, "d": None}


def test_check_reads_its_rows_once(spark, tmp_path):
    path = str(tmp_path / "context")
    spark.createDataFrame([(1, True, 10.0), (2, False, 10.0)], "transaction_id long, user_is_blocked boolean, amount double").write.parquet(path)
    out = scoring.check_transactions(spark.read.parquet(path), lambda df: df.withColumn("score", F.lit(0.2)), score_all=True)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    rows = {r["transaction_id"]: r for r in out.collect()}
    assert rows[1]["action"] == "block" and rows[1]["risk_score"] == 1.0 and rows[1]["risk_reasons"] == []
    assert rows[2]["action"] == "allow" and rows[2]["risk_score"] == pytest.approx(0.2)


def test_equal_times_of_a_trigger_fall_by_progress(spark):
    from riskweave.operators import retrain as R

    at = datetime(2024, 5, 1)
    first = R.manual_trigger(spark, at, "x")
    log = R.outcome(first, at, "completed", "v9").unionByName(first).unionByName(R.outcome(first, at, "in_progress"))
    for parts in (1, 3):
        row = R.trigger_status(log.repartition(parts)).first()
        assert (row["status"], row["model_version_after"]) == ("completed", "v9")
