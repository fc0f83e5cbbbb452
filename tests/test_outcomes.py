"""Outcomes of predictions and labels in event order, on tables and on streams, against a plain walk."""

import random
from datetime import datetime, timedelta

import pytest

from riskweave.operators.outcomes import prediction_outcomes
from riskweave.streaming import labels as stream_labels
from riskweave.streaming.labels import open_outcomes, reconcile_stream

T0 = datetime(2024, 2, 1)
P_DDL = "transaction_id string, fraud_probability double, decision string, model_version string, prediction_timestamp timestamp, amount double"
L_DDL = "transaction_id string, is_fraud int, label_timestamp timestamp"


def walk(events, as_of, max_age):
    """Outcomes by going through the events one after another; events are (time, is_label, id, tag)."""
    waiting, out = {}, []

    def close(tid, status, at=None, tag=None):
        when, own = waiting.pop(tid)
        out.append((tid, status, own, when, tag, at))

    for at, is_label, tid, tag in sorted(events):
        if tid in waiting and at - waiting[tid][0] > max_age:
            close(tid, "expired")
        if is_label:
            if tid in waiting:
                close(tid, "matched", at, tag)
            else:
                out.append((tid, "unmatched", None, None, tag, at))
        else:
            if tid in waiting:
                close(tid, "superseded")
            waiting[tid] = (at, tag)
    for tid in list(waiting):
        close(tid, "expired" if as_of - waiting[tid][0] > max_age else "pending")
    return sorted(out, key=repr)


def made_events(n, ids, seed, days=100):
    rng = random.Random(seed)
    at = sorted(rng.sample(range(days * 24 * 60), n))  # no two events at one time
    return [(T0 + timedelta(minutes=m), rng.random() < 0.5, f"t{rng.randrange(ids)}", rng.randrange(2)) for m in at]


def tables(spark, events):
    p = [(i, 0.5, "block" if tag else "allow", f"v{tag}", at, 1.0) for at, is_label, i, tag in events if not is_label]
    q = [(i, tag, at) for at, is_label, i, tag in events if is_label]
    return spark.createDataFrame(p, P_DDL), spark.createDataFrame(q, L_DDL)


def rows_of(frame):
    return sorted(
        ((r["transaction_id"], r["status"], None if r["decision"] is None else int(r["decision"] == "block"), r["prediction_timestamp"], r["is_fraud"], r["label_timestamp"])
         for r in frame.collect()),
        key=repr,
    )


@pytest.mark.parametrize("min_rows", [1_000_000, 40])
def test_tables_equal_a_plain_walk(spark, min_rows):
    """With a border of 40 rows the crowded ids are scanned in slices."""
    events = made_events(600, 12, 1) + [(at, kind, "crowded", tag) for at, kind, _, tag in made_events(400, 1, 2)]
    as_of = T0 + timedelta(days=101)
    got = prediction_outcomes(*tables(spark, events), as_of, max_age_days=10, min_rows=min_rows)
    assert rows_of(got) == walk(events, as_of, timedelta(days=10))


def test_two_predictions_and_two_labels_alternating(spark):
    hours = [timedelta(hours=h) for h in range(4)]
    events = [(T0 + hours[0], False, "a", 1), (T0 + hours[1], True, "a", 1), (T0 + hours[2], False, "a", 0), (T0 + hours[3], True, "a", 0)]
    got = rows_of(prediction_outcomes(*tables(spark, events), T0 + timedelta(days=1)))
    assert [r[1] for r in got] == ["matched", "matched"]


def test_equal_times_nulls_and_later_events(spark):
    p = spark.createDataFrame([("a", 0.1, "allow", "v1", T0, 1.0), (None, 0.1, "allow", "v1", T0, 1.0), ("b", 0.2, "allow", "v1", None, 1.0)], P_DDL)
    q = spark.createDataFrame([("a", 1, T0), ("a", 0, T0 + timedelta(days=9)), (None, 1, T0)], L_DDL)
    got = rows_of(prediction_outcomes(p, q, T0 + timedelta(days=1)))
    assert [(r[0], r[1]) for r in got] == [("a", "matched")]
    assert prediction_outcomes(p.limit(0), q.limit(0), T0).count() == 0


def run_stream(spark, folder, events, batches, **kw):
    """The events as ``batches`` files each of predictions and labels; everything written and open."""
    size = -(-len(events) // batches)
    for k in range(batches):
        for name, frame in zip("pq", tables(spark, events[k * size : (k + 1) * size])):
            frame.coalesce(1).write.mode("append").parquet(str(folder / name))
    read = lambda n, ddl: spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(folder / n))
    paths = [str(folder / x) for x in ("state", "out", "cp")]
    reconcile_stream(read("p", P_DDL), read("q", L_DDL), *paths, **kw).awaitTermination()
    return paths


@pytest.mark.parametrize("batches", [1, 2, 8])
def test_stream_equals_tables_however_it_is_cut(spark, tmp_path, monkeypatch, batches):
    monkeypatch.setattr(stream_labels, "SNAPSHOT_EVERY", 3)  # several snapshots on the way
    events = made_events(240, 20, 5)
    state, out, _ = run_stream(spark, tmp_path, events, batches, max_age_days=12)
    written, still = spark.read.parquet(out).drop("batch_id"), open_outcomes(spark, state, max_age_days=12)
    newest = events[-1][0]
    assert rows_of(written.unionByName(still)) == walk(events, newest, timedelta(days=12))
    assert written.filter("status = 'pending'").count() == 0
    if batches > 2:
        assert written.filter("status = 'expired'").count() > 0  # given out while the stream ran
    closed = {p.name for p in (tmp_path / "state" / "open").iterdir()}
    assert f"batch_id={0}" not in closed or batches <= 4  # steps before the last snapshot are gone


def test_unordered_events_within_the_delay_and_later_ones(spark, tmp_path):
    events = made_events(120, 8, 9, days=40)
    rng = random.Random(1)
    moved = sorted(events, key=lambda e: e[0] + timedelta(hours=rng.randrange(48)))  # up to two days out of order
    state, out, _ = run_stream(spark, tmp_path, moved, 4, max_age_days=12, delay=timedelta(days=2))
    written, still = spark.read.parquet(out).drop("batch_id"), open_outcomes(spark, state, max_age_days=12)
    assert rows_of(written.unionByName(still)) == walk(events, events[-1][0], timedelta(days=12))
    late = spark.read.parquet(f"{out}-late")
    assert late.count() == 0
    # an event older than what is final goes to the side table and changes nothing
    p, _ = tables(spark, [(T0 - timedelta(days=1), False, "t1", 1)])
    p.coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    read = lambda n, ddl: spark.readStream.schema(ddl).parquet(str(tmp_path / n))
    reconcile_stream(read("p", P_DDL), read("q", L_DDL), state, out, str(tmp_path / "cp"), max_age_days=12, delay=timedelta(days=2)).awaitTermination()
    assert spark.read.parquet(f"{out}-late").count() == 1
    both = spark.read.parquet(out).drop("batch_id").unionByName(open_outcomes(spark, state, max_age_days=12))
    assert both.count() == written.count() + still.count()


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    events = made_events(100, 8, 4)
    state, out, _ = run_stream(spark, tmp_path, events, 3, max_age_days=12)
    before = rows_of(spark.read.parquet(out).drop("batch_id").unionByName(open_outcomes(spark, state, max_age_days=12)))
    # as if the driver had stopped before the last batch was recorded as done
    for name in ("commits/2", "commits/.2.crc"):
        path = tmp_path / "cp" / name
        if path.exists():
            path.unlink()
    read = lambda n, ddl: spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n))
    reconcile_stream(read("p", P_DDL), read("q", L_DDL), state, out, str(tmp_path / "cp"), max_age_days=12).awaitTermination()
    again = rows_of(spark.read.parquet(out).drop("batch_id").unionByName(open_outcomes(spark, state, max_age_days=12)))
    assert again == before


def test_nothing_before_the_first_batch(spark, tmp_path):
    assert open_outcomes(spark, str(tmp_path / "none")) is None
