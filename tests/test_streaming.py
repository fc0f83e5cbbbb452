from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators.rules import engine_rules
from riskweave.operators.velocity import serving_velocity
from riskweave.sources.messages import good_events, to_messages
from riskweave.streaming import io
from riskweave.streaming.labels import windowed_activity
from riskweave.streaming.scoring import prediction_events
from riskweave.streaming.velocity import velocity_stream

T0 = datetime(2024, 2, 1)
DDL = ("transaction_id string, user_id string, merchant_id string, merchant_category string, amount double, device_id string, "
       "device_type string, location_country string, timestamp timestamp")


def events(spark, n=120):
    rng = np.random.default_rng(6)
    rows = [
        (f"{i:04d}", f"u{rng.integers(0, 3)}", f"m{rng.integers(0, 4)}", "food", float(np.round(rng.lognormal(3, 1), 2)), f"d{rng.integers(0, 3)}",
         "mobile", "NG", T0 + timedelta(minutes=40 * i))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, DDL)


def drop_batch(df, folder, name):
    """One text file per micro-batch, as a message broker would hand them over."""
    lines = [r["value"] for r in to_messages(df).collect()]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    every = events(spark)
    inbox = tmp_path / "in"
    inbox.mkdir()
    paths = [str(tmp_path / p) for p in ("history", "out", "checkpoint")]
    for k in range(3):
        part = every.filter((F.col("transaction_id") >= f"{40 * k:04d}") & (F.col("transaction_id") < f"{40 * (k + 1):04d}"))
        drop_batch(part, inbox, f"b{k}.txt")
        stream = good_events(io.file_messages(spark, str(inbox))).drop("metadata")
        velocity_stream(stream, *paths).awaitTermination()
    got = spark.read.parquet(paths[1]).drop("batch_id")
    want = serving_velocity(every).select(*got.columns)
    assert got.count() == 120 and got.exceptAll(want).count() == 0


def test_scored_stream_and_late_rows(spark, tmp_path):
    every = events(spark, 60)
    inbox = tmp_path / "in"
    inbox.mkdir()
    drop_batch(every, inbox, "a.txt")
    (inbox / "bad.txt").write_text("{not json\n")
    args = [str(tmp_path / p) for p in ("history", "out", "checkpoint")]
    score = prediction_events(lambda df: df.withColumn("score", F.lit(0.95)), engine_rules())
    run = lambda: velocity_stream(good_events(io.file_messages(spark, str(inbox))), *args, score=score, late_path=str(tmp_path / "late"))
    query = run()
    query.awaitTermination()
    assert io.progress(query)["processed"] == 61
    out = spark.read.parquet(args[1])
    assert out.count() == 60 and {r["decision"] for r in out.collect()} == {"block"}
    old = every.limit(1).withColumn("timestamp", F.lit(T0 - timedelta(days=20))).withColumn("transaction_id", F.lit("late"))
    drop_batch(old, inbox, "z.txt")
    run().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "late")).first()["transaction_id"] == "late"
    assert spark.read.parquet(args[1]).count() == 60


def test_message_sink_and_memory_table(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    drop_batch(events(spark, 10), inbox, "a.txt")
    stream = good_events(io.file_messages(spark, str(inbox))).select("transaction_id", "amount", "timestamp")
    query = io.write_messages(stream, str(tmp_path / "cp"), path=str(tmp_path / "sent"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.text(str(tmp_path / "sent")).count() == 10
    memory = io.write_memory(stream, "seen", str(tmp_path / "cp2"))
    memory.processAllAvailable()
    memory.stop()
    assert spark.table("seen").count() == 10


def test_windows(spark):
    df = events(spark, 10)
    out = windowed_activity(df, length="1 hour", slide="1 hour")
    assert out.agg(F.sum("n")).first()[0] == 10
    assert out.agg(F.sum("amount")).first()[0] == pytest.approx(df.agg(F.sum("amount")).first()[0])


def test_slices_are_written_by_many_tasks_and_read_as_one_batch_each(spark, tmp_path):
    from riskweave.plans import stream_queries

    every = events(spark).repartition(4)
    cuts = (T0 + timedelta(days=1), T0 + timedelta(days=2), T0 + timedelta(days=9))
    folder, sizes, files = tmp_path / "in", [], []

    def start(stream):
        def step(batch, batch_id):
            sizes.append((batch_id, batch.count()))
            files.append(len(list(folder.glob("*.parquet"))))

        return stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    stream_queries._in_slices([(every, "timestamp", str(folder))], cuts, start)
    hours = [timedelta(minutes=40 * i) for i in range(120)]
    bounds = [timedelta(0), *[c - T0 for c in cuts], timedelta(days=99)]
    want = [sum(low <= h < high for h in hours) for low, high in zip(bounds, bounds[1:])]
    assert sizes == list(enumerate(want)) and want[-1] == 0
    assert files[0] > 1 and spark.read.parquet(str(folder)).count() == 120
