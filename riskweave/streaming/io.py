"""Message sources and sinks for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..session import prepare
from ..sources.messages import to_messages


def kafka_messages(spark: SparkSession, servers: str, topic: str, starting: str = "latest", group: str | None = None) -> DataFrame:
    """A Kafka topic as (key, value, ...) rows; offsets live in the query's checkpoint.

    Needs the Kafka connector package on the class path.
    """
    prepare(spark)
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if group:
        reader = reader.option("groupIdPrefix", group)
    return reader.option("startingOffsets", starting).load()


def file_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A folder of text files, one JSON message per line, as a stream."""
    prepare(spark)
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def write_messages(df: DataFrame, checkpoint: str, *, path: str | None = None, servers: str | None = None, topic: str | None = None):
    """Predictions as JSON messages to a topic, or to text files when ``path`` is given."""
    out = to_messages(df)
    writer = out.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    if path is not None:
        return out.select("value").writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("text").start(path)
    return writer.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).start()


def write_memory(df: DataFrame, name: str, checkpoint: str | None = None):
    """Keep the stream's output in an in-memory table, for inspection in tests only."""
    writer = df.writeStream.outputMode("append").format("memory").queryName(name)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


class RunCounters(StreamingQueryListener):
    """Rows and time of all triggers of one query's whole run; register with ``spark.streams.addListener``.

    With ``max_events`` the query is stopped once it has processed as many (after the micro-batch that reaches it).
    """

    def __init__(self, query=None, max_events: int | None = None):
        self.query, self.max_events = query, max_events
        self.processed, self.total_latency_ms = 0, 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if self.query is not None and str(progress.runId) != str(self.query.runId):
            return
        self.processed += int(progress.numInputRows)
        self.total_latency_ms += float(dict(progress.durationMs).get("triggerExecution", 0))
        if self.query is not None and self.max_events is not None and self.processed >= self.max_events:
            self.query.stop()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def summary(self) -> dict[str, float]:
        mean = self.total_latency_ms / self.processed if self.processed else 0.0
        return {"processed": self.processed, "total_latency_ms": self.total_latency_ms, "avg_latency_ms": mean}


def progress(query) -> dict[str, float]:
    """Rows processed and time spent in the recent triggers; ``RunCounters`` covers the whole run."""
    seen = query.recentProgress
    rows = sum(int(p["numInputRows"]) for p in seen)
    ms = sum(int(p["durationMs"].get("triggerExecution", 0)) for p in seen)
    return {"processed": rows, "total_latency_ms": float(ms), "avg_latency_ms": ms / rows if rows else 0.0}
