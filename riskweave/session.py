"""Session set-up and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "riskweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; every one can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the zone in which naive timestamps are read."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting (a test) gets a folder of its own; executors of a
    cluster could not see such a folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="riskweave-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


#: Tables written by this process and not yet forgotten.
_STEPS: list[str] = []


def forget_steps(spark: SparkSession) -> int:
    """Delete the step tables this process has written; returns their number.

    Call it once the results of a job are stored: frames made before read from these tables.
    """
    gone = 0
    while _STEPS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_STEPS.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table once into the shared folder and go on from the files.

    The result no longer depends on what came before, so a lost executor costs a re-read.
    """
    path = f"{shared_root(df.sparkSession)}/riskweave-steps/{uuid.uuid4().hex}"
    _STEPS.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
