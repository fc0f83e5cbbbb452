"""Makes the package importable in Python workers, wherever they run."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

import riskweave


#: Rows of an Arrow batch where the session still has Spark's default: texts are long and blobs longer, and a batch is
#: held by the JVM and by Python at once.
BATCH_ROWS, DEFAULT_BATCH_ROWS = 500, "10000"


def shipped(df: DataFrame) -> DataFrame:
    """Send the package to the workers of the frame's session, once a session, and keep Arrow batches small; returns
    the frame."""
    if df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == DEFAULT_BATCH_ROWS:
        df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = df.sparkSession.sparkContext
    if getattr(context, "_riskweave_shipped", False):
        return df
    # the driver's own folder: from there Spark serves the archive as long as the session lives
    folder = tempfile.mkdtemp(prefix="riskweave-code-")
    root = os.path.dirname(os.path.abspath(riskweave.__file__))
    path = os.path.join(folder, "riskweave.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for top, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._riskweave_shipped = True
    return df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives its free memory back: workers outlive their tasks, and a machine holds
    many of them."""

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not this kind of C library
                pass

    return ran
