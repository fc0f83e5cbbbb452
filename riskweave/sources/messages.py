"""JSON messages: events, predictions and snapshots to and from columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SNAPSHOT, STREAM_EVENT, STREAM_PREDICTION

ISO = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]"}
ISO_OUT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
REQUIRED = (
    "transaction_id", "user_id", "merchant_id", "merchant_category", "amount", "device_id", "device_type",
    "location_country", "timestamp",
)


def parse_events(messages: DataFrame, column: str = "value") -> DataFrame:
    """Event columns plus ``raw`` and ``parsed``; works on batch and stream alike.

    A message that is no JSON, or lacks a field, is not parsed. Absent metadata is an empty map.
    """
    text = F.col(column).cast("string")
    event = F.from_json(text, STREAM_EVENT, ISO)
    rows = messages.select(text.alias("raw"), event.alias("_e")).select("raw", "_e.*")
    complete = F.lit(True)
    for name in REQUIRED:
        complete = complete & F.col(name).isNotNull()
    return rows.withColumns(
        {
            "metadata": F.coalesce("metadata", F.expr("map_from_arrays(array(), array())").cast("map<string,string>")),
            "parsed": complete,
        }
    )


def good_events(messages: DataFrame, column: str = "value") -> DataFrame:
    return parse_events(messages, column).filter("parsed").drop("raw", "parsed")


def dead_letters(messages: DataFrame, column: str = "value") -> DataFrame:
    return parse_events(messages, column).filter("not parsed").select("raw")


def to_messages(df: DataFrame, key: str = "transaction_id") -> DataFrame:
    """(key, value): each row as a JSON object, as a message sink expects it."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns), ISO_OUT).alias("value"))


def predictions_from_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    return messages.select(F.from_json(F.col(column).cast("string"), STREAM_PREDICTION, ISO).alias("_p")).select("_p.*")


def snapshots_from_messages(messages: DataFrame, column: str = "value") -> DataFrame:
    return messages.select(F.from_json(F.col(column).cast("string"), SNAPSHOT, ISO).alias("_s")).select("_s.*")
