"""Record checks: normalise, fill defaults, and split good rows from quarantined ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEVICE_TYPES, LABEL_SOURCES, MERCHANT_CATEGORIES, Field


def merchant_category(col: Column) -> Column:
    """Lower-cased category; anything outside the known set becomes "other"."""
    low = F.lower(col)
    return F.when(low.isin(*MERCHANT_CATEGORIES), low).when(col.isNotNull(), "other")


def device_type(col: Column) -> Column:
    """Lower-cased device type; unknown kinds become "unknown", null stays null."""
    low = F.lower(col)
    return F.when(low.isin(*DEVICE_TYPES), low).when(col.isNotNull(), "unknown")


def label_source(col: Column) -> Column:
    """Lower-cased source; null and unknown sources become "unknown"."""
    low = F.lower(col)
    return F.coalesce(F.when(low.isin(*LABEL_SOURCES), low), F.lit("unknown"))


NORMALISERS = {
    "transaction": {"merchant_category": merchant_category, "device_type": device_type},
    "label": {"label_source": label_source},
}


def check_records(df: DataFrame, fields: Sequence[Field], record: str | None = None) -> DataFrame:
    """The record's columns, typed, normalised and defaulted, plus ``failed_fields``.

    A field fails when it is required but null, cannot be read as its type, is out of bounds
    or outside its allowed values. Columns that are absent count as null.
    """
    normal = NORMALISERS.get(record or "", {})
    values, failures = [], []
    for f in fields:
        raw = F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.type)
        typed = raw.try_cast(f.type)
        broken = raw.isNotNull() & typed.isNull()
        if f.required:
            broken = broken | raw.isNull()
        if f.low is not None:
            broken = broken | (typed < F.lit(f.low))
        if f.high is not None:
            broken = broken | (typed > F.lit(f.high))
        if f.type == "double":
            broken = broken | F.isnan(typed)
        if f.allowed:
            broken = broken | ~typed.isin(*f.allowed)
        out = normal[f.name](typed) if f.name in normal else typed
        if f.default is not None:
            out = F.coalesce(out, F.lit(f.default).cast(f.type))
        values.append(out.alias(f.name))
        failures.append(F.when(broken, F.lit(f.name)))
    return df.select(*values, F.array_compact(F.array(*failures)).alias("failed_fields"))


def split_records(
    df: DataFrame, fields: Sequence[Field], record: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``failed_fields``)."""
    checked = check_records(df, fields, record)
    bad = F.size("failed_fields") > 0
    return checked.filter(~bad).drop("failed_fields"), checked.filter(bad)
