"""Small column builders shared by the operators. All stay inside JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch; zone-less timestamps are read in the session zone."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def seconds_to_micros(seconds: float) -> int:
    return int(round(seconds * MICROS_PER_SECOND))


def guarded_ratio(num: Column, den: Column, when_zero: float = 0.0) -> Column:
    """num/den as double; ``when_zero`` if the denominator is zero or null."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(float(when_zero)))


def bounded(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip to [low, high]; a null stays null (greatest/least alone would replace it)."""
    out = col
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(col.isNotNull(), out)


def log1p_floor(col: Column) -> Column:
    return F.log1p(bounded(col.cast("double"), 0.0))


def one_if(cond: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(cond, 1).otherwise(0)


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two instants, rounded towards minus infinity."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(float(MICROS_PER_DAY))).cast("long")


def ranked_hash(ident: Column, *salt: int | str) -> Column:
    """A repeatable pseudo-random bigint per id, the same on any partitioning."""
    return F.xxhash64(ident.cast("string"), *[F.lit(str(s)) for s in salt])


def hash_unit(ident: Column, *salt: int | str) -> Column:
    """A repeatable pseudo-random double in (0, 1) per id."""
    top = F.shiftrightunsigned(ranked_hash(ident, *salt), 11).cast("double")
    return (top + F.lit(0.5)) / F.lit(float(2**53))
