"""Data contracts: all checks of one contract are aggregates of a single pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark import errors as E
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import one_if
from .merging import MergedStatistic, merged_value


class Constraint:
    """A column rule: aggregates to compute, and a verdict over them.

    ``measures`` returns the aggregate columns, ``passed`` combines them (given in the same
    order) into a boolean and ``value`` into the number shown in the result.
    """

    name = "constraint"
    message = ""
    severity = "error"

    def measures(self, col: Column) -> list[Column]:
        raise NotImplementedError

    def passed(self, parts: Sequence[Column]) -> Column:
        raise NotImplementedError

    def value(self, parts: Sequence[Column]) -> Column:
        return parts[0].cast("double")


@dataclass(frozen=True)
class Range(Constraint):
    """The smallest and the largest value lie between two inclusive bounds, either of which may be open; nulls do
    not matter. Shown is the bound's offender: the smallest value if it is too small, else the largest."""

    low: float | None = None
    high: float | None = None
    severity: str = "error"

    @property
    def name(self) -> str:
        shown = ["open" if x is None else f"{x}" for x in (self.low, self.high)]
        return "within_" + "_to_".join(shown)

    @property
    def message(self) -> str:
        return f"smallest or largest value outside {self.low} .. {self.high}"

    def measures(self, col):
        return [F.min(col), F.max(col)]

    def _too_small(self, smallest: Column) -> Column:
        return F.lit(False) if self.low is None else F.coalesce(smallest < self.low, F.lit(False))

    def passed(self, parts):
        too_large = F.lit(False) if self.high is None else F.coalesce(parts[1] > self.high, F.lit(False))
        return ~(self._too_small(parts[0]) | too_large)

    def value(self, parts):
        return F.when(self._too_small(parts[0]), parts[0]).otherwise(parts[1]).cast("double")


@dataclass(frozen=True)
class NotNull(Constraint):
    """The share of nulls is at most ``share``; a table without rows fails."""

    share: float = 0.0
    severity: str = "error"
    name = "filled"

    @property
    def message(self) -> str:
        return f"more than {self.share} of the values are missing"

    def measures(self, col):
        return [F.avg(one_if(col.isNull()).cast("double"))]

    def passed(self, parts):
        return F.coalesce(parts[0] <= self.share, F.lit(False))


@dataclass(frozen=True)
class InSet(Constraint):
    """No value but those of ``known`` (nulls do not matter); shown is the number of others."""

    known: Sequence = ()
    severity: str = "error"
    name = "known_value"

    @property
    def message(self) -> str:
        return f"values other than {', '.join(map(str, sorted(self.known)))}"

    def measures(self, col):
        return [F.count_if(col.isNotNull() & ~col.isin(*self.known))]

    def passed(self, parts):
        return parts[0] == 0


@dataclass(frozen=True)
class Unique(Constraint):
    """As many different values as rows, so a null fails; shown is the difference."""

    severity: str = "error"
    name = "distinct"
    message = "values occur twice or are missing"

    def measures(self, col):
        return [F.count(F.lit(1)) - F.count_distinct(col)]

    def passed(self, parts):
        return parts[0] == 0


@dataclass(frozen=True)
class ColumnStatistic:
    """A built-in aggregate, worked out for every checked column, that should lie between two bounds."""

    name: str
    aggregate: Callable[[Column], Column]
    low: float | None = None
    high: float | None = None
    severity: str = "warning"

    @property
    def limits(self) -> str:
        return " .. ".join("" if x is None else f"{x}" for x in (self.low, self.high)).strip()

    def passed(self, value: Column) -> Column:
        above = F.lit(True) if self.low is None else value >= self.low
        below = F.lit(True) if self.high is None else value <= self.high
        return F.coalesce(value.isNotNull() & above & below, F.lit(False))


class Findings:
    """What a contract found, derived from its check table."""

    def __init__(self, checks: Sequence, unfit: Sequence[tuple[str, str]], counts: dict[str, int], measured: Sequence[str]):
        self.checks, self.counts = tuple(checks), counts
        self._failed = [(r["severity"], r["message"]) for r in checks if not r["passed"]] + list(unfit)
        self._measured = set(measured)

    def _of(self, error: bool) -> list[str]:
        return [message for severity, message in self._failed if (severity == "error") == error]

    @property
    def errors(self) -> list[str]:
        return self._of(True)

    @property
    def warnings(self) -> list[str]:
        return self._of(False)

    @property
    def valid(self) -> bool:
        return not self.errors

    @property
    def stats(self) -> dict[str, object]:
        """Rows, columns and the value of every statistic by column and name."""
        values = {f"{r['column']}_{r['check']}": r["value"] for r in self.checks if r["check"] in self._measured}
        return {**self.counts, **values}


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_KINDS: dict[type, tuple] = {
    float: (T.FloatType, T.DoubleType, *_INTEGERS),
    int: _INTEGERS,
    str: (T.StringType,),
}
#: What a check on unfit data or an unfit rule raises; anything else (a lost executor, a missing file) passes through.
DATA_ERRORS = (
    E.AnalysisException, E.ArithmeticException, E.ArrayIndexOutOfBoundsException, E.DateTimeException, E.IllegalArgumentException,
    E.NumberFormatException, E.ParseException, E.PythonException, E.PySparkTypeError, E.PySparkValueError, E.SparkRuntimeException,
    ValueError, TypeError, LookupError, AttributeError, ArithmeticError,
)
RESULT = "contract string, column string, check string, severity string, passed boolean, value double, message string"


@dataclass
class DataContract:
    name: str
    required_columns: Sequence[str] = ()
    column_types: dict[str, type] = field(default_factory=dict)
    constraints: dict[str, Sequence[Constraint]] = field(default_factory=dict)
    statistics: Sequence[ColumnStatistic] = ()
    merged: Sequence[MergedStatistic] = ()

    def _static_rows(self, df: DataFrame) -> list[tuple]:
        rows = [
            (self.name, c, "required", "error", c in df.columns, None, f"{c}: no such column")
            for c in self.required_columns
        ]
        for c, kind in self.column_types.items():
            if c in df.columns:
                actual = df.schema[c].dataType
                ok = isinstance(actual, _KINDS[kind])
                rows.append((self.name, c, "type", "error", ok, None,
                             f"{c}: {actual.simpleString()} where {kind.__name__} is needed"))
        return rows

    def check(self, df: DataFrame) -> DataFrame:
        """Result rows (contract, column, check, severity, passed, value, message), lazily."""
        static = df.sparkSession.createDataFrame(self._static_rows(df), RESULT)
        plain: list[Column] = []
        deferred: list[Callable[[Callable[[int], Column]], Column]] = []
        distinct: list[DataFrame] = []

        def row(column, check, severity, passed, value, message):
            return F.struct(
                F.lit(self.name).alias("contract"), F.lit(column).alias("column"), F.lit(check).alias("check"),
                F.lit(severity).alias("severity"), passed.alias("passed"), value.alias("value"), message.alias("message"),
            )

        for c, rules in self.constraints.items():
            if c not in df.columns:
                continue
            for rule in rules:
                message = F.lit(f"{c} ({rule.name}): {rule.message}")
                if isinstance(rule, Unique):
                    # a distinct count regroups by value, so it gets a job of its own
                    one = df.agg(*[m.alias(f"m{i}") for i, m in enumerate(rule.measures(F.col(c)))])
                    distinct.append(one.select(F.inline(F.array(
                        row(c, rule.name, rule.severity, rule.passed([F.col("m0")]), rule.value([F.col("m0")]), message)
                    ))))
                    continue
                at = len(plain)
                parts = rule.measures(F.col(c))
                plain += parts
                deferred.append(lambda m, at=at, n=len(parts), rule=rule, c=c, message=message: row(
                    c, rule.name, rule.severity, rule.passed([m(at + i) for i in range(n)]),
                    rule.value([m(at + i) for i in range(n)]), message))
        checked = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.LongType, T.StringType))]
        for rule in self.statistics:
            for c in checked:
                at = len(plain)
                plain.append(rule.aggregate(F.col(c)).cast("double"))
                deferred.append(lambda m, at=at, rule=rule, c=c: row(
                    c, rule.name, rule.severity, rule.passed(m(at)), m(at),
                    F.concat(F.lit(f"{c}: {rule.name} is "), F.format_string("%.4f", m(at)), F.lit(f", limits {rule.limits}"))))
        parts = [static, *distinct]
        for rule in self.merged:
            if all(c in df.columns for c in rule.columns):
                value, c = F.col("value"), rule.columns[0]
                text = F.concat(F.lit(f"{c}: {rule.name} is "), F.coalesce(F.format_string("%.4f", value), F.lit("undefined")), F.lit(f", limits {rule.low} .. {rule.high}"))
                parts.append(merged_value(df, rule).select(F.inline(F.array(row(c, rule.name, rule.severity, rule.passed(value), value, text)))))
        if plain:
            wide = df.agg(*[p.alias(f"m{i}") for i, p in enumerate(plain)])
            parts.append(wide.select(F.inline(F.array(*[d(lambda i: F.col(f"m{i}")) for d in deferred]))))
        return reduce(DataFrame.unionByName, parts)

    def _one_by_one(self, df: DataFrame) -> tuple[list, list[tuple[str, str]]]:
        """Each check in a job of its own: a constraint that cannot be evaluated is one error, an anomaly check one
        warning, and all others count."""
        rows = list(DataContract(self.name, self.required_columns, self.column_types).check(df).collect())
        broken: list[tuple[str, str]] = []
        single = [("error", f"'{rule.name}' on column '{c}'", DataContract(self.name, constraints={c: [rule]}))
                  for c, rules in self.constraints.items() for rule in rules]
        single += [("warning", f"'{rule.name}'", DataContract(self.name, statistics=[rule])) for rule in self.statistics]
        single += [("warning", f"'{rule.name}'", DataContract(self.name, merged=[rule])) for rule in self.merged]
        for severity, what, contract in single:
            try:
                rows += contract.check(df).collect()
            except DATA_ERRORS as problem:
                broken.append((severity, f"Contract '{self.name}' could not evaluate {what}: {str(problem).splitlines()[0]}"))
        return rows, broken

    def validate(self, df: DataFrame) -> Findings:
        """Run the checks; only the result rows, one per check, reach the driver."""
        try:
            rows, unfit = self.check(df).collect(), []
        except DATA_ERRORS:
            rows, unfit = self._one_by_one(df)
        measured = [rule.name for rule in (*self.statistics, *self.merged)]
        return Findings(rows, unfit, {"rows": df.count(), "columns": len(df.columns)}, measured)


def require_valid(df: DataFrame, contract: DataContract, fail_on_error: bool = True) -> Findings:
    """Validate and raise ``ValueError`` on errors."""
    result = contract.validate(df)
    if fail_on_error and not result.valid:
        raise ValueError(f"Data contract '{contract.name}' violated: {result.errors}")
    return result


def null_rate(most: float = 0.05) -> ColumnStatistic:
    return ColumnStatistic("null_rate", lambda c: F.avg(one_if(c.isNull()).cast("double")), high=most)


# --- fixed values: names, columns, types, bounds and the null rate of the built-in contracts ----------
TRANSACTION_CONTRACT = DataContract(
    name="transactions",
    required_columns=("transaction_id", "timestamp", "amount", "merchant_id", "merchant_category", "user_id"),
    column_types={"amount": float, "merchant_id": str, "user_id": str},
    constraints={"transaction_id": [Unique()], "amount": [Range(0, 100_000)], "timestamp": [NotNull()]},
    statistics=(null_rate(),),
)

LABEL_CONTRACT = DataContract(
    name="labels",
    required_columns=("transaction_id", "is_fraud", "label_timestamp"),
    column_types={"is_fraud": int},
    constraints={"transaction_id": [NotNull()], "is_fraud": [InSet((0, 1))]},
)
# ------------------------------------------------------------------------------------------
