"""User statistics merged in a tree, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.operators import quality
from riskweave.operators.merging import MergedStatistic, correlation, merged_value, trimmed_mean


def numbers(spark, n=3_000):
    rng = np.random.default_rng(2)
    x = rng.lognormal(3, 1, n)
    rows = [(float(a), float(1e6 + a + b)) for a, b in zip(x, rng.normal(0, 20, n))] + [(None, 1.0), (float("nan"), 2.0)]
    return x, np.array([r[1] for r in rows[:n]]), spark.createDataFrame(rows, "a double, b double")


@pytest.mark.parametrize("parts", [1, 7])
def test_correlation_and_trimmed_mean(spark, parts):
    x, y, df = numbers(spark)
    df = df.repartition(parts)
    assert merged_value(df, correlation("a", "b")).first()[0] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
    cut = np.sort(x)[150:-150]
    assert merged_value(df, trimmed_mean("a", 0.0, 400.0, bins=4_000)).first()[0] == pytest.approx(cut.mean(), rel=1e-3)


def test_a_statistic_of_ones_own_in_a_contract(spark):
    largest = MergedStatistic(
        "largest", ["a"], lambda: None, lambda s, b: max([v for v in [s, *b.column(0).to_pylist()] if v is not None], default=None),
        lambda p, q: max([v for v in (p, q) if v is not None], default=None), lambda s: s, high=5.0, severity="error",
    )
    df = spark.createDataFrame([(1.0,), (9.0,), (None,)], "a double").repartition(3)
    result = quality.DataContract("own", merged=[largest]).validate(df)
    assert not result.valid and "largest is 9.0000" in result.errors[0] and result.stats["a_largest"] == 9.0
    fine = quality.DataContract("own", merged=[largest]).validate(df.filter("a < 5"))
    assert fine.valid and fine.stats["rows"] == 1
    # a column the table lacks is no check; what fails inside is an error of its own and leaves the others
    absent = MergedStatistic("x", ["gone"], lambda: 0, lambda s, b: s, lambda p, q: p, lambda s: 0.0)
    broken = MergedStatistic("broken", ["a"], lambda: 0, lambda s, b: 1 // 0, lambda p, q: p, lambda s: 0.0)
    result = quality.DataContract("own", merged=[absent, broken, largest]).validate(df)
    assert len(result.errors) == 1 and len(result.warnings) == 1 and "broken" in result.warnings[0]


def test_empty_table_and_no_spread(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert merged_value(df, correlation("a", "b")).collect()[0][0] is None
    assert merged_value(df, trimmed_mean("a", 0.0, 1.0)).collect()[0][0] is None
    flat = spark.range(50).select(F.lit(1.0).alias("a"), F.col("id").cast("double").alias("b"))
    assert merged_value(flat, correlation("a", "b")).first()[0] is None
    assert not quality.DataContract("c", merged=[correlation("a", "b", low=0.0)]).check(flat).first()["passed"]
