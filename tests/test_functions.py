"""Expressions: what is missing stays missing, and nothing raises."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline import functions as fn

NAN, INF = float("nan"), float("inf")


def column(spark, expr, rows, schema="a double, b double"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_division(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (0.0, 0.0), (None, 1.0), (1.0, None), (NAN, 1.0), (INF, 1.0), (1e308, 1e-10)]
    assert column(spark, fn.safe_div(F.col("a"), F.col("b")), rows) == [0.5, None, None, None, None, None, None, None]
    assert column(spark, fn.neutral_ratio(F.col("a"), F.col("b")), rows[:5]) == [0.5, 0.5, 0.5, None, None]


def test_bounds(spark):
    rows = [(1.0, 3.0), (None, 3.0), (-2.0, None)]
    assert column(spark, fn.clip(F.col("a"), lower=0), rows) == [1.0, None, 0.0]
    assert column(spark, fn.clip(F.col("a"), upper=0), rows) == [0.0, None, -2.0]
    assert column(spark, fn.complete_max(F.col("a"), F.col("b")), rows) == [3.0, None, None]
    assert column(spark, fn.skip_max(F.col("a"), F.col("b")), rows) == [3.0, 3.0, -2.0]


def test_small_ones(spark):
    assert column(spark, fn.log_positive(F.col("a")), [(1.0, None), (0.0, None), (-1.0, None), (None, None)]) == [0.0, None, None, None]
    assert column(spark, fn.sign_or_zero(F.col("a")), [(-3.0, None), (None, None), (2.0, None)]) == [-1.0, 0.0, 1.0]
    assert column(spark, fn.filled(F.col("a"), 7.0), [(NAN, None), (INF, None), (None, None), (1.0, None)]) == [7.0, 7.0, 7.0, 1.0]
    assert column(spark, fn.year_of(F.col("a").cast("int")), [(20240131.0, None)]) == [2024]


def test_full_windows(spark):
    rows = [(i, v) for i, v in enumerate([1.0, 2.0, None, 4.0, 5.0, 6.0])]
    w = Window.partitionBy(F.lit(0)).orderBy("i")
    df = spark.createDataFrame(rows, "i int, x double")
    got = [r.m for r in df.withColumn("m", fn.full(F.col("x"), F.avg("x"), fn.rolling(w, 2), 2)).orderBy("i").collect()]
    assert got == [None, 1.5, None, None, 4.5, 5.5]
    lagged = [r.m for r in df.withColumn("m", fn.full(F.col("x"), F.max("x"), fn.rolling(w, 2, 1), 2)).orderBy("i").collect()]
    assert lagged == [None, None, 2.0, None, None, 5.0]


def test_correlation_of_a_constant(spark):
    rows = [(float(i), 1.0) for i in range(5)] + [(None, 2.0)]
    assert column(spark, fn.correlation(F.col("a"), F.col("b")), rows) == [None]
    rows = [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 100.0), (50.0, None)]
    assert math.isclose(column(spark, fn.correlation(F.col("a"), F.col("b")), rows)[0], 1.0)


def test_ranks_equal_pandas(spark):
    rows = [(g, v) for g in (1, 2) for v in (3.0, 1.0, 3.0, None, 2.0, 3.0, 1.0)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g int, x double").withColumn("r", fn.rank_pct(F.col("x"), "g")).toPandas().sort_values("i")
    pdf = pd.DataFrame(rows, columns=["g", "x"])
    pd.testing.assert_series_equal(got["r"].reset_index(drop=True), pdf.groupby("g")["x"].rank(pct=True), check_names=False)
