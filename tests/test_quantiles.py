"""Quantiles by selection: against numpy, with ties, hot values, groups, extremes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import audits
from strandline.operators.quantiles import exact_quantiles

MARKS = [0.0, 0.001, 0.05, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(9)
    parts = {
        "normal": rng.normal(size=3000), "heavy": rng.standard_cauchy(2000) ** 3, "close": 1 + rng.integers(0, 400, 1500) * 2.0**-52, "hot": np.where(rng.random(2500) < 0.6, 7.25, rng.normal(size=2500)),
        "same": np.full(40, -3.5), "one": np.array([2.0]), "two": np.array([-1e300, 1e300]), "small": rng.normal(size=300) * 1e-200, "signs": np.array([-0.0, 0.0, 1e-300, -1e-300, 0.5, -0.5, 1.0, np.nextafter(1, 0)]), "large": np.exp(rng.uniform(-700, 700, 800)) * rng.choice([-1, 1], 800),
    }
    pdf = pd.concat([pd.DataFrame({"g": k, "x": v}) for k, v in parts.items()])
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("none", None), (None, 4.0), (None, 5.0)], "g string, x double")).repartition(7)
    return df, parts


def test_quantiles_by_group(values):
    df, parts = values
    found = {r.g: r.quantiles for r in exact_quantiles(df, F.col("x"), MARKS, ["g"]).collect()}
    assert set(found) == {*parts, None} and found[None][5] == 4.5
    for k, v in parts.items():
        np.testing.assert_allclose(found[k], np.quantile(v, MARKS), rtol=1e-12, err_msg=k)


def test_quantiles_of_a_frame(spark, values):
    df, parts = values
    whole = np.concatenate([*parts.values(), [4.0, 5.0]])
    plan = exact_quantiles(df, F.col("x"), MARKS)
    np.testing.assert_allclose(plan.first().quantiles, np.quantile(whole, MARKS), rtol=1e-12)
    assert "percentile" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()
    assert exact_quantiles(df.limit(0), F.col("x"), MARKS).count() == 0
    empty = audits.distribution(df.select(F.col("x").alias("y_ret_1d")).limit(0)).first()
    assert empty["rows"] == 0 and empty["q5"] is None


def test_by_period_of_dates_and_years(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"dt": pd.to_datetime("2020-12-28") + pd.to_timedelta(rng.integers(0, 8, 900), "D"), "y_ret_1d": rng.normal(size=900)})
    pdf.loc[::9, "y_ret_1d"] = np.nan
    df = spark.createDataFrame(pdf).withColumns({"dt": F.to_date("dt"), "y_ret_1d": F.when(~F.isnan("y_ret_1d"), F.col("y_ret_1d"))}).unionByName(spark.createDataFrame([(None, 1.5)], "dt date, y_ret_1d double"))
    got = {(r.kind, r.period): r for r in audits.by_period(df).collect()}
    for kind, key in (("date", pdf["dt"].dt.strftime("%Y-%m-%d")), ("year", pdf["dt"].dt.strftime("%Y"))):
        for period, part in pdf.groupby(key)["y_ret_1d"]:
            r = got[kind, period]
            assert (r["count"], r["size"]) == (part.count(), len(part))
            np.testing.assert_allclose([r.q01, r.q50, r.q99], part.quantile([0.01, 0.5, 0.99]), rtol=1e-12)
    assert got["date", None].q50 == 1.5 and len(got) == 8 + 2 + 2
