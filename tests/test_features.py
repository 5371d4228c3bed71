"""Features: counts, hand formulas, causality, warm-up."""

from __future__ import annotations

import datetime as dt
import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import features as fx
from strandline.operators import recursion
from strandline.operators import panel as panel_ops
from strandline.operators.panel import KEYS, ContractError, densify, joined_one_to_one, same_keys, with_returns

DAY = dt.date(2020, 1, 1)


def wavy(n=150, entities=2, gap=(7, 90)):
    out = []
    for e in range(entities):
        for i in range(n):
            c = 10 + 0.05 * i + math.sin(i * (e + 1)) + e
            row = [e, DAY + dt.timedelta(days=i), c - 0.1 * math.cos(i), c + 0.5, c - 0.4, c, 1000.0 + 10 * (i % 13), (1000.0 + 10 * (i % 13)) * c]
            out.append(row if i not in gap else [e, row[1], *[None] * 6])
    return out


SCHEMA = "entity long, dt date, open double, high double, low double, close double, vol double, amount double"
ALL = [f.name for f in (*fx.base(), *fx.advanced())]


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(wavy(), SCHEMA)


@pytest.fixture(scope="module")
def computed(panel):
    return fx.compute(panel, ALL).toPandas().sort_values(["entity", "dt"]).reset_index(drop=True)


def test_counts():
    assert len(fx.base()) == 147 and len(fx.advanced()) == 32 and len(set(ALL)) == 179
    assert fx.warm_up() == 121 and fx.warm_up(["ret_5", "rsi_12"]) == 13 and {x["name"] for x in fx.dictionary()} == set(ALL)


def test_hand_formulas(computed):
    rows = wavy()
    close = [r[5] for r in rows[:150]]
    at = lambda name, i: computed.loc[i, name]
    i = 60
    assert at("ret_5", i) == pytest.approx(close[i] / close[i - 5] - 1)
    assert at("close_ma_ratio_20", i) == pytest.approx(close[i] / statistics.mean(close[i - 19 : i + 1]) - 1)
    rets = [close[k] / close[k - 1] - 1 for k in range(i - 19, i + 1)]
    assert at("ret_std_20", i) == pytest.approx(statistics.stdev(rets))
    m, s = np.mean(rets), np.std(rets)
    assert at("ret_skew_20", i) == pytest.approx(np.mean((np.array(rets) - m) ** 3) / s**3)
    assert at("ret_kurt_20", i) == pytest.approx(np.mean((np.array(rets) - m) ** 4) / s**4 - 3)
    assert at("breakout_high_10", i) == pytest.approx(close[i] / max(r[3] for r in rows[i - 10 : i]) - 1)
    assert at("open_to_low", i) == pytest.approx(rows[i][2] / rows[i][4] - 1)
    gain = [max(close[k] - close[k - 1], 0) for k in range(i - 5, i + 1)]
    loss = [max(close[k - 1] - close[k], 0) for k in range(i - 5, i + 1)]
    assert at("rsi_6", i) == pytest.approx(sum(gain) / (sum(gain) + sum(loss)))
    assert at("trend_efficiency_10", i) == pytest.approx((close[i] / close[i - 10] - 1) / sum(abs(close[k] / close[k - 1] - 1) for k in range(i - 9, i + 1)))


def test_gaps_are_missing(computed):
    """A row without prices has no features, and no full window holds it."""
    assert math.isnan(computed.loc[7, "ret_1"]) and math.isnan(computed.loc[8, "ret_1"]) and not math.isnan(computed.loc[9, "ret_1"])
    assert math.isnan(computed.loc[26, "close_ma_ratio_20"]) and not math.isnan(computed.loc[27, "close_ma_ratio_20"])
    assert computed.loc[7, "mfi_14"] is None or math.isnan(computed.loc[6, "ret_std_20"])


def test_ema_equals_pandas(panel):
    spans = {"e5": 5, "e12": 12}
    fold = recursion.ema_columns(panel, "close", spans).toPandas().sort_values(["entity", "dt"]).reset_index(drop=True)
    arrow = recursion.ema_pandas(panel, "close", spans).toPandas().sort_values(["entity", "dt"]).reset_index(drop=True)
    for name, n in spans.items():
        want = fold.groupby("entity")["close"].transform(lambda s, n=n: s.ewm(span=n, min_periods=n, adjust=False).mean())
        np.testing.assert_allclose(fold[name], want, rtol=1e-12)
        np.testing.assert_allclose(arrow[name], want, rtol=1e-12)


def test_gap_rule_of_the_ema(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 2.0, None, None, 5.0, 6.0])], "entity int, dt int, x double")
    got = [r.m for r in recursion.ema_columns(df, "x", {"m": 3}).orderBy("dt").collect()]
    want = pd.Series([1.0, 2.0, None, None, 5.0, 6.0]).ewm(span=3, min_periods=3, adjust=False).mean()
    np.testing.assert_allclose([np.nan if v is None else v for v in got], want, rtol=1e-12)


@pytest.mark.parametrize("span", [1, 2, 20, 3000])
def test_ema_of_a_history_longer_than_a_row(spark, span):
    """Long gaps, values of unlike size, and many blocks: equal to pandas, without any row that holds a history."""
    rng = np.random.default_rng(span)
    n = 60_000
    x = np.exp(rng.normal(0, 3, n).cumsum() / 100) * rng.choice([1.0, 1e-6, 1e6], n)
    x[rng.random(n) < 0.3] = np.nan
    x[5_000:9_000], x[:3] = np.nan, np.nan
    pdf = pd.DataFrame({"entity": np.arange(n) % 7 == 0, "dt": np.arange(n), "x": x})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(5)
    found = recursion.ema_columns(df, "x", {"m": span})
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = found.toPandas().sort_values(["entity", "dt"])
    want = got.groupby("entity")["x"].transform(lambda s: s.ewm(span=span, min_periods=span, adjust=False).mean())
    np.testing.assert_allclose(got["m"], want, rtol=1e-11)


@pytest.mark.parametrize("cut", [70, 130])
def test_causality(spark, computed, cut):
    """A changed future leaves the past as it was."""
    rows = [r if r[1] <= DAY + dt.timedelta(days=cut) or r[2] is None else [r[0], r[1], *[v * 1000 for v in r[2:]]] for r in wavy()]
    got = fx.compute(spark.createDataFrame(rows, SCHEMA), ALL).toPandas().sort_values(["entity", "dt"]).reset_index(drop=True)
    past = computed["dt"] <= DAY + dt.timedelta(days=cut)
    pd.testing.assert_frame_equal(got[past], computed[past])


def test_one_shuffle_for_all_windows(panel):
    plan = fx.compute(panel, [n for n in ALL if "ema" not in n and "macd" not in n])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_unused_frames_are_pruned(panel):
    df = fx.compute(panel, ["ret_1"])
    assert "stddev" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_unknown_feature(panel):
    with pytest.raises(ValueError, match="no such"):
        fx.compute(panel, ["nothing"])


def test_warm_up_rows_are_used_and_dropped(spark, computed):
    rows = wavy()
    tail = spark.createDataFrame([r for r in rows if r[1] < DAY + dt.timedelta(days=140)], SCHEMA)
    new = spark.createDataFrame([r for r in rows if r[1] >= DAY + dt.timedelta(days=140)], SCHEMA)
    names = ["ret_1", "position_120", "ret_std_60"]
    got = fx.compute(fx.union_tail(tail, new), names, keep=["is_new"]).filter("is_new").toPandas().sort_values(["entity", "dt"]).reset_index(drop=True)
    want = computed[computed["dt"] >= DAY + dt.timedelta(days=140)].reset_index(drop=True)
    pd.testing.assert_frame_equal(got[names], want[names])


def test_panel_contracts(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 2, 3.0)], "entity int, dt int, close double")
    dense = densify(df)
    assert dense.count() == 4 and dense.filter("close is null").count() == 1
    y = {(r.entity, r.dt): r.y_ret_1d for r in with_returns(dense).collect()}
    assert y == {(1, 1): 1.0, (1, 2): None, (2, 1): None, (2, 2): None}
    with pytest.raises(ContractError):
        joined_one_to_one(df, df.filter("entity = 1"), KEYS.both)
    with pytest.raises(ContractError):
        joined_one_to_one(df.unionAll(df), df, KEYS.both)
    assert same_keys(df, df.withColumn("close", F.lit(0.0)), KEYS.both) and not same_keys(df, df.limit(2), KEYS.both)


def test_coverage(panel):
    got = {r.feature: r for r in fx.coverage(fx.compute(panel, ["ret_1", "ret_120"]), ["ret_1", "ret_120"]).collect()}
    assert got["ret_1"].nulls == 2 * 5 and got["ret_120"].rows == 300


def test_differences_by_a_tree_of_hashes(spark):
    """Only the branches that differ are exchanged: equal years stay where they are."""
    rows = [(e, dt.date(2018 + y, 1, 1 + k), float(e + k)) for e in range(40) for y in range(4) for k in range(20)]
    a = spark.createDataFrame(rows, "entity long, dt date, x double")
    hit = (F.col("entity") == 7) & (F.year("dt") == 2019)
    b = a.withColumn("x", F.when(hit & (F.dayofmonth("dt") == 3), None).otherwise(F.col("x"))).filter(~((F.col("entity") == 9) & (F.col("dt") == F.lit("2020-01-05").cast("date"))))
    assert sorted(tuple(r) for r in panel_ops.aligned_differences(a, b, KEYS.both, ["x"]).collect()) == [(7, dt.date(2019, 1, 3)), (9, dt.date(2020, 1, 5))]
    branches = panel_ops.differing_branches(a, b, KEYS.both, ["x"]).collect()
    assert {r._year for r in branches} == {2019, 2020} and len(branches) == 2
    kept = panel_ops._branch(a, "dt", "entity").join(panel_ops.differing_branches(a, b, KEYS.both, ["x"]), ["_year", "_bucket"], "left_semi")
    assert kept.count() < a.count() / 20
    assert panel_ops.aligned_differences(a, a.repartition(7), KEYS.both, ["x"]).isEmpty() and panel_ops.differing_branches(a, a.repartition(7), KEYS.both, ["x"]).isEmpty()
    assert not same_keys(a, b, KEYS.both) and same_keys(a, a.withColumn("x", F.lit(0.0)), KEYS.both) and not same_keys(a, a.unionAll(a.limit(1)), KEYS.both)
    # a null isn't the value that its hash leaves out, and keys of other types and nulls have branches too
    swapped = spark.createDataFrame([(1, None, 1.0, 2.0)], "entity long, dt date, x double, y double")
    assert panel_ops.aligned_differences(swapped, swapped.select("entity", "dt", F.lit(None).cast("double").alias("x"), "y"), KEYS.both, ["x", "y"]).count() > 0
    assert panel_ops.aligned_differences(spark.createDataFrame([("a", 20200101)], "e string, d int").withColumn("v", F.lit(1)), spark.createDataFrame([("a", 20200101)], "e string, d int").withColumn("v", F.lit(2)), ["e", "d"], ["v"]).count() == 1
