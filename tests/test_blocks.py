"""Sums of products by blocks: against numpy, by group, over tiles and tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import blocks, models
from strandline.operators import screening as sc


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1200, 119))
    x[rng.random(x.shape) < 0.05] = np.nan
    df = pd.DataFrame(x, columns=[f"f{k:03d}" for k in range(119)])
    df["entity"], df["dt"] = np.arange(1200) % 60, np.arange(1200) // 60
    df["y_ret_1d"] = np.where(rng.random(1200) < 0.1, np.nan, np.nan_to_num(x)[:, :3].sum(1) + rng.standard_normal(1200))
    return df


def spark_frame(spark, df):
    return spark.createDataFrame(df.astype(object).where(df.notna(), None), ", ".join(f"{c} {'long' if c in ('entity', 'dt') else 'double'}" for c in df.columns))


def test_ridge_on_119_features(spark, wide):
    """Products of matrices in several tasks and tiles: the fit that numpy finds, and that of the expressions on a few."""
    names = [c for c in wide if c.startswith("f")]
    df = spark_frame(spark, wide).repartition(7)
    fit = models.ridge(models.gram(df, names).first(), names, 10.0)
    rows = wide[wide["y_ret_1d"].notna()]
    x, y = rows[names].fillna(0).to_numpy(), rows["y_ret_1d"].to_numpy()
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c + 10.0 * np.eye(119), c.T @ (y - y.mean()))
    assert np.allclose(fit.weights, w, atol=1e-9) and np.isclose(fit.intercept, y.mean() - x.mean(0) @ w)
    scored = df.select(fit.score().alias("p"), "entity", "dt").toPandas().sort_values(["dt", "entity"])["p"].to_numpy()
    assert np.allclose(scored, wide.sort_values(["dt", "entity"])[names].fillna(0).to_numpy() @ w + fit.intercept)
    plan = models.gram(df, names)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60_000  # 7,140 sums would be a plan of many times this size


@pytest.mark.parametrize("k,size", [(3, 128), (7, 3), (119, 50), (24, 24)])
def test_blocks_equal_expressions(spark, wide, k, size):
    names = [f"f{j:03d}" for j in range(k)]
    df = spark_frame(spark, wide).withColumn("g", F.when(F.col("entity") % 3 > 0, F.col("entity") % 3)).repartition(5)
    kept = df.filter("y_ret_1d is not null")
    found = {r.g: r for r in blocks.moments(kept, [F.coalesce(F.col(n), F.lit(0.0)) for n in names], F.col("y_ret_1d"), ["g"], size).collect()}
    want = {r.g: r for r in models.gram(df, names, groups=["g"], wide=1000).collect()} if k < 50 else None
    for g, rows in wide[wide["y_ret_1d"].notna()].groupby(wide["entity"] % 3):
        r, x, y = found[g or None], rows[names].fillna(0).to_numpy(), rows["y_ret_1d"].to_numpy()
        assert r.n == len(rows) and np.allclose(r.sx, x.sum(0)) and np.isclose(r.sy, y.sum())
        assert np.allclose(r.sxx, (x.T @ x)[np.triu_indices(k)]) and np.allclose(r.sxy, x.T @ y)
        if want:
            assert np.allclose(want[g or None].sxx, r.sxx) and np.allclose(want[g or None].sxy, r.sxy)
    assert set(found) == {None, 1, 2}


@pytest.mark.parametrize("size", [128, 40])
def test_rank_correlations_of_147_features(spark, wide, size, monkeypatch):
    monkeypatch.setattr(sc, "correlations", lambda *a: blocks.correlations(*a, size))
    more = wide.drop(columns="y_ret_1d").assign(**{f"g{k:02d}": wide[f"f{k:03d}"] ** 2 + wide["f110"] for k in range(27)}, same=1.0)
    names = [c for c in more if c not in ("entity", "dt")]
    assert len(names) == 147
    found = sc.rank_correlations(spark_frame(spark, more).repartition(6), names, least=30).collect()
    ranks = more.groupby("dt")[sorted(names)].rank(pct=True).fillna(0.5).assign(dt=more["dt"])
    daily = np.array([d[sorted(names)].corr().to_numpy() for _, d in ranks.groupby("dt")])
    want = daily.mean(0)
    at = {n: k for k, n in enumerate(sorted(names))}
    assert len(found) == 146 * 147 // 2  # the constant one has no correlation
    assert max(abs(r.rank_corr - want[at[r.f1], at[r.f2]]) for r in found) < 1e-9 and {r.days for r in found} == {20}


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(e, d, float(e * d), float(e)) for e in range(10) for d in range(2)], "entity long, dt long, a double, b double")
    assert sc.rank_correlations(df, ["a", "b"], least=11).count() == 0
    assert {(r.f1, r.f2): (round(r.rank_corr, 9), r.days) for r in sc.rank_correlations(df, ["b", "a"], least=10).collect()} == {("a", "a"): (1.0, 1), ("a", "b"): (1.0, 1), ("b", "b"): (1.0, 2)}
    assert sc.rank_correlations(df.limit(0), ["a", "b"]).count() == 0 and models.gram(df.withColumn("y_ret_1d", F.lit(None)), ["a", "b"], wide=1).count() == 0


def test_ranks_are_exchanged_once(spark, wide):
    names = [f"f{k:03d}" for k in range(40)]
    rows = sc.rank_rows(spark_frame(spark, wide), names)
    rows.collect()
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # of the final and of the initial plan


def test_ranks_by_columns(spark):
    """Blocks of columns give the ranks that rows give, with ties, signed zeros, NaN and missing values; no row is made for
    a value and no window ranks."""
    rng = np.random.default_rng(9)
    values = [None, 0.0, -0.0, float("nan"), float("inf"), -1.5, 2.5]
    made = [(e, None if d == 3 else d, float(e), *[values[k] for k in rng.integers(0, 7, 10)]) for d in range(4) for e in range((50, 1, 20, 9)[d])]
    names = [f"f{k}" for k in range(10)]
    df = spark.createDataFrame(made, f"entity long, dt int, y double, {', '.join(f'{n} double' for n in names)}").repartition(3)
    told = lambda rows: sorted((r.entity, str(r.dt), r.y, r.ranks) for r in rows.collect())
    found = blocks.ranks(df, names, "entity", "dt", keep=("y",), size=4)
    assert told(found) == told(sc.rank_rows(df, names, keep=("y",)))
    assert blocks.ranks(df.limit(0), names, "entity", "dt").count() == 0
    wide = sc.rank_correlations(df.select("entity", "dt", *[F.col(names[k % 10]).alias(f"g{k}") for k in range(30)]), [f"g{k}" for k in range(30)])
    for plan in (x._jdf.queryExecution().executedPlan().toString() for x in (found, wide)):
        assert "Generate" not in plan and "Window" not in plan


def test_nearly_constant_ranks(spark):
    """A column in which all values tie and some are missing has two ranks close to a half; it correlates with itself by 1."""
    df = spark.range(60_000).select(F.col("id").alias("entity"), F.lit(1).alias("dt"), F.when(F.col("id") % 60 > 0, 0.0).alias("a"), F.col("id").cast("double").alias("b"))
    found = {(r.f1, r.f2): r.rank_corr for r in blocks.correlations(blocks.ranks(df, ["a", "b"], "entity", "dt"), F.col("ranks"), ["a", "b"], "dt", 30).collect()}
    assert abs(found["a", "a"] - 1) < 1e-9 and abs(found["b", "b"] - 1) < 1e-9
