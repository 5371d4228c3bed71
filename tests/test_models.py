"""Splits, models, audits, stores, sources, streams."""

from __future__ import annotations

import datetime as dt
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import audits, models, splits, store
from strandline.operators.panel import ContractError
from strandline.sources import bars, files
from strandline.streaming import recursions

FOLDS = [splits.Fold("a", (1, 4), (5, 6)), splits.Fold("b", (1, 6), (7, 9))]


def test_calendar(spark):
    df = spark.createDataFrame([(e, d, None if d == 9 else 0.1) for d in range(1, 12) for e in range(3)], "entity int, dt int, y_ret_1d double")
    cal = splits.calendar(df, FOLDS, purge=2)
    got = {(r.fold, r.role): r for r in splits.fold_counts(df, cal).collect()}
    assert got["a", "train"].dates == 2 and got["a", "purged"].dates == 2 and got["b", "train"].dates == 4 and got["b", "validate"].unlabelled == 3
    assert splits.rows_of(df, cal, "validate", labelled=True).count() == 4 * 3
    assert splits.fingerprint(cal).count() == 2 and splits.disjoint(cal.filter("fold = 'a' and role = 'train'"), cal.filter("fold = 'a' and role = 'validate'"))


@pytest.mark.parametrize("folds, purge", [(FOLDS, 0), ([FOLDS[0], FOLDS[0]], 1), ([splits.Fold("a", (1, 5), (5, 6))], 1), ([FOLDS[0], splits.Fold("b", (2, 6), (7, 9))], 1), ([FOLDS[0], splits.Fold("b", (1, 6), (6, 9))], 1)])
def test_bad_folds(folds, purge):
    with pytest.raises(ContractError):
        splits.check(folds, purge, 1)


def linear(spark, n=600):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, 2))
    y = 3 + 2 * x[:, 0] - x[:, 1] + rng.normal(size=n) * 0.1
    rows = [(i % 30, i // 30, float(y[i]) if i % 50 else None, 0, float(x[i, 0]) if i % 7 else None, float(x[i, 1])) for i in range(n)]
    return spark.createDataFrame(rows, "entity int, dt int, y_ret_1d double, flag_limit_up int, f double, g double"), rows


def test_ridge(spark):
    df, rows = linear(spark)
    fit = models.ridge(models.gram(df, ["f", "g"]).first(), ["f", "g"], 5.0)
    known = [r for r in rows if r[2] is not None]
    x = np.array([[r[4] or 0.0, r[5]] for r in known])
    y = np.array([r[2] for r in known])
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 5 * np.eye(2), xc.T @ yc)
    np.testing.assert_allclose(fit.weights, w, rtol=1e-9)
    assert math.isclose(fit.intercept, y.mean() - x.mean(0) @ w, rel_tol=1e-9)
    folds = [splits.Fold("a", (0, 9), (10, 14)), splits.Fold("b", (0, 14), (15, 19))]
    out = models.ridge_folds(df, splits.calendar(df, folds), ["f", "g"], 5.0)
    assert out.count() == 300 and dict(out.dtypes)["pred"] == "float" and out.filter("pred is null").isEmpty()
    changed = models.ridge_folds(df.withColumn("y_ret_1d", F.when(F.col("dt") > 14, 99.0).otherwise(F.col("y_ret_1d"))), splits.calendar(df, folds), ["f", "g"], 5.0)
    assert out.select("fold", "entity", "dt", "pred").exceptAll(changed.select("fold", "entity", "dt", "pred")).isEmpty()


def test_boosting(spark):
    df, _ = linear(spark)
    model = models.boost(df, ["f", "g"], rounds=12, depth=2, rate=0.3)
    err = df.filter("y_ret_1d is not null").agg(F.avg(F.pow(F.col("y_ret_1d") - model.score(), F.lit(2.0))), F.var_pop("y_ret_1d")).first()
    assert err[0] < 0.35 * err[1]


def test_ranker(spark):
    df, _ = linear(spark)
    model = models.ranker(df, ["f", "g"], rounds=4, depth=2, rate=0.3)
    plain = models.ndcg(df.withColumn("pred", F.lit(0.0))).agg(F.avg("ndcg")).first()[0]
    assert models.ndcg(df.withColumn("pred", model.score())).agg(F.avg("ndcg")).first()[0] > plain + 0.05
    assert models.grades(df).agg(F.sum("rows")).first()[0] == 588


def test_simple_factor(spark):
    df = spark.createDataFrame([(0.2,), (None,)], "f double")
    assert [r.pred for r in models.simple_factor(df, "f", -1).collect()] == [-0.2, -0.5]


# --- audits ---

BAR = "entity string, dt int, open double, high double, low double, close double, vol double, amount double, flag_limit_up int"


def test_quality(spark):
    good = [("a", 1, 1.0, 2.0, 0.5, 1.5, 1.0, 1.0, 0), ("b", 1, 1.0, 2.0, 0.5, None, 1.0, 1.0, 1)]
    assert audits.quality(spark.createDataFrame(good, BAR)).first().passed
    bad = [good[0], good[0], ("c", 1, 1.0, 1.2, 0.5, 1.5, -1.0, 1.0, 2), ("d", 1, 1.0, 2.0, 1.2, 1.5, 1.0, -1.0, 0)]
    r = audits.quality(spark.createDataFrame(bad, BAR)).first()
    assert (r.duplicate_rows, r.ohlc_violations, r.negative_vol, r.negative_amount, r.flag_limit_up_violations, r.passed) == (2, 2, 1, 1, 1, False)


def test_alignment(spark):
    rows = [("a", 1, 10.0, 0.1), ("a", 2, 11.0, None), ("a", 3, None, None), ("a", 4, 12.0, None), ("b", 1, 5.0, 1.0), ("b", 2, 10.0, None)]
    df = spark.createDataFrame(rows, "entity string, dt int, close double, y_ret_1d double")
    got = {r.definition: r for r in audits.alignment(df).collect()}
    assert got["next_row"].matching == 2 and got["next_row"].mask_agreement == 1.0
    assert got["next_close"].matching == 2 and got["next_close"].label_missing_only == 1
    more = {r.definition: r for r in audits.alignment(df, future=spark.createDataFrame([("b", 3, 20.0)], "entity string, dt int, close double")).collect()}
    assert more["next_row"].label_missing_only == 1


def test_distribution(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,), (float("inf"),)], "y_ret_1d double")
    r = audits.distribution(df, quantiles=(0.01, 0.99)).first()
    assert (r.rows, r.present, r.missing, r.infinite) == (6, 4, 2, 1) and math.isclose(r.q01, 1.03) and math.isclose(r.q99, 9.79)


def test_consistency(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, None)], "entity string, dt int, x double")
    assert all(audits.consistency(df, df).values())
    assert not audits.consistency(df, df.withColumn("x", F.lit(3.0)))["missing"] and audits.consistency(df, df.drop("x")) == {"columns": False}


def test_submission(spark, tmp_path):
    good = spark.createDataFrame([("000001.SZ", 20250102, 0.1), ("600000.SH", 20250102, 1 / 3)], "ts_code string, trade_date int, pred float")
    audits.require_submission(good, good)
    out = str(tmp_path / "submission.csv")
    store.write_submission(good, good, out)
    with open(out, "rb") as f:
        data = f.read()
    assert data.startswith(b"ts_code,trade_date,pred\n") and b"\r" not in data and data.count(b"\n") == 3
    for bad in (good.unionAll(good), good.limit(1), good.withColumn("pred", F.lit(float("nan")).cast("float")), good.withColumn("ts_code", F.lit("x")), good.select("trade_date", "ts_code", "pred")):
        with pytest.raises(ContractError):
            audits.require_submission(bad, good)


def test_other_contracts(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert audits.schema_differences(df, ["a", "b"], {"b": "double"}) == [] and audits.schema_differences(df, ["b", "a"], {}) == ["order"]
    assert audits.schema_differences(df, ["c"], {}) == ["absent: c"] and audits.schema_differences(df, ["b"], {"b": "float"}) == ["type of b: double"]
    with pytest.raises(ContractError):
        audits.require_warm_up(121, 120)


# --- stores and sources ---


def test_year_store(spark, tmp_path):
    rows = [("a", dt.date(2019, 12, 31), 1.0), ("a", dt.date(2020, 1, 1), 2.0), ("b", dt.date(2020, 1, 1), None), ("b", dt.date(2021, 5, 5), 4.0)]
    df = spark.createDataFrame(rows, "entity string, dt date, x double")
    place = str(tmp_path / "store")
    told = store.write_years(df, place, start=dt.date(2020, 1, 1))
    assert told["rows"] == 3 and [y["year"] for y in told["years"]] == [2020, 2021] and told["missing"] == {"x": 1}
    assert sorted(d for d in os.listdir(place) if d.startswith("year=")) == ["year=2020", "year=2021"]
    with pytest.raises(FileExistsError):
        store.write_years(df, place)
    store.write_years(df, place, overwrite=True)
    assert spark.read.parquet(place).count() == 4
    with pytest.raises(ContractError):
        store.write_years(df.unionAll(df), str(tmp_path / "twice"))
    assert not os.path.exists(tmp_path / "twice")


def test_out_of_fold(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.2)], "entity string, dt int, pred double")
    assert store.save_out_of_fold(df, str(tmp_path / "oof"))["rows"] == 2
    for bad in (df.unionAll(df), df.withColumn("pred", F.lit(float("inf")))):
        with pytest.raises(ContractError):
            store.save_out_of_fold(bad, str(tmp_path / "bad"))
    order = spark.createDataFrame([("b", 1, 0), ("a", 1, 1)], "entity string, dt int, _order int")
    assert [r.entity for r in store.restore_order(order, df, ["entity", "dt"]).collect()] == ["b", "a"]
    with pytest.raises(ContractError):
        store.restore_order(order, df.limit(1), ["entity", "dt"])


def test_registry(spark):
    cols = "experiment_id string, record_type string, fold string, value string, created_at string"
    old = spark.createDataFrame([("e1", "fold", "1", "x", "t0")], cols)
    same = spark.createDataFrame([("e1", "fold", "1", "x", "t9"), ("e1", "fold", "2", "y", "t9")], cols)
    assert store.append(old, same).count() == 2
    for bad in ([("e1", "fold", "1", "z", "t0")], [("e2", "fold", "1", "a", "t"), ("e2", "fold", "1", "b", "t")]):
        with pytest.raises(ContractError):
            store.append(old, spark.createDataFrame(bad, cols))


def test_run_once(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    place = str(tmp_path / "x")
    assert [store.run_once(spark, place, {"a": k}, make).count() for k in (1, 1, 2)] == [3, 3, 3] and len(made) == 2


def test_files(tmp_path):
    p = str(tmp_path / "f.json")
    files.atomic_json(p, {"a": float("nan"), "b": [1, float("inf")]})
    with open(p) as f:
        assert json.load(f) == {"a": None, "b": [1, None]}
    q = str(tmp_path / "g")
    assert files.write_immutable(q, "x") and not files.write_immutable(q, "x")
    with pytest.raises(FileExistsError):
        files.write_immutable(q, "y")
    assert len(files.sha256(q)) == 64 and files.tree_sha256(str(tmp_path), "*") != files.tree_sha256(str(tmp_path), "*.json")


LINES = "ts_code,trade_date,open,high,low,close,vol,amount,flag_limit_up,flag_limit_down,y_ret_1d\n000001.SZ,20240102,1,2,0.5,1.5,10,15,0,0,0.1\n000001.SZ,20240103,1,2,0.5,,10,15,0,0,NaN\n000002.SZ,20250103,1,2,0.5,1.5,10,15,1,0,\n"


def test_bars(spark, tmp_path):
    path = str(tmp_path / "train.csv")
    files.atomic_text(path, LINES)
    df = bars.scan_csv(spark, path, True)
    assert df.schema == bars.schema(True) and df.filter("y_ret_1d is null").count() == 2
    cache = str(tmp_path / "cache")
    bars.load(spark, path, True, cache)
    assert bars.is_fresh(cache, path) and bars.load(spark, path, True, cache).count() == 3
    files.atomic_text(path, LINES + "000003.SZ,20250104,1,2,0.5,1.5,10,15,1,0,\n")
    assert not bars.is_fresh(cache, path) and bars.load(spark, path, True, cache).count() == 4
    with pytest.raises(FileNotFoundError, match="test"):
        bars.load(spark, str(tmp_path / "none.csv"), False)
    with pytest.raises(ContractError):
        bars.scan_csv(spark, path, True, columns=["nothing"])
    got = bars.scan(df, ["ts_code", "close", "ts_code"], [("trade_date", ">=", 20240103), ("flag_limit_up", "==", 1)])
    assert got.columns == ["ts_code", "close"] and got.count() == 2
    for args in ((["nothing"],), ([],), (["close"], [("close", "~", 1)])):
        with pytest.raises(ContractError):
            bars.scan(df, *args)
    assert bars.tail(df, 1).count() == 1 and bars.labelled_dates(df).count() == 1
    for n, exact in ((0, False), (9, True)):
        with pytest.raises(ContractError):
            bars.last_dates(df, n, exact=exact)


def test_pushdown(spark, tmp_path):
    """Columns and filters reach the Parquet scan, dates prune the years."""
    place = str(tmp_path / "p")
    path = str(tmp_path / "t.csv")
    files.atomic_text(path, LINES)
    bars.scan_csv(spark, path, True).withColumn("year", F.floor(F.col("trade_date") / 10000).cast("int")).write.partitionBy("year").parquet(place)
    plan = bars.scan(spark.read.parquet(place), ["close"], [("trade_date", ">=", 20250101)])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(trade_date,20250101)" in plan and "year#" in plan.split("PartitionFilters: ")[1].split("]")[0] and "ReadSchema: struct<trade_date:int,close:float>" in plan
    dates = spark.createDataFrame([(20240102,), (20240103,)], "trade_date int")
    assert bars.years(spark, place, ["ts_code", "trade_date", "close"], dates).count() == 2
    with pytest.raises(ContractError):
        bars.years(spark, place, ["ts_code", "trade_date"], spark.createDataFrame([(20240109,)], "trade_date int"))


# --- streams ---


def test_streams_equal_batches(spark, tmp_path):
    from strandline.operators import recursion

    rng = random.Random(8)
    rows = [("s", f"{e:03d}", d, rng.random(), int(rng.random() < 0.1)) for d in range(4) for e in range(25)]
    df = spark.createDataFrame(rows, "series string, entity string, dt int, smoothed double, flag_limit_up int")
    want = {(r.entity, r.dt): r.final for r in recursion.hysteresis(df, 0.3, min_pool=10).collect()}
    ranks = df.withColumnRenamed("smoothed", "pred")
    means = {(r.entity, r.dt): r.smoothed for r in recursion.rank_ema(ranks, 0.5).collect()}
    rank = recursion.rank_ema(ranks, 0.5).select("entity", "dt", "rank")
    src = tmp_path / "src"
    for d in range(4):
        df.filter(F.col("dt") == d).coalesce(1).write.mode("append").parquet(str(src / "a"))
        rank.filter(F.col("dt") == d).coalesce(1).write.mode("append").parquet(str(src / "b"))

    def run(path, schema, make, name):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
        q = make(s).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return spark.table(name).collect()

    got = {(r.entity, r.dt): r.final for r in run(src / "a", df.schema, lambda s: recursions.hysteresis(s, 0.3, min_pool=10), "tops")}
    assert got == want
    got = {(r.entity, r.dt): r.smoothed for r in run(src / "b", rank.schema, lambda s: recursions.rank_ema(s, 0.5), "means")}
    assert got.keys() == means.keys() and all(math.isclose(got[k], means[k], rel_tol=1e-12) for k in got)


# --- the ranker's gradients as streams ---


def _list(n, scores, seed=3):
    rng = np.random.default_rng(seed)
    score = np.sort(rng.integers(0, scores, n) / 8.0)[::-1]
    return score, rng.integers(0, 10, n), np.arange(n)


@pytest.mark.parametrize("scores", [1, 5, 100_000])
def test_first_rows_against_the_rest(scores):
    """Rows of one score count together; what both sides get is what the loop over pairs gives."""
    score, grade, pos = _list(3000, scores)
    top = models._Top(score[:200], grade[:200], np.arange(10.0), 1.0)
    f = top.among() + top.pulled(score[200:], grade[200:], pos[200:])
    g, h = top.pull(score[200:], grade[200:], pos[200:])
    unit = (1.0 if score[0] > score[-1] else 0.01) / (np.sort(grade)[::-1][:200] * models.log_discount(200)).sum()
    unit *= np.log2(1 + 2 * f[2].sum() * unit) / (2 * f[2].sum() * unit)
    want = models.pair_gradients(score, grade, 200)
    np.testing.assert_allclose(np.concatenate([f[0], g]) * unit, want[0], rtol=1e-7, atol=1e-14)
    np.testing.assert_allclose(np.concatenate([f[1], h]) * unit, want[1], rtol=1e-7, atol=1e-14)


def test_long_lists_need_no_join(spark):
    """Lists of any length: rows are exchanged by date, never joined to what they get, nor held as a group."""
    df = spark.range(1000).selectExpr("id as entity", "cast(id % 2 as int) as dt", "id / 7 as y_ret_1d", "cast(id % 5 as double) as _score", "cast(id % 10 as int) as _grade")
    plan = models.lambda_gradients_by_blocks()(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapGroups" not in plan and plan.count("Exchange hashpartitioning") == 2
