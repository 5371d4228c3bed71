"""Whole runs: windows by folds, resumption, choice and refit, features of following dates."""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import delivery, evaluate, features, models, recursion, runs, splits, store
from strandline.operators.panel import KEYS, ContractError

DAY = dt.date(2015, 1, 5)


@pytest.fixture(scope="module")
def view(spark):
    rng = np.random.default_rng(8)
    rows = [(e, DAY + dt.timedelta(days=30 * d), *rng.normal(size=2).tolist()) for d in range(60) for e in range(40)]
    rows = [(*r, None if rng.random() < 0.05 else 0.5 * r[2] - 0.2 * r[3] + float(rng.normal()) * 0.1, int(rng.random() < 0.05)) for r in rows]
    return spark.createDataFrame(rows, "entity int, dt date, a double, b double, y_ret_1d double, flag_limit_up int").cache()


FOLDS = [splits.Fold(str(y), (dt.date(2015, 1, 1), dt.date(y - 1, 12, 31)), (dt.date(y, 1, 1), dt.date(y, 12, 31))) for y in (2017, 2018, 2019)]
WINDOWS = {"one": 1, "two": 2, "all": None}
LEAST = (20, 20, 20)


def test_windows_are_trailing_calendars(view):
    dates = splits.calendar(view, FOLDS)
    got = {(r.training, r.fold, r.dt, r.role) for r in runs.windowed(dates, WINDOWS).collect()}
    for name, years in WINDOWS.items():
        want = splits.trailing(dates, years) if years else dates
        assert {x[1:] for x in got if x[0] == name} == {(r.fold, r.dt, r.role) for r in want.select("fold", "dt", "role").collect()}


def test_out_of_fold_of_all_windows(view):
    dates = splits.calendar(view, FOLDS)
    out = runs.ridge_out_of_fold(view, runs.windowed(dates, WINDOWS), ["a", "b"], ["training", "fold"])
    whole = out.filter("training = 'all'").toPandas().sort_values(["fold", "dt", "entity"])
    want = models.ridge_folds(view, dates, ["a", "b"]).toPandas().sort_values(["fold", "dt", "entity"])
    np.testing.assert_allclose(whole["pred"], want["pred"], rtol=1e-6)
    assert out.groupBy("training", "fold").count().count() == 9
    both = runs.variants(out, ["training", "fold"], 0.5, 0.3, min_pool=20)
    one = both.filter("variant = 'turnover' and training = 'one' and fold = '2018'").toPandas().sort_values(["dt", "entity"])
    alone = out.filter("training = 'one' and fold = '2018'")
    held = recursion.hysteresis(recursion.rank_ema(alone, 0.5), 0.3, min_pool=20).toPandas().sort_values(["dt", "entity"])
    np.testing.assert_allclose(one["pred"], held["final"])
    scores = evaluate.summarise(both, groups=["training", "variant", "fold"], least=LEAST)
    told = runs.comparison(scores, ["training", "variant"], ["final_score", "ic_mean", "mean_turnover"], {"final_score": 1.0}).collect()
    assert len(told) == 6 and all(r.final_score_delta == pytest.approx(r.final_score_mean - 1) and r.final_score_worst <= r.final_score_mean for r in told)
    by = {(r.training, r.variant): r for r in told}
    assert all(by[w, "turnover"].mean_turnover_mean < by[w, "raw"].mean_turnover_mean for w in WINDOWS)


def test_matrix_resumes_after_a_kill(spark, view, tmp_path):
    calls = []

    def fit(rows):
        calls.append(1)
        if len(calls) == 5:
            raise RuntimeError("killed")
        return models.ridge(models.gram(rows, ["a", "b"]).first(), ["a", "b"])

    build = lambda version="1", **k: runs.rerun(spark, str(tmp_path / "m"), view, splits.calendar(view, FOLDS), WINDOWS, fit, version, 0.5, k.pop("exit", 0.3), least=LEAST, min_pool=20)
    with pytest.raises(RuntimeError):
        build().run()
    made = build().run()
    assert len(calls) == 10 and made[-2:] == ["variants", "scores"] and len(made) == 5 + 2
    scores = build().result("scores").toPandas()
    assert len(scores) == 18 and build().run() == [] and len(calls) == 10
    assert build(exit=0.2).run() == ["variants", "scores"] and len(calls) == 10
    direct = runs.variants(runs.ridge_out_of_fold(view, runs.windowed(splits.calendar(view, FOLDS), WINDOWS), ["a", "b"], ["training", "fold"]), ["training", "fold"], 0.5, 0.3, min_pool=20)
    want = evaluate.summarise(direct, groups=["training", "variant", "fold"], least=LEAST).toPandas()
    key = ["training", "variant", "fold"]
    np.testing.assert_allclose(scores.sort_values(key)["ic_mean"], want.sort_values(key)["ic_mean"], atol=1e-6)


def test_finalize(spark, view, tmp_path):
    summary = spark.createDataFrame([(0, 1.0, 0.2), (1, 2.0, 0.3), (2, 2.0, 0.1)], "candidate int, final_score double, mean_turnover double")
    criteria = [("final_score", False), ("mean_turnover", True)]
    weights = lambda c: {"slow": 1.0 if c == 2 else 0.5, "unused": 0.0}
    parts = {"slow": {"kind": "ridge", "features": ["a", "b"]}, "unused": {"kind": "nonsense", "features": []}}
    chosen = runs.finalize(summary, criteria, "candidate", weights, view, parts, select_only=True)
    assert chosen["selected"]["candidate"] == 2 and "models" not in chosen and not os.listdir(tmp_path)
    told = runs.finalize(summary, criteria, "candidate", weights, view, parts, str(tmp_path))
    assert list(told["models"]) == ["slow"] and delivery.load_model(str(tmp_path / "slow.json"), told["digests"]["slow"]) == told["models"]["slow"]
    with pytest.raises(ContractError):
        runs.finalize(summary.limit(0), criteria, "candidate", weights, view, parts, select_only=True)


def test_features_of_following_dates(spark):
    rng = np.random.default_rng(3)
    rows = [(e, DAY + dt.timedelta(days=d), *(float(x) for x in np.sort(rng.uniform(9, 11, 4))), float(rng.integers(100, 900)), float(rng.integers(1000, 9000))) for d in range(60) for e in range(3)]
    bars = spark.createDataFrame([(e, d, p[1], p[3], p[0], p[2], v, a) for e, d, *p, v, a in rows], "entity int, dt date, open double, high double, low double, close double, vol double, amount double")
    cut = DAY + dt.timedelta(days=50)
    old, new = bars.filter(F.col("dt") < F.lit(cut)), bars.filter(F.col("dt") >= F.lit(cut))
    names = ["ret_5", "close_ma_ratio_20", "ret_std_20"]
    make = lambda b: features.compute(b, names)
    got = runs.following_features(old, new, make, 40).toPandas().sort_values(["entity", "dt"])
    want = make(bars).filter(F.col("dt") >= F.lit(cut)).toPandas().sort_values(["entity", "dt"])
    np.testing.assert_allclose(got[names], want[names])
    assert len(got) == 30
    for h, n, k in ((bars, new, 40), (old, new.withColumn("y_ret_1d", F.lit(1.0)), 40), (old, new.unionAll(new.limit(1)), 40), (old, new, 51), (old, new.limit(0), 40)):
        with pytest.raises(ContractError):
            runs.following_features(h, n, make, k)


def test_registration_and_contract(spark, tmp_path):
    log = store.Registry(spark, str(tmp_path / "r"))
    scores = spark.createDataFrame([("1", 0.5, 2.0), ("2", 1.5, None)], "fold string, ic_mean double, final_score double")
    assert runs.register(log, "e1", scores, told="now") == 1 and runs.register(log, "e1", scores, told="later") is None
    assert {(r.record_type, r.fold) for r in log.rows().collect()} == {("fold", "1"), ("fold", "2"), ("mean", "all")}
    with pytest.raises(ContractError):
        runs.register(log, "e1", scores.withColumn("ic_mean", F.lit(9.0)))
    delivery.require_contract({"days": 252, "digest": delivery.score_digest()})
    with pytest.raises(ContractError):
        delivery.require_contract({"digest": "0" * 64})
