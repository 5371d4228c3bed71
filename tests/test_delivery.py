"""Saved models, refits, locked inference, and records of what was delivered; recursions over long series; joins with marks."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import audits, cross_section, delivery, evaluate, models, recursion
from strandline.operators import features as fx
from strandline.operators.panel import KEYS, ContractError, first_entities, key_hash, marked_join


@pytest.fixture(scope="module")
def view(spark):
    rng = np.random.default_rng(0)
    rows = [(e, d, float(rng.normal()), float(rng.normal()) if (e + d) % 11 else None, int(rng.random() < 0.05)) for d in range(1, 13) for e in range(60)]
    out = spark.createDataFrame(rows, "entity long, dt int, a double, b double, flag_limit_up int")
    return out.withColumn("y_ret_1d", F.when(F.col("dt") < 12, F.col("a") * 0.3 - F.coalesce("b", F.lit(0.0)) * 0.1 + F.sin(F.col("entity") * F.col("dt")))).cache()


def test_models_survive_their_file(view, tmp_path):
    ridge = models.ridge(models.gram(view, ["a", "b"]).first(), ["a", "b"])
    trees = models.boost(view, ["a", "b"], rounds=2, depth=2)
    for k, model in enumerate((ridge, trees)):
        path = str(tmp_path / f"m{k}.json")
        digest = delivery.save_model(model, path, rows=1)
        again = delivery.load_model(path, digest)
        assert delivery.model_state(again) == delivery.model_state(model)
        assert view.filter(~again.score().eqNullSafe(model.score())).count() == 0
        assert json.loads((tmp_path / f"m{k}.json").read_text())["about"] == {"rows": 1}
        with pytest.raises(ContractError, match="locked"):
            delivery.load_model(path, "0" * 64)
    with pytest.raises(ContractError, match="kind"):
        delivery.model_of({"kind": "other"})


def test_refit_and_locked_inference(view):
    parts = {"r": {"kind": "ridge", "features": ["a", "b"]}, "late": {"kind": "ridge", "features": ["a"], "since": 6}, "off": {"kind": "boosted", "features": ["a"]}}
    weights = {"r": 0.6, "late": 0.4, "off": 0.0}
    fitted = delivery.refit(view, parts, weights)
    assert sorted(fitted) == ["late", "r"]
    assert fitted["late"] == models.ridge(models.gram(view.filter("dt >= 6"), ["a"]).first(), ["a"])
    with pytest.raises(ContractError, match="no model"):
        delivery.infer(view, {"r": fitted["r"]}, weights)
    blended = delivery.infer(view, fitted, weights)
    whole = recursion.hysteresis(recursion.rank_ema(blended, 0.5), 0.3, min_pool=20).filter("dt > 8")
    locked = delivery.locked_inference(view.filter("dt <= 8"), view.filter("dt > 8"), fitted, weights, 0.5, 0.3, min_pool=20)
    got, want = ({(r.entity, r.dt): round(r.final, 9) for r in d.collect()} for d in (locked, whole))
    assert got == want and len(got) == 240


def test_records(tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.csv"
    a.write_text('{"rows": 3}')
    b.write_text("x,y\n1,2\n")
    told = delivery.evidence({"a": str(a), "b": str(b)}, {"a": ["rows"], "b": ["x"]})
    assert told == {"a": {"rows": 3}, "b": [{"x": "1", "y": "2"}]}
    with pytest.raises(ContractError, match="lacks"):
        delivery.evidence({"a": str(a)}, {"a": ["columns"]})
    made = delivery.delivery_manifest([str(a), str(b)], str(tmp_path / "manifest.json"), pages=8)
    assert made["files"]["a.json"]["bytes"] == 11 and made["pages"] == 8
    with pytest.raises(ContractError, match="missing"):
        delivery.delivery_manifest([str(tmp_path / "none")], str(tmp_path / "m2.json"))
    with delivery.unchanged(str(a)):
        pass
    with pytest.raises(ContractError, match="changed"), delivery.unchanged(str(a)):
        a.write_text("{}")
    assert delivery.git_state(str(tmp_path)) == {"commit": None, "dirty": None}
    delivery.require_contract({"ic_weight": 0.4, "days": 252, "pool_min": 100})
    with pytest.raises(ContractError, match="agreed"):
        delivery.require_contract({"days": 250})
    assert delivery.seeded(7).integers(1000) == delivery.seeded(7).integers(1000)
    log = delivery.logger("strandline.test", str(tmp_path / "log.txt"))
    assert delivery.logger("strandline.test", str(tmp_path / "log.txt")) is log and len(log.handlers) == 2


def test_probes_and_joins(view):
    got = {r.column: (r.rows, r.finite) for r in delivery.finite_probe(view, ["a", "b"]).collect()}
    first = view.filter("dt = 1").toPandas()
    assert got == {"a": (60, 60), "b": (60, int(first.b.notna().sum()))}
    assert {r[0] for r in first_entities(view, 3).select("entity").distinct().collect()} == {0, 1, 2}
    half = view.filter("entity < 10").select(*KEYS.both, F.lit(1).alias("z"))
    assert marked_join(view, half, KEYS.both).filter("matched").count() == 120 and marked_join(view, half, KEYS.both).count() == view.count()
    with pytest.raises(ContractError):
        marked_join(view, half.unionAll(half), KEYS.both)
    made = cross_section.augmented(view.select(*KEYS.both, "a"), view, ["b"])
    assert made.filter("b__rank is null").count() == 0 and made.count() == view.count()
    assert view.agg(key_hash(*KEYS.both)).first()[0] == view.repartition(7).agg(key_hash(*KEYS.both)).first()[0]


def test_definition_of_the_label(spark):
    rows = [(1, d, c) for d, c in enumerate([1.0, 2.0, None, 3.0, 6.0])] + [(2, d, 1.0 + d) for d in range(5)]
    df = spark.createDataFrame(rows, "entity long, dt int, close double")
    w = KEYS.by_entity()
    df = df.withColumn("y_ret_1d", F.lead("close").over(w) / F.col("close") - 1)
    assert audits.best_definition(audits.alignment(df)).first().definition == "next_row"
    # the definitions differ where the next close is missing, which is a disagreement with one of them
    assert [(r.entity, r.dt, r.next_row, r.next_close) for r in audits.mismatches(df, n=3).collect()] == [(1, 1, None, 0.5)]
    hurt = df.withColumn("y_ret_1d", F.when((F.col("entity") == 2) & (F.col("dt") < 2), 9.0).when((F.col("entity") == 2) & (F.col("dt") == 3), None).otherwise(F.col("y_ret_1d")))
    assert [(r.entity, r.dt) for r in audits.mismatches(hurt).collect()] == [(1, 1), (2, 0), (2, 1), (2, 3)]
    assert [(r.entity, r.dt) for r in audits.mismatches(hurt, n=2).collect()] == [(1, 1), (2, 0)]


def test_definition_goes_by_matching_rows(spark):
    """One definition matches more rows, the other a larger share of fewer: rows decide, then the mask, then the next row."""
    told = lambda *rows: spark.createDataFrame(rows, "definition string, matching long, match_rate double, mask_agreement double")
    best = lambda df: audits.best_definition(df).first().definition
    assert best(told(("next_row", 9, 1.0, 1.0), ("next_close", 10, 0.5, 0.2))) == "next_close"
    assert best(told(("next_row", 9, 0.1, 0.3), ("next_close", 9, 0.5, 0.2))) == "next_row"
    assert best(told(("next_close", 9, 0.5, 0.2), ("next_row", 9, 0.5, 0.2))) == "next_row"


def test_regimes_and_grids(view):
    daily = view.groupBy("dt").agg(F.avg("a").alias("market_mean_ret_1"), F.stddev_samp("a").alias("market_std_ret_1"))
    scored = view.withColumn("pred", F.col("a"))
    cuts = evaluate.regime_thresholds(daily, 3, 9)
    rows = daily.toPandas().sort_values("dt")
    part = rows[rows["dt"].between(3, 9)]
    assert cuts["low_volatility"] == pytest.approx(part["market_std_ret_1"].quantile(0.25)) and cuts["bullish_market"] == pytest.approx(part["market_mean_ret_1"].quantile(0.75))
    both = scored.withColumn("source", F.lit("up")).unionByName(scored.withColumns({"source": F.lit("down"), "pred": -F.col("a")}))
    got = {(r.source, r.regime): r for r in evaluate.regimes(both, daily.filter("dt <> 5"), cuts, least=(10, 20, 20), groups=["source"]).collect()}
    one = rows[rows["dt"] != 5]
    masks = {"all": rows["dt"] > -1, "low_volatility": one["market_std_ret_1"] <= cuts["low_volatility"], "high_volatility": one["market_std_ret_1"] >= cuts["high_volatility"], "bearish_market": one["market_mean_ret_1"] <= cuts["bearish_market"], "bullish_market": one["market_mean_ret_1"] >= cuts["bullish_market"]}
    assert {k: r.days for k, r in got.items()} == {(s, k): int(m.sum()) for s in ("up", "down") for k, m in masks.items()}
    by = {r.dt: r for r in evaluate.by_date(scored, least=(10, 20, 20)).collect()}
    low = [by[d] for d in one["dt"][masks["low_volatility"]]]
    r = got["up", "low_volatility"]
    assert r.ic_mean == pytest.approx(sum(x.ic for x in low) / len(low)) and got["down", "low_volatility"].ic_mean == pytest.approx(-r.ic_mean)
    assert r.score_proxy is None or r.score_proxy == pytest.approx(0.4 * r.ic_mean + 0.3 * r.annual_excess + 0.3 * (1 - r.mean_turnover))
    other = scored.withColumn("pred", -F.col("a"))
    grid = evaluate.two_model_grid(scored, other)
    labelled = grid.join(view.select(*KEYS.both, "y_ret_1d", "flag_limit_up"), KEYS.both)
    ends = {x.candidate: x.asDict() for x in evaluate.summarise(labelled.filter("candidate in (0, 20)"), groups=["candidate"], least=(10, 20, 20)).collect()}
    alone = [evaluate.summarise(m, least=(10, 20, 20)).first().asDict() for m in (scored, other)]
    for k, m in zip((0, 20), alone, strict=True):
        evaluate.require_replay({x: round(v, 9) for x, v in ends[k].items()}, {x: round(v, 9) for x, v in m.items()}, list(m))
    with pytest.raises(ValueError, match="reproduce"):
        evaluate.require_replay(ends[0], alone[1], ["ic_mean"])
    told = evaluate.grid_summary(labelled.sparkSession.createDataFrame([("x", 1.0, 2.0), ("x", 3.0, 4.0)], "c string, ic_mean double, final_score double"), ["c"], ["ic_mean"]).first()
    assert (told.ic_mean, told.final_score_worst) == (2.0, 2.0) and told.final_score_std == pytest.approx(2**0.5)


def test_long_series(spark):
    """Exponential means and rolling frames over series of many blocks, gaps among them, against pandas."""
    rng = np.random.default_rng(2)
    n = 1500
    close = np.where(rng.random(n) < 0.05, np.nan, 10 + rng.normal(size=n).cumsum() * 0.05)
    rows = [(1, d, None if np.isnan(x) else float(x)) for d, x in enumerate(close)]
    df = spark.createDataFrame(rows, "entity long, dt int, close double")
    got = recursion.ema_columns(df, "close", {"e": 20}).toPandas().sort_values("dt")
    want = pd.Series(close).ewm(span=20, min_periods=20, adjust=False).mean()
    assert np.allclose(got.e.to_numpy(float), want.to_numpy(), equal_nan=True)
    ranked = recursion.rank_ema(df.withColumn("pred", F.col("close")).filter("close is not null"), 0.4)
    assert ranked.filter("abs(smoothed - 1) > 1e-12").count() == 0
    with pytest.raises(ContractError, match="finite"):
        recursion.rank_ema(df.withColumn("pred", F.col("close")), 0.4, finite_only=True)
    frames = fx.Frames(KEYS.by_entity())
    whole = pd.Series(close)
    asked = {}
    for n_ in (1, 2, 7, 60, 100):
        for name, fn, theirs in (("avg", F.avg, "mean"), ("sum", F.sum, "sum"), ("max", F.max, "max"), ("min", F.min, "min"), ("std", F.stddev_samp, "std")):
            if n_ > 1 or name != "std":
                for lag in (0, 1):
                    asked[f"{name}{n_}_{lag}"] = (frames.full("close", fn, n_, lag), getattr(whole.rolling(n_), theirs)().shift(lag))
    out = frames.add_to(df).select("dt", *[x.alias(k) for k, (x, _) in asked.items()]).toPandas().sort_values("dt")
    for k, (_, theirs) in asked.items():
        assert np.allclose(out[k].to_numpy(float), theirs.to_numpy(float), equal_nan=True, atol=1e-9), k


def test_moments_of_flat_frames(spark):
    """A constant frame has no deviation, however it is put together, and so no correlation and no skewness."""
    df = spark.createDataFrame([(1, d, 0.1, float(d % 5)) for d in range(40)], "entity long, dt int, x double, z double")
    frames = fx.Frames(KEYS.by_entity())
    flat, skew, corr = frames.full("x", F.var_pop, 13), frames.full("x", F.skewness, 13), frames.correlation("x", "z", 13)
    rows = frames.add_to(df).select("dt", flat.alias("v"), skew.alias("s"), corr.alias("c")).collect()
    assert {r.v for r in rows if r.dt >= 12} == {0.0} and all(r.s is None and r.c is None for r in rows)


def test_pair_gradients():
    """Against a loop over pairs; blocks of any size give the same."""
    rng = np.random.default_rng(4)
    score, grade = rng.normal(size=40).round(1), rng.integers(0, 5, 40).astype(float)
    order = sorted(range(40), key=lambda i: (-score[i], i))
    for truncation, gains in ((1, None), (7, None), (100, None), (7, 2.0 ** np.arange(5) - 1)):
        gain = grade if gains is None else gains[grade.astype(int)]
        ideal = sum(x / np.log2(k + 2) for k, x in enumerate(sorted(gain, reverse=True)[:truncation]))
        g, h, total = np.zeros(40), np.zeros(40), 0.0
        for a in range(min(truncation, 40)):
            for b in range(a + 1, 40):
                i, j = order[a], order[b]
                if grade[i] == grade[j]:
                    continue
                up, down = (i, j) if grade[i] > grade[j] else (j, i)
                apart = score[up] - score[down]
                change = (gain[up] - gain[down]) * abs(1 / np.log2(a + 2) - 1 / np.log2(b + 2)) / ideal / (0.01 + abs(apart))
                p = 1 / (1 + np.exp(apart))
                g[up] -= change * p
                g[down] += change * p
                h[[up, down]] += change * p * (1 - p)
                total += 2 * change * p
        scale = np.log2(1 + total) / total
        for block in (1, 16, 256):
            got = models.pair_gradients(score, grade, truncation, block=block, gains=gains)
            assert np.allclose(got[0], g * scale) and np.allclose(got[1], h * scale)
    assert not models.pair_gradients(score, np.zeros(40), 10)[0].any()
    with pytest.raises(ValueError, match="gain"):
        models.lambda_gradients(bins=10, gains=np.arange(9))


@pytest.mark.parametrize("truncation, block", [(500, 7), (3, 5), (10, 1000)])
def test_gradients_of_long_lists(spark, truncation, block):
    """Lists in blocks, with the first rows as guests in each: the gradients of whole lists, ties and flat lists included."""
    rng = np.random.default_rng(truncation)
    rows = [(e, d, None if rng.random() < 0.1 else float(rng.normal()), 0.0 if d == 3 else round(float(rng.normal()), 1)) for d in range(5) for e in range((40, 1, 23, 30, 0)[d])]
    df = spark.createDataFrame(rows, "entity long, dt int, y_ret_1d double, _score double").repartition(3)
    whole, parts = (f(df).toPandas().sort_values(["dt", "entity"], ignore_index=True) for f in (models.lambda_gradients(truncation=truncation, bins=5), models.lambda_gradients_by_blocks(truncation=truncation, bins=5, block=block)))
    assert whole[["dt", "entity"]].equals(parts[["dt", "entity"]]) and whole["_g"].abs().max() > 0
    np.testing.assert_allclose(parts["_g"], whole["_g"], atol=1e-12)
    np.testing.assert_allclose(parts["_h"], whole["_h"], atol=1e-12)


def test_leaf_wise_growth(view):
    """A full tree is the same by leaves and by depth; fewer leaves keep the splits that gain most; bags are repeatable."""
    rows = view.filter("y_ret_1d is not null").withColumns({"_g": -F.col("y_ret_1d"), "_h": F.lit(1.0)}).cache()
    edges = models.bin_edges(rows, ["a", "b"], 16)
    count = lambda n: 1 if n.feature is None else count(n.left) + count(n.right)
    loss = lambda t: rows.agg(F.sum(F.pow(F.col("y_ret_1d") - t.column(), F.lit(2.0)))).first()[0]
    full, many, few, deep = (models.grow(rows, ["a", "b"], edges, **o) for o in ({"depth": 3}, {"depth": 3, "leaves": 100}, {"depth": 3, "leaves": 4}, {"depth": None, "leaves": 12, "least": 5}))
    # a small leaf may have no split to offer
    assert 4 < count(full) <= 8 and full == many and count(few) == 4 and count(deep) == 12
    assert loss(deep) < loss(full) < loss(few) < loss(models.Node(0.0))
    one, two = (models.boost(view, ["a", "b"], rounds=3, leaves=5, depth=None, bagging=0.7, feature_fraction=0.5, seed=1) for _ in range(2))
    assert delivery.model_state(one) == delivery.model_state(two)
    assert delivery.model_state(one) != delivery.model_state(models.boost(view, ["a", "b"], rounds=3, leaves=5, depth=None))
