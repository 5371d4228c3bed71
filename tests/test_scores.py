"""Cross-sections, scores, recursion, blends."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import cross_section as cs
from strandline.operators import evaluate as ev
from strandline.operators import recursion as rc
from strandline.operators import screening as sc

# Pool and label sizes on both sides of each gate.
POOLS, LABELS = (99, 100, 99, 100, 101, 110), (29, 30, 99, 100, 100, 109)


def fixture():
    """Six dates of 120 entities at the gates' edges."""
    rng = random.Random(5)
    rows = []
    for d in range(6):
        for e in range(120):
            rows.append((f"{e:06d}", d + 1, rng.random() + e / 1000, rng.gauss(0, 0.02) if e < LABELS[d] else None, int(e >= POOLS[d])))
    return rows


def brute(rows):
    df = pd.DataFrame(rows, columns=["entity", "dt", "pred", "y", "flag"])
    ics, excess, top_ret, turn, before = [], [], [], [], None
    for _, g in df.groupby("dt"):
        known = g.dropna(subset=["y"])
        if len(known) >= 30:
            ics.append(known["pred"].rank().corr(known["y"].rank()))
        pool = known[known["flag"] == 0]
        if len(pool) >= 100:
            top = pool.sort_values(["pred", "entity"], ascending=[False, True]).head(max(len(pool) // 10, 1))
            excess.append(top["y"].mean() - pool["y"].mean())
            top_ret.append(top["y"].mean())
        pool = g[g["flag"] == 0]
        if len(pool) >= 100:
            now = set(pool.sort_values(["pred", "entity"], ascending=[False, True]).head(max(len(pool) // 10, 1))["entity"])
            if before is not None:
                turn.append(1 - len(now & before) / len(now | before))
            before = now
        else:
            before = None
    ic = np.array(ics)
    out = {"ic_mean": ic.mean(), "ic_std": ic.std(ddof=1), "icir": ic.mean() / ic.std(ddof=1), "ic_positive_ratio": (ic > 0).mean(), "annual_excess": np.mean(excess) * 252, "top1_annual_ret": np.mean(top_ret) * 252, "mean_turnover": np.mean(turn)}
    return out | {"final_score": 0.4 * out["ic_mean"] + 0.3 * out["annual_excess"] + 0.3 * (1 - out["mean_turnover"])}, (len(ics), len(excess), len(turn))


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(fixture(), "entity string, dt int, pred double, y_ret_1d double, flag_limit_up int")


def test_scores_at_the_gates(frame):
    want, sizes = brute(fixture())
    got = ev.summarise(frame).first().asDict()
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)
    assert (ev.daily_ic(frame).count(), ev.daily_excess(frame).count(), ev.daily_turnover(frame).count()) == sizes == (5, 3, 2)


def test_groups_are_scored_apart(frame):
    two = frame.withColumn("c", F.lit("a")).unionByName(frame.withColumn("c", F.lit("b")).withColumn("pred", -F.col("pred")))
    got = {r.c: r.asDict() for r in ev.summarise(two, groups=["c"]).collect()}
    one = ev.summarise(frame).first().asDict()
    assert all(math.isclose(got["a"][k], one[k], rel_tol=1e-12) for k in one) and math.isclose(got["b"]["ic_mean"], -one["ic_mean"], rel_tol=1e-9)


def test_a_constant_day_makes_the_mean_missing(frame):
    flat = frame.withColumn("pred", F.when(F.col("dt") == 3, 1.0).otherwise(F.col("pred")))
    r = ev.summarise(flat).first()
    assert r.ic_mean is None and r.icir == 0.0 and r.final_score is None and r.ic_positive_ratio is not None


def test_diagnostics(frame):
    got = {r.dt: r for r in ev.diagnostics(frame).collect()}
    assert [got[d].turnover_eligible for d in range(1, 7)] == [False, True, False, True, True, True]
    assert [got[d].turnover_compared for d in range(1, 7)] == [False, False, False, False, True, True]
    assert [got[d].ic_eligible for d in range(1, 7)] == [False, True, True, True, True, True] and got[6].top_n == 10
    assert ev.by_date(frame).count() == 6


def test_cross_section(spark):
    rows = [(e, d, [1.0, 1.0, 2.0, None][e] if d == 1 else 5.0 if d == 2 else None) for e in range(4) for d in (1, 2, 3)]
    long = cs.standardise(spark.createDataFrame(rows, "entity int, dt int, f double"), ["f"], min_group=3)
    got = {(r.entity, r.dt): (r.rank, r.zscore) for r in long.collect()}
    assert got[0, 1][0] == 0.5 and got[2, 1][0] == 1.0 and got[3, 1] == (None, None) and math.isclose(got[2, 1][1], math.sqrt(2))
    assert got[0, 2] == (0.625, 0.0) and got[0, 3] == (None, None)
    assert cs.wide(long, ["f"]).columns == ["entity", "dt", "f__rank", "f__zscore"]
    small = cs.standardise(spark.createDataFrame(rows, "entity int, dt int, f double"), ["f"], min_group=5)
    assert small.filter("rank is not null or zscore is not null").isEmpty()


def test_relevance(spark):
    df = spark.createDataFrame([(i, 1, float(v)) for i, v in enumerate([1, 1, 2, 3, 4, 5, 6, 7, 8, 9])], "entity int, dt int, y double")
    assert [r.g for r in df.withColumn("g", cs.relevance(F.col("y"), "dt", 5)).orderBy("entity").collect()] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    with pytest.raises(ValueError, match="bins"):
        cs.relevance(F.col("y"), "dt", 1)


def test_market(spark):
    rows = [(1, 1, 0.1, 0, 5.0), (2, 1, -0.1, 1, None), (3, 1, None, 0, 3.0), (1, 2, None, 0, None)]
    got = {r.dt: r for r in cs.market(spark.createDataFrame(rows, "entity int, dt int, ret_1 double, flag_limit_up int, amount double")).collect()}
    assert (got[1].market_count, got[1].valid_return_count, got[1].market_up_ratio, got[1].market_total_amount) == (3, 2, 0.5, 8.0)
    assert got[2].market_up_ratio is None and got[2].market_total_amount == 0.0 and got[2].market_std_ret_1 is None


# --- recursion ---


@pytest.fixture(scope="module")
def days(spark):
    rng = random.Random(2)
    rows = [(f"{e:06d}", d, rng.random(), int(rng.random() < 0.05)) for d in range(1, 7) for e in range(30)]
    return spark.createDataFrame(rows, "entity string, dt int, pred double, flag_limit_up int"), rows


def test_rank_ema(days):
    df, rows = days
    got = rc.rank_ema(df, 0.4).toPandas().sort_values(["entity", "dt"])
    pdf = pd.DataFrame(rows, columns=["entity", "dt", "pred", "flag"]).sort_values(["entity", "dt"])
    pdf["rank"] = pdf.groupby("dt")["pred"].rank(pct=True)
    want = pdf.groupby("entity")["rank"].transform(lambda s: s.ewm(alpha=0.4, adjust=False).mean())
    np.testing.assert_allclose(got["smoothed"], want, rtol=1e-12)
    first, rest = df.filter("dt <= 3"), df.filter("dt > 3")
    state = rc.last_state(rc.rank_ema(first, 0.4))
    again = rc.rank_ema(rest, 0.4, state=state).toPandas().sort_values(["entity", "dt"])
    np.testing.assert_allclose(again["smoothed"], got[got["dt"] > 3]["smoothed"], rtol=1e-12)
    with pytest.raises(ValueError, match="alpha"):
        rc.rank_ema(df, 0.0)


def test_rank_ema_of_long_histories(spark):
    """Many blocks, missing scores, several alphas at once: pandas' recursion, ranks taken once, no history in a row."""
    rng = random.Random(3)
    rows = [(e, d, rng.random() if rng.random() < 0.9 else None) for d in range(1500) for e in range(5)]
    df = spark.createDataFrame(rows, "entity int, dt int, pred double")
    found = rc.rank_ema(df, [1.0, 0.7, 0.01])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.count("LocalRelation") + plan.count("LogicalRDD") == 1
    got = found.toPandas().sort_values(["alpha", "entity", "dt"])
    for a, part in got.groupby("alpha"):
        want = part.groupby("entity")["rank"].transform(lambda s, a=a: s.dropna().ewm(alpha=a, adjust=False).mean().reindex(s.index).ffill())
        np.testing.assert_allclose(part["smoothed"], want, rtol=1e-11)


def test_hysteresis_joins_once(days):
    plan = rc.hysteresis(rc.rank_ema(days[0], 0.5), 0.3, min_pool=20)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("FlatMapGroupsInPandas") == 1


def test_hysteresis(days):
    df, rows = days
    smooth = rc.rank_ema(df, 0.5)
    got = rc.hysteresis(smooth, 0.3, min_pool=20).toPandas()
    before = set()
    for _, day in got.groupby("dt"):
        assert day["final"].is_unique
        pool = day[day["flag_limit_up"] == 0].sort_values(["smoothed", "entity"], ascending=[False, True])
        top = max(len(pool) // 10, 1)
        wide = set(pool.head(max(top, int(len(pool) * 0.3)))["entity"])
        now = set(pool.sort_values("final", ascending=False).head(top)["entity"])
        assert {e for e in before if e in wide} <= now or len(now) == top
        assert len(now & before) >= min(len(before & wide), top)
        before = now
    whole = rc.across_boundary(df.filter("dt <= 3"), df.filter("dt > 3"), 0.5, 0.3, min_pool=20).toPandas().sort_values(["entity", "dt"])
    np.testing.assert_allclose(whole["final"], got[got["dt"] > 3].sort_values(["entity", "dt"])["final"])
    with pytest.raises(ValueError, match="exit"):
        rc.hysteresis(smooth, 0.05)


def test_small_pools_reset_the_top_set():
    names, every = [f"e{i}" for i in range(20)], [True] * 20
    _, scores, top = rc.select_top(names, every, {"e3"}, 0.2, 10, 10)
    assert top == {"e3", "e0"} and scores[3] == 1.0 and scores[0] == 0.95 and len(set(scores)) == 20
    assert rc.select_top(names, every, {"e3"}, 0.2, 10, 21)[2] == set()
    _, scores, top = rc.select_top(names, [i != 0 for i in range(20)], {"e0"}, 0.2, 10, 10)
    assert "e0" not in top and scores[0] == 1.0


def test_future_leaves_scores_alone(days):
    df, _ = days
    changed = df.withColumn("pred", F.when(F.col("dt") > 4, -F.col("pred")).otherwise(F.col("pred")))
    a, b = (rc.hysteresis(rc.rank_ema(d, 0.5), 0.3, min_pool=20).filter("dt <= 4").select("entity", "dt", "final") for d in (df, changed))
    assert a.exceptAll(b).isEmpty()


def test_blend(spark, days):
    df, _ = days
    other = df.withColumn("pred", F.col("pred") * -3)
    same = ev.blend([df, other], [1.0, 0.0]).join(rc.rank_ema(df, 1.0).select("entity", "dt", "rank"), ["entity", "dt"])
    assert same.filter("abs(pred - rank) > 1e-12").isEmpty()
    scaled = ev.blend([df.withColumn("pred", F.exp("pred") * 100), other], [0.3, 0.7]).join(ev.blend([df, other], [0.3, 0.7]).withColumnRenamed("pred", "p"), ["entity", "dt"])
    assert scaled.filter("abs(pred - p) > 1e-12").isEmpty()
    for bad in ([0.5, 0.6], [1.5, -0.5], [1.0]):
        with pytest.raises(ValueError, match="weights"):
            ev.blend([df, other], bad)
    grid = ev.blend_grid([df, other, df], ev.simplex(3, 0.5))
    assert grid.count() == 6 * df.count()


def test_registered_grids_are_the_whole_ones():
    from strandline.plans import panel_queries as pq

    assert set(pq.ALPHAS) == {1.0, 0.9, 0.8, 0.7, 0.6, 0.5} and set(pq.EXITS) == {0.1, 0.125, 0.15} and len(pq.SIMPLEX) == 21


def test_simplex():
    assert len(ev.simplex(3, 0.2)) == 21 and all(abs(sum(v) - 1) < 1e-9 for v in ev.simplex(3, 0.2))
    with pytest.raises(ValueError, match="step"):
        ev.simplex(3, 0.3)


def test_summaries(spark):
    rows = [("a", f, s) for f, s in (("1", 1.0), ("2", 3.0))] + [("b", "1", 2.0)]
    df = spark.createDataFrame(rows, "candidate string, fold string, final_score double")
    got = {r.candidate: r for r in ev.over_folds(df, ["candidate"], ["final_score"]).collect()}
    assert got["a"].final_score_mean == 2.0 and math.isclose(got["a"].final_score_std, math.sqrt(2)) and got["b"].final_score_std is None
    assert ev.over_folds(df, ["candidate"], ["final_score"], population=True).filter("candidate = 'a'").first().final_score_std == 1.0
    assert ev.winner(ev.over_folds(df, ["candidate"], ["final_score"]), [("final_score_mean", False), ("candidate", True)]).first().candidate == "a"


# --- screening ---


def test_daily_rank_ic(spark):
    rng = random.Random(3)
    rows = [(e, d, y := rng.random(), y * 2 if e else None, -y + rng.random() / 10) for d in (1, 2) for e in range(40)]
    df = spark.createDataFrame(rows, "entity int, dt int, y_ret_1d double, good double, bad double")
    got = {(r.dt, r.feature): r for r in sc.daily_rank_ic(df, ["good", "bad"]).collect()}
    pdf = pd.DataFrame(rows, columns=["entity", "dt", "y", "good", "bad"])
    for d, g in pdf.groupby("dt"):
        for f in ("good", "bad"):
            want = g[f].rank(pct=True).fillna(0.5).corr(g["y"].rank(pct=True))
            assert math.isclose(got[d, f].ic, want, rel_tol=1e-9) and got[d, f].available_rows == (39 if f == "good" else 40)
    assert all(r.ic is None for r in sc.daily_rank_ic(df, ["good"], least=41).collect())
    s = {r.feature: r for r in sc.summarise(sc.daily_rank_ic(df, ["good", "bad"])).collect()}
    assert s["good"].ic_days == 2 and s["good"].positive_ratio == 1.0 and math.isclose(s["good"].coverage, 78 / 80)
    m = {(r.f1, r.f2): r.rank_corr for r in sc.rank_correlations(df, ["bad", "good"]).collect()}
    assert math.isclose(m["bad", "bad"], 1.0) and m["bad", "good"] < -0.8


def test_selection():
    rows = [{"feature": f, "ic_mean": v, "reasons": []} for f, v in (("a", 0.05), ("b", -0.09), ("c", 0.08), ("d", 0.01))] + [{"feature": "e", "ic_mean": 0.2, "reasons": ["coverage", "ic"]}]
    got = {r["feature"]: (r["reasons"], r["correlated_with"]) for r in sc.select(rows, {("b", "c"): -0.95}, dict.fromkeys("abcde", "x") | {"d": "y"}, most=3, per_family=2)}
    assert got == {"e": (["coverage", "ic"], None), "b": ([], None), "c": (["correlation"], "b"), "a": ([], None), "d": ([], None)}
    got = {r["feature"]: r["reasons"] for r in sc.select(rows, {("b", "c"): -0.95}, dict.fromkeys("abcde", "x"), most=1, per_family=1)}
    assert got["c"] == ["total", "family", "correlation"] and got["a"] == ["total", "family"]
    with pytest.raises(ValueError, match="no feature"):
        sc.select(rows[-1:], {}, {"e": "x"})


def test_ablation(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(e, 1, rng.random(), 0, rng.random(), rng.random(), rng.random()) for e in range(10)], "entity int, dt int, y_ret_1d double, flag_limit_up int, a double, b double, c double")
    got = sc.ablation(df, {"a": 1, "b": -1, "c": 1}, {"a": "x", "b": "x", "c": "y"})
    assert {r.candidate for r in got.select("candidate").distinct().collect()} == {"all", "only:x", "only:y", "drop:x", "drop:y"} and got.count() == 50


# --- the published check of the score ---

#: Fixed values of the published fixture: 120 entities on six dates; by date how many can be bought, how many have a label,
#: and the prediction of entity k. The label of entity k on date i is (k - 60) / 1000 + i / 10000.
PARITY_DATES = (20250102, 20250103, 20250106, 20250107, 20250108, 20250109)
PARITY_BUYABLE, PARITY_LABELLED = (99, 100, 99, 100, 101, 110), (29, 30, 99, 100, 100, 109)
PARITY_PREDICTIONS = (lambda k: float(k), lambda k: (k - 60) / 1000, lambda k: -(k - 60) / 1000, lambda k: float((k + 7) % 120), lambda k: float((k + 23) % 120), lambda k: math.sin(k / 7))
PARITY_SCORE = 2.550764


def test_published_score(spark):
    """The score that is published for the fixture, and what its dates are made to exercise."""
    rows = [
        (f"S{k:03d}", d, predicted(k), (k - 60) / 1000 + i / 10_000 if k < labelled else None, int(k >= buyable))
        for i, (d, buyable, labelled, predicted) in enumerate(zip(PARITY_DATES, PARITY_BUYABLE, PARITY_LABELLED, PARITY_PREDICTIONS, strict=True))
        for k in range(120)
    ]
    frame = spark.createDataFrame(rows, "entity string, dt int, pred double, y_ret_1d double, flag_limit_up int").repartition(5)
    assert ev.summarise(frame).first().final_score == pytest.approx(PARITY_SCORE, abs=5e-7)
    by = {PARITY_DATES.index(r.dt): r for r in ev.diagnostics(frame).collect()}
    assert [by[i].ic_eligible for i in range(6)] == [False, True, True, True, True, True]
    assert [by[i].portfolio_eligible for i in range(6)] == [False, False, False, True, True, True]
    assert by[5].top_n == 10 and ev.daily_turnover(frame).count() == 2 and by[5].turnover_pool == 110
