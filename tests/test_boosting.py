"""Boosted trees on coded bins: against a brute force, siblings by subtraction, missing values."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import boosting as bo


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    x = pd.DataFrame({f"f{k}": rng.normal(size=3000).round(2) for k in range(5)})
    y = 2 * x["f0"] - (x["f1"] > 0.5) * 3 + x["f2"] * x["f3"] + rng.normal(size=3000) * 0.3
    for c in ("f0", "f3"):
        x.loc[rng.random(3000) < 0.2, c] = np.nan
    y[x["f0"].isna()] += 4
    return x.assign(y_ret_1d=y)


def frame(spark, rows):
    return spark.createDataFrame(rows.astype(object).where(rows.notna(), None), ", ".join(f"{c} double" for c in rows.columns)).repartition(5)


def brute(x, g, h, edges, names, leaves, depth, least, ridge=1.0):
    """A tree leaf by leaf, every split of every leaf tried on its rows: (leaf number of each row, its values, splits)."""
    leaf, level, values = np.zeros(len(x), int), {0: 0}, {}

    def best(rows):
        found = None
        for f in names:
            v = x[f].to_numpy()[rows]
            for cut in edges[f]:
                for missing in (True, False):
                    left = np.where(np.isnan(v), missing, v <= cut)
                    if min(left.sum(), (~left).sum()) < least:
                        continue
                    part = [(g[rows][m].sum() ** 2 / (h[rows][m].sum() + ridge)) for m in (left, ~left)]
                    gain = sum(part) - g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-9 * abs(gain)):
                        found = (gain, f, cut, missing)
        return found

    splits, count = {}, 1
    offers = {0: best(np.arange(len(x)))}
    while count < leaves:
        live = {k: o for k, o in offers.items() if o and (depth is None or level[k] < depth)}
        if not live:
            break
        k = max(live, key=lambda i: live[i][0])
        _, f, cut, missing = live[k]
        own = np.flatnonzero(leaf == k)
        v = x[f].to_numpy()[own]
        right = own[~np.where(np.isnan(v), missing, v <= cut)]
        leaf[right] = count
        splits[len(splits)] = (f, cut, missing)
        level[k] += 1
        level[count] = level[k]
        for i in (k, count):
            offers[i] = best(np.flatnonzero(leaf == i))
        count += 1
    for k in range(count):
        m = leaf == k
        values[k] = -g[m].sum() / (h[m].sum() + ridge)
    return np.array([values[k] for k in leaf]), list(splits.values())


@pytest.mark.parametrize("leaves,depth", [(2, None), (8, 3), (12, None), (31, None)])
def test_tree_equals_brute_force(spark, rows, leaves, depth):
    names = [f"f{k}" for k in range(5)]
    edges = {f: sorted(set(np.nanquantile(rows[f], np.arange(1, 12) / 12).round(3))) for f in names}
    g, h = -rows["y_ret_1d"].to_numpy(), np.ones(len(rows))
    want, splits = brute(rows, g, h, edges, names, leaves, depth, 20)
    df = frame(spark, rows).withColumns({"_g": -F.col("y_ret_1d"), "_h": F.lit(1.0)})
    seen = []
    tree = bo.grow(df, names, edges, depth, leaves=leaves, seen=seen)
    told = bo.tree_table([tree])
    assert sorted((r["feature"], r["cut"], r["missing_left"]) for r in told if r["feature"]) == sorted(splits)
    got = df.select(tree.column().alias("p"), *names).toPandas().sort_values(names, ignore_index=True)
    base = rows[names].assign(p=want).sort_values(names, ignore_index=True)
    np.testing.assert_allclose(got["p"], base["p"], rtol=1e-9)
    # one array for two children: half of what measuring both of each measured pair would take
    pairs = sum(seen) - 1
    assert pairs >= len(splits) - 1 and len(seen) <= 14


def test_subtraction_and_default_sides(spark, rows):
    df = bo.coded(frame(spark, rows).withColumns({"_g": F.col("y_ret_1d"), "_h": F.lit(2.0)}), ["f0", "f1"], {"f0": [0.0], "f1": [-1.0, 0.0, 1.0]}, ["_g", "_h"])
    s = bo._Split(0, 0, 0, False, 1)
    whole = bo.histograms(df, 2, 5, [], [0])[0]
    parts = bo.histograms(df, 2, 5, [s], [0, 1])
    np.testing.assert_allclose(parts[0] + parts[1], whole, rtol=1e-9)
    missing, below = rows["f0"].isna(), rows["f0"] <= 0
    assert parts[0][0, :, 2].tolist() == [int(below.sum()), 0, 0, 0, 0] and parts[1][0, -1, 2] == missing.sum()
    assert whole[1, :4, 2].tolist() == np.histogram(-rows["f1"], [-9, -1 - 1e-9, -1e-9, 1 - 1e-9, 9])[0][::-1].tolist()
    tree = bo.grow(frame(spark, rows).withColumns({"_g": -F.col("y_ret_1d"), "_h": F.lit(1.0)}), ["f0"], {"f0": [-0.5, 0.0, 0.5]}, depth=1)
    assert tree.feature == "f0" and tree.missing_left is False  # missing ones have large labels, like the right side


def test_boosting_lowers_the_loss(spark, rows):
    df = frame(spark, rows)
    names = [f"f{k}" for k in range(5)]
    model = bo.boost(df, names, rounds=12, leaves=15, depth=None, rate=0.3, bins=24)
    loss = lambda m: df.agg(F.avg((F.col("y_ret_1d") - m) ** 2)).first()[0]
    short = bo.Boosted(model.base, model.rate, model.trees[:4])
    assert loss(model.score()) < 0.7 * loss(short.score()) < 0.5 * loss(F.lit(model.base))
    constant = bo.boost(df.withColumns({n: F.lit(1.0) for n in names}), names, rounds=2)
    assert all(t.feature is None for t in constant.trees)
    with pytest.raises(ValueError, match="cuts"):
        bo.coded(df, ["f0"], {"f0": list(range(255))}, [])
