"""Boosted trees on coded bins.

Each feature's value is coded once as the number of cuts below it, a byte, 255 if it is missing; a row's codes are one
binary value, kept with its label and running score. A tree grows leaf by leaf. A pass over the rows finds each row's
leaf from the codes, and each task adds up gradients, hessians and rows by (leaf, feature, code) into one array; a row for
each task is what it hands on, and the arrays are added up in salts before they reach the driver, which sees leaves x
features x codes numbers and no rows. Of two siblings only the smaller one is measured: the other is the parent's array
less the smaller's. Missing values go where the gain is larger, and that side is each split's default.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import SALTS, _flat, _summed

MISSING = 255


@dataclass
class Node:
    value: float = 0.0
    feature: str | None = None
    cut: float = 0.0
    missing_left: bool = True
    left: Node | None = None
    right: Node | None = None

    def column(self) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        goes = F.coalesce(F.col(self.feature) <= self.cut, F.lit(self.missing_left))
        return F.when(goes, self.left.column()).otherwise(self.right.column())


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Node] = field(default_factory=list)

    def score(self) -> Column:
        return sum((t.column() * self.rate for t in self.trees), F.lit(self.base))


def tree_table(trees: list[Node]) -> list[dict]:
    """A row for each node, parents first: tree, node, feature (null for a leaf), cut, missing_left, left, right, value."""
    out = []
    for t, root in enumerate(trees):
        rows: list[dict] = []

        def add(n: Node, rows: list[dict] = rows, t: int = t) -> int:
            row = {"tree": t, "node": len(rows), "feature": n.feature, "cut": n.cut if n.feature else None, "missing_left": n.missing_left if n.feature else None, "left": None, "right": None, "value": n.value}
            rows.append(row)
            if n.feature:
                row["left"], row["right"] = add(n.left), add(n.right)
            return row["node"]

        add(root)
        out += rows
    return out


def bin_edges(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), [k / bins for k in range(1, bins)], 10_000).alias(f) for f in features]).first()
    return {f: sorted(set(row[f] or [])) for f in features}


def coded(df: DataFrame, features: list[str], edges: dict[str, list[float]], keep: list[str]) -> DataFrame:
    """keep, and _code: a byte for each feature."""
    if any(len(edges[f]) >= MISSING for f in features):
        raise ValueError(f"a feature may have {MISSING - 1} cuts at most")
    cuts = [np.array(edges[f], float) for f in features]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.empty((b.num_rows, len(features)), np.uint8)
            for i, f in enumerate(features):
                x = b.column(f).to_numpy(zero_copy_only=False).astype(float)
                code[:, i] = np.where(np.isnan(x), MISSING, np.searchsorted(cuts[i], x))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array([r.tobytes() for r in code], pa.binary())], [*keep, "_code"])

    rows = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features if f not in keep])
    return rows.mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keep) + "_code binary")


def _codes(b: pa.RecordBatch, k: int) -> np.ndarray:
    column = b.column("_code")
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8)[at : at + b.num_rows * k].reshape(b.num_rows, k)


@dataclass
class _Split:
    """Rows of a leaf whose code in a feature is above `at` go to another leaf."""

    leaf: int
    feature: int
    at: int
    missing_left: bool
    to: int

    def right(self, code: np.ndarray) -> np.ndarray:
        c = code[:, self.feature]
        return np.where(c == MISSING, not self.missing_left, c > self.at)


def _leaves(code: np.ndarray, splits: list[_Split]) -> np.ndarray:
    """Each row's leaf; splits come in the order in which they were made."""
    leaf = np.zeros(len(code), np.int32)
    for s in splits:
        own = np.flatnonzero(leaf == s.leaf)
        leaf[own[s.right(code[own])]] = s.to
    return leaf


def histograms(df: DataFrame, k: int, width: int, splits: list[_Split], wanted: list[int], few: bool = False) -> dict[int, np.ndarray]:
    """For each wanted leaf an array (feature, code, (gradients, hessians, rows)); the last code is for missing values. few:
    df has no more than SALTS tasks, so that their rows needn't be added up before they reach the driver."""
    place = {leaf: i for i, leaf in enumerate(wanted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = np.zeros((k, 3, len(wanted) * width))
        slot = np.full(1 + max([*wanted, *(s.to for s in splits)]), -1)
        for leaf, i in place.items():
            slot[leaf] = i
        for b in batches:
            code = _codes(b, k)
            at = slot[_leaves(code, splits)]
            own = np.flatnonzero(at >= 0)
            if not len(own):
                continue
            at, code = at[own] * width, np.minimum(code[own], width - 1)
            weights = [b.column(c).to_numpy(zero_copy_only=False)[own] for c in ("_g", "_h")]
            for f in range(k):
                cell = at + code[:, f]
                for j, w in enumerate(weights):
                    out[f, j] += np.bincount(cell, w, out.shape[2])
                out[f, 2] += np.bincount(cell, minlength=out.shape[2])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SALTS], pa.int32()), pa.array([out.ravel()], pa.list_(pa.float64()))], ["salt", "v"])

    # each task has a row; SALTS of them reach the driver
    parts = df.select("_code", "_g", "_h").mapInArrow(run, "salt int, v array<double>")
    parts = parts if few else parts.groupBy("salt").applyInArrow(_summed(["salt"]), "salt int, v array<double>")
    total = np.zeros(k * 3 * len(wanted) * width)
    for r in parts.toArrow().column("v").chunks:
        total += _flat(r).reshape(len(r), -1).sum(0)
    cells = total.reshape(k, 3, len(wanted), width)
    return {leaf: cells[:, :, i].transpose(0, 2, 1) for leaf, i in place.items()}


def best_split(hist: np.ndarray, sizes: list[int], usable: list[int], ridge: float, least: int) -> tuple[float, int, int, bool] | None:
    """(gain, feature, code up to which rows go left, missing go left) of the largest gain; the first feature, the lowest
    code and then left win ties. sizes: cuts of each feature."""
    best = None
    for f in usable:
        g, h, n = hist[f, : sizes[f] + 1].T
        (gm, hm, nm), (gt, ht, nt) = hist[f, -1], hist[f].sum(0)
        gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
        for left in (True, False):
            a, b, c = (gl + gm, hl + hm, nl + nm) if left else (gl, hl, nl)
            ok = (c >= least) & (nt - c >= least)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, a**2 / (b + ridge) + (gt - a) ** 2 / (ht - b + ridge) - gt**2 / (ht + ridge), -np.inf)
            if len(gain) and np.isfinite(gain.max()) and gain.max() > 1e-12 and (best is None or gain.max() > best[0]):
                best = (float(gain.max()), f, int(gain.argmax()), left)
    return best


@dataclass
class _Leaf:
    node: Node
    hist: np.ndarray
    depth: int
    split: tuple[float, int, int, bool] | None = None


def grow_coded(df: DataFrame, features: list[str], edges: dict[str, list[float]], depth: int | None = 3, ridge: float = 1.0, least: int = 20, leaves: int | None = None, usable: list[str] | None = None, seen: list | None = None) -> tuple[Node, list[_Split], dict[int, float]]:
    """A tree on gradients _g and hessians _h of coded rows (leaf = -G / (H + ridge)), the split that gains most first, up
    to so many leaves (all of a full tree of this depth, if not told): its root, the splits by code, the leaves' values.

    One pass measures the smaller children of all leaves that could be split next, so there are about as many passes as
    levels. seen: gets how many leaves each pass measured."""
    k, sizes = len(features), [len(edges[f]) for f in features]
    width = max(sizes) + 2
    allowed = [features.index(f) for f in usable or features]
    most = leaves or 2 ** (depth or 5)
    seen = [] if seen is None else seen
    few = df.rdd.getNumPartitions() <= SALTS

    def leaf(hist: np.ndarray, level: int) -> _Leaf:
        g, h, _ = hist[0].sum(0)
        out = _Leaf(Node(float(-g / (h + ridge)) if h + ridge else 0.0), hist, level)
        out.split = best_split(hist, sizes, allowed, ridge, least) if depth is None or level < depth else None
        return out

    live = {0: leaf(histograms(df, k, width, [], [0], few)[0], 0)}
    seen.append(1)
    splits: list[_Split] = []
    ready: dict[int, tuple[_Split, _Leaf, _Leaf]] = {}
    number = 1
    while len(live) < most and (at := max((i for i, x in live.items() if x.split), key=lambda i: (live[i].split[0], -i), default=None)) is not None:
        if at not in ready:
            # children of every leaf that has a split and isn't measured yet: the smaller one, by the parent's counts
            wanted: dict[int, tuple[int, _Split, bool]] = {}
            trial = list(splits)
            for i, x in live.items():
                if x.split and i not in ready:
                    _, f, code, missing = x.split
                    s = _Split(i, f, code, missing, number)
                    number += 1
                    n = x.hist[f, :, 2]
                    small_left = 2 * (n[: code + 1].sum() + (n[-1] if missing else 0)) <= n.sum()
                    trial.append(s)
                    wanted[i if small_left else s.to] = (i, s, small_left)
            # leaves of unlike trials don't overlap, so one pass finds all of them
            found = histograms(df, k, width, trial, sorted(wanted), few)
            seen.append(len(wanted))
            for name, (i, s, small_left) in wanted.items():
                small, x = found[name], live[i]
                other = x.hist - small
                left, right = (small, other) if small_left else (other, small)
                ready[i] = (s, leaf(left, x.depth + 1), leaf(right, x.depth + 1))
        s, live[at], live[s.to] = ready.pop(at)
        splits.append(s)
    return _rooted(splits, live, features, edges), splits, {i: x.node.value for i, x in live.items()}


def _rooted(splits: list[_Split], live: dict[int, _Leaf], features: list[str], edges: dict[str, list[float]]) -> Node:
    """The tree from its splits and leaves."""
    nodes = {i: x.node for i, x in live.items()}
    for s in reversed(splits):
        f = features[s.feature]
        nodes[s.leaf] = Node(0.0, f, edges[f][s.at], s.missing_left, nodes[s.leaf], nodes.pop(s.to))
    return nodes[0]


def grow(df: DataFrame, features: list[str], edges: dict[str, list[float]], depth: int | None = 3, ridge_: float = 1.0, least: int = 20, leaves: int | None = None, seen: list | None = None) -> Node:
    """A tree on rows that aren't coded yet."""
    rows = coded(df, features, edges, ["_g", "_h"]).persist()
    try:
        return grow_coded(rows, features, edges, depth, ridge_, least, leaves, seen=seen)[0]
    finally:
        rows.unpersist()


def boost(
    df: DataFrame, features: list[str], rounds: int = 20, depth: int | None = 3, rate: float = 0.1, bins: int = 32, gradients=None, base: float | None = None, leaves: int | None = None, bagging: float = 1.0, feature_fraction: float = 1.0, seed: int = 0, checkpoint_every: int = 10, edges: dict[str, list[float]] | None = None,
) -> Boosted:
    """Gradient boosting; squared error unless gradients(frame with _score) adds _g and _h. bagging and feature_fraction: the
    shares of rows (by a hash of all their values and the round) and of features that a tree is grown on.

    The codes are made once, the running score is kept from round to round, so a round reads bytes and its plan holds its
    own tree only; where the session has a checkpoint folder, the rows are written there every few rounds, and a lost
    executor costs no more than these."""
    rng = np.random.default_rng(seed)
    rows = df
    if gradients is None:
        rows = rows.filter("y_ret_1d is not null")
        base = rows.agg(F.avg("y_ret_1d")).first()[0] or 0.0 if base is None else base
        gradients = lambda d: d.withColumns({"_g": F.col("_score") - F.col("y_ret_1d"), "_h": F.lit(1.0)})
    model = Boosted(base or 0.0, rate)
    rest = [c for c in df.columns if c not in features]
    rows = rows.withColumn("_row", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    edges = edges or bin_edges(rows, features, bins)
    rows = coded(rows, features, edges, [*rest, "_row"]).withColumn("_score", F.lit(model.base)).persist()
    saved = rows.sparkSession.sparkContext.getCheckpointDir() is not None
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    try:
        for k in range(rounds):
            used = sorted(rng.choice(features, max(1, round(feature_fraction * len(features))), replace=False).tolist())
            bag = rows if bagging >= 1 else rows.filter(F.pmod(F.xxhash64("_row", F.lit(seed), F.lit(k)), F.lit(1_000_000)) < round(bagging * 1_000_000))
            graded = gradients(bag).select("_code", F.col("_g").cast("double").alias("_g"), F.col("_h").cast("double").alias("_h")).persist()
            try:
                tree, splits, values = grow_coded(graded, features, edges, depth, leaves=leaves, usable=used)
            finally:
                graded.unpersist()
            model.trees.append(tree)
            if k + 1 < rounds:
                after = rows.mapInArrow(_scored(len(features), splits, values, rate), kinds)
                after = after.checkpoint() if saved and (k + 1) % checkpoint_every == 0 else after.persist()
                after.count()
                rows.unpersist()
                rows = after
        return model
    finally:
        rows.unpersist()


def _scored(k: int, splits: list[_Split], values: dict[int, float], rate: float):
    table = np.zeros(max(values) + 1)
    for leaf, v in values.items():
        table[leaf] = v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = b.column("_score").to_numpy(zero_copy_only=False) + rate * table[_leaves(_codes(b, k), splits)]
                yield b.set_column(b.schema.get_field_index("_score"), "_score", pa.array(score))

    return run
