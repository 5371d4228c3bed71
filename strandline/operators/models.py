"""Models on a panel: a plain factor, ridge by normal equations, a boosted ranker (the trees are in boosting.py).

Fits read the panel by aggregates (the Gram matrix, split histograms); what reaches the driver is sized by features and
bins, not by rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import filled, tie_rank

from .blocks import codes, moments
from .boosting import Boosted, Node, bin_edges, boost, grow, tree_table
from .cross_section import relevance
from .panel import KEYS, Keys

__all__ = ["Boosted", "Linear", "Node", "bin_edges", "boost", "grades", "gram", "grow", "lambda_gradients", "lambda_gradients_by_blocks", "ndcg", "nested_blend", "pair_gradients", "ranker", "ridge", "ridge_folds", "simple_factor", "tree_table"]


def simple_factor(df: DataFrame, feature: str, direction: int = 1, fill: float = 0.5) -> DataFrame:
    return df.withColumn("pred", direction * F.coalesce(F.col(feature).cast("double"), F.lit(fill)))


#: Features beyond which the sums are products of matrices in the tasks, and not an expression for each pair.
WIDE = 24


def gram(df: DataFrame, features: list[str], label: str = "y_ret_1d", groups: list[str] | None = None, wide: int = WIDE) -> DataFrame:
    """One row (by group): n, sums, products and products with the label, as arrays. A partial aggregate in every task;
    with many features, blocks of the matrix (then a frame without labelled rows gives no row)."""
    if len(features) > wide:
        return moments(df.filter(F.col(label).isNotNull()), [filled(F.col(f).cast("double"), 0.0) for f in features], F.col(label), groups)
    x = [filled(F.col(f).cast("double"), 0.0) for f in features]
    y = F.col(label).cast("double")
    pairs = [F.sum(a * b) for i, a in enumerate(x) for b in x[i:]]
    return df.filter(F.col(label).isNotNull()).groupBy(*(groups or [])).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(a) for a in x]).alias("sx"), F.sum(y).alias("sy"), F.array(*pairs).alias("sxx"), F.array(*[F.sum(a * y) for a in x]).alias("sxy"))


@dataclass(frozen=True)
class Linear:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        return sum((filled(F.col(f).cast("double"), 0.0) * w for f, w in zip(self.features, self.weights, strict=True)), F.lit(self.intercept))


def ridge(sums, features: list[str], penalty: float = 100.0) -> Linear:
    """From a row of gram(): the intercept isn't penalised, which centring achieves."""
    k, n = len(features), sums["n"]
    a = np.zeros((k, k))
    a[np.triu_indices(k)] = sums["sxx"]
    a = a + np.triu(a, 1).T
    sx, sxy = np.array(sums["sx"]), np.array(sums["sxy"])
    w = np.linalg.solve(a - np.outer(sx, sx) / n + penalty * np.eye(k), sxy - sx * sums["sy"] / n)
    return Linear(tuple(features), tuple(float(v) for v in w), float((sums["sy"] - sx @ w) / n))


def ridge_folds(df: DataFrame, fold_dates: DataFrame, features: list[str], penalty: float = 100.0, keys: Keys = KEYS) -> DataFrame:
    """Out-of-fold predictions: fold, keys, label, flag, pred (at float precision). One aggregate fits every fold."""
    train = df.join(fold_dates.filter("role = 'train'").select("fold", keys.date), keys.date)
    fits = {r["fold"]: ridge(r, features, penalty) for r in gram(train, features, groups=["fold"]).toLocalIterator()}
    rows = df.join(fold_dates.filter("role = 'validate'").select("fold", keys.date), keys.date)
    score = F.lit(None).cast("double")
    for name, fit in fits.items():
        score = F.when(F.col("fold") == name, fit.score()).otherwise(score)
    return rows.select("fold", *keys.both, "y_ret_1d", "flag_limit_up", score.cast("float").alias("pred"))


def linear_gain(grades: int = 10) -> np.ndarray:
    """A gain for each grade: the grade itself."""
    return np.arange(grades, dtype=float)


def log_discount(n: int) -> np.ndarray:
    """What a place counts for, from the first."""
    return 1 / np.log2(np.arange(n) + 2)


def pair_gradients(score: np.ndarray, grade: np.ndarray, truncation: int, sharpness: float = 1.0, block: int = 256, gains: np.ndarray | None = None, discounts=log_discount) -> tuple[np.ndarray, np.ndarray]:
    """LambdaRank's gradients and hessians of one list (Burges 2010): over the pairs of unlike grades of which the better
    ranked is among the first `truncation`, the pairwise logistic loss weighted by what swapping the two would change in
    NDCG. gains is a table by grade (the grade itself if not told), discounts gives one by place; ndcg() uses the same.
    Scaled by log2(1 + s) / s, s being the sum of the pairs' forces, so that long lists don't outweigh short ones. Pairs are
    taken a block of rows at a time."""
    n = len(score)
    order = np.argsort(-score, kind="stable")
    gains = linear_gain(int(grade.max(initial=0)) + 1) if gains is None else np.asarray(gains, float)
    s, gain = score[order].astype(float), gains[grade[order].astype(int)]
    discount = discounts(n)
    top = min(truncation, n)
    ideal = (np.sort(gain)[::-1][:top] * discount[:top]).sum()
    g, h, total = np.zeros(n), np.zeros(n), 0.0
    if ideal <= 0:
        return g, h
    spread = s.max() > s.min()
    for a in range(0, top, block):
        i = np.arange(a, min(a + block, top))[:, None]
        j = np.arange(n)[None, :]
        live = (j > i) & (gain[i] != gain[j])
        way = np.sign(gain[i] - gain[j])
        apart = way * (s[i] - s[j])
        change = np.abs(gain[i] - gain[j]) * np.abs(discount[i] - discount[j]) / ideal
        if spread:
            change = change / (0.01 + np.abs(apart))
        p = 1 / (1 + np.exp(np.clip(sharpness * apart, -500, 500)))
        force = np.where(live, sharpness * change * p, 0.0)
        bend = np.where(live, sharpness**2 * change * p * (1 - p), 0.0)
        g[i[:, 0]] -= (way * force).sum(axis=1)
        g += (way * force).sum(axis=0)
        h[i[:, 0]] += bend.sum(axis=1)
        h += bend.sum(axis=0)
        total += 2 * force.sum()
    if total > 0:
        scale = np.log2(1 + total) / total
        g, h = g * scale, h * scale
    out_g, out_h = np.empty(n), np.empty(n)
    out_g[order], out_h[order] = g, h
    return out_g, out_h


def lambda_gradients(keys: Keys = KEYS, bins: int = 10, sharpness: float = 1.0, truncation: int = 500, gains: np.ndarray | None = None):
    """Adds LambdaRank's gradients by date: a date's scores and grades are one Arrow group, truncation times its rows bounds
    the pairs, and no pair becomes a row. gains: a table with `bins` values."""
    table = linear_gain(bins) if gains is None else np.asarray(gains, float)
    if len(table) != bins:
        raise ValueError("a gain is needed for each grade")

    def add(df: DataFrame) -> DataFrame:
        graded = df.filter("y_ret_1d is not null").withColumn("_grade", relevance(F.col("y_ret_1d"), keys.date, bins))

        def run(pdf):
            pdf = pdf.sort_values(keys.entity)  # ties in the score go by entity
            g, h = pair_gradients(pdf["_score"].to_numpy(float), pdf["_grade"].to_numpy(), truncation, sharpness, gains=table)
            return pdf.drop(columns="_grade").assign(_g=g, _h=np.maximum(h, 1e-9))

        schema = f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, _g double, _h double"
        return graded.groupBy(keys.date).applyInPandas(run, schema)

    return add


#: Rows of a list that are taken at a time; distinct scores of a product of matrices.
LIST_ROWS, SCORES = 20_000, 1024


class _Top:
    """The first rows of a list, against rows that all come behind them. A pair's force is a factor of the two scores and
    grades times the difference of two discounts, so rows of one score and grade count together: as their number and the
    sum of their discounts."""

    def __init__(self, score: np.ndarray, grade: np.ndarray, gains: np.ndarray, sharpness: float):
        self.order = np.argsort(grade, kind="stable")
        self.s, self.grade, self.d = score[self.order], grade[self.order], log_discount(len(score))[self.order]
        self.better, self.sharpness = np.maximum(gains[:, None] - gains[None, :], 0.0), sharpness
        cuts = np.searchsorted(self.grade, np.arange(len(gains) + 1))
        self.parts = [(a, slice(cuts[a], cuts[a + 1])) for a in range(len(gains)) if cuts[a] < cuts[a + 1]]

    def _factors(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forces of pairs whose upper row has the better grade, or the worse one, and their bend, but for the gains,
        discounts and ideal."""
        apart = self.s[:, None] - u[None, :]
        whole = self.sharpness / (0.01 + apart)
        e = np.exp(-self.sharpness * apart)
        up = whole * e / (1 + e)
        return up, whole - up, self.sharpness * up / (1 + e)

    def pulled(self, score: np.ndarray, grade: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Gradients, hessians and forces (three rows) that the first rows, in their order, get from rows in falling score."""
        out, bins = np.zeros((3, len(self.s))), len(self.better)
        run = np.cumsum(np.r_[False, score[1:] != score[:-1]])
        u, cell = score[np.flatnonzero(np.r_[True, score[1:] != score[:-1]])], run * bins + grade
        n, d = (np.bincount(cell, w, len(u) * bins).reshape(-1, bins) for w in (None, 1 / np.log2(pos + 2)))
        for at in range(0, len(u), SCORES):
            here = slice(at, at + SCORES)
            up, down, bend = self._factors(u[here])
            for a, own in self.parts:
                of = lambda f, m, own=own, here=here: self.d[own] * (f[own] @ (n[here] @ m)) - f[own] @ (d[here] @ m)
                above, below = of(up, self.better[a]), of(down, self.better[:, a])
                out[:, own] += below - above, of(bend, self.better[a] + self.better[:, a]), above + below
        told = np.empty_like(out)
        told[:, self.order] = out
        return told

    def pull(self, score: np.ndarray, grade: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and hessians that rows in falling score get from the first ones."""
        g, h = np.empty(len(score)), np.empty(len(score))
        start = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        u, ends = score[start], np.r_[start, len(score)]
        for at in range(0, len(u), SCORES):
            factors = self._factors(u[at : at + SCORES])
            sums = np.zeros((3, len(self.better), 2, factors[0].shape[1]))
            for a, own in self.parts:
                w = np.stack([self.d[own], np.ones(own.stop - own.start)])
                for k, f in enumerate(factors):
                    sums[k, a] = w @ f[own]
            rows = slice(ends[at], ends[min(at + SCORES, len(u))])
            run = np.repeat(np.arange(factors[0].shape[1]), np.diff(ends[at : at + SCORES + 1]))
            both = np.tensordot(self.better.T, sums[0], 1) - np.tensordot(self.better, sums[1], 1), np.tensordot(self.better + self.better.T, sums[2], 1)
            for out, x in zip((g, h), both, strict=True):
                out[rows] = x[grade[rows], 0, run] - x[grade[rows], 1, run] / np.log2(pos[rows] + 2)
        return g, h

    def among(self) -> np.ndarray:
        """What pulled() gives, for the pairs among the first rows themselves."""
        score, grade, d = (np.empty_like(x) for x in (self.s, self.grade, self.d))
        score[self.order], grade[self.order], d[self.order] = self.s, self.grade, self.d
        out = np.zeros((3, len(d)))
        for at in range(0, len(d), 64):
            i = slice(at, at + 64)
            apart = np.maximum(score[i, None] - score[None, :], 0.0)
            up, down = self.better[grade[i]][:, grade], self.better[:, grade[i]].T[:, grade]
            swap = np.maximum(d[i, None] - d[None, :], 0.0) * (up + down) * self.sharpness / (0.01 + apart)  # 0 for rows that come before
            e = np.exp(-self.sharpness * apart)
            p = np.where(up > 0, e, 1.0) / (1 + e)
            force, bend = swap * p, self.sharpness * swap * p * (1 - p)
            way = np.sign(up - down) * force
            out[:, i] += -way.sum(1), bend.sum(1), force.sum(1)
            out[:2] += way.sum(0), bend.sum(0)
        return out


def _lists(batches: Iterator[pa.RecordBatch], date: str, most: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Batches sorted by date, cut into pieces of one date and at most so many rows; whether a piece begins a date."""
    last: tuple = ()
    for b in batches:
        if not b.num_rows:
            continue
        code, _ = codes(b, [date])
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:], strict=False):
            name = (b.column(date)[a].as_py(),)
            for at in range(a, z, most):
                yield name != last, b.slice(at, min(most, z - at))
                last = name


def lambda_gradients_by_blocks(keys: Keys = KEYS, bins: int = 10, sharpness: float = 1.0, truncation: int = 500, gains: np.ndarray | None = None, block: int = LIST_ROWS):
    """The same gradients for lists of any length. Every pair has a row among the first `truncation`. A date's rows stream
    through a task by falling score, as through a window function, and a task holds these first rows and a block: a first
    pass tells what the first rows get and the list's scale, in one row by date; this row comes before the date's others
    in a second pass, which tells what they get. No date is held, no row is joined. A column _grade, if there is one,
    is taken for the grades."""
    table = linear_gain(bins) if gains is None else np.asarray(gains, float)
    if len(table) != bins:
        raise ValueError("a gain is needed for each grade")

    def read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return b.column("_score").to_numpy(zero_copy_only=False).astype(float), b.column("_grade").to_numpy(zero_copy_only=False).astype(np.int64)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            s, c = np.concatenate(first, 1)
            g, h, f = sums + (top or _Top(s, c.astype(int), table, sharpness)).among()
            best = np.repeat(np.sort(table)[::-1], counts[np.argsort(table)[::-1]].clip(max=truncation))[:truncation]
            ideal = float((best * log_discount(len(best))).sum())
            unit = (1.0 if high > low else 0.01) / ideal if ideal > 0 else 0.0
            total = 2 * f.sum() * unit
            unit = unit * np.log2(1 + total) / total if total > 0 else unit
            return pa.RecordBatch.from_arrays([day, pa.array([np.concatenate([[unit], s, c, g * unit, h * unit])], pa.list_(pa.float64()))], [keys.date, "_first"])

        day, first, held, top, sums, counts, high, low = None, [], 0, None, 0.0, None, 0.0, 0.0
        for new, b in _lists(batches, keys.date, block):
            s, c = read(b)
            if new:
                if day is not None:
                    yield told()
                day, first, held, top, sums, counts, high = b.column(keys.date).slice(0, 1), [], 0, None, 0.0, np.zeros(bins, np.int64), s[0]
            low = s[-1]
            counts += np.bincount(c, minlength=bins)
            more = max(0, min(truncation - held, len(s)))
            if more:
                first.append(np.stack([s[:more], c[:more]]))
            pos = held + np.arange(len(s))
            held += len(s)
            if more < len(s):
                if top is None:
                    whole = np.concatenate(first, 1)
                    top = _Top(whole[0], whole[1].astype(int), table, sharpness)
                sums = sums + top.pulled(s[more:], c[more:], pos[more:])
        if day is not None:
            yield told()

    def graded_by(names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, top, at, unit = None, None, 0, 0.0
            for _, b in _lists(batches, keys.date, block):
                if b.column("_first").null_count < b.num_rows:  # the first row of a date
                    told = b.column("_first")[0].values.to_numpy(zero_copy_only=False)
                    unit, first, top, at = float(told[0]), told[1:].reshape(4, -1), None, 0
                    b = b.slice(1)
                    if not b.num_rows:
                        continue
                s, c = read(b)
                g, h = np.zeros(len(s)), np.zeros(len(s))
                own = max(0, min(first.shape[1] - at, len(s)))
                g[:own], h[:own] = first[2:, at : at + own]
                if own < len(s) and unit > 0:
                    top = top or _Top(first[0], first[1].astype(int), table, sharpness)
                    more = top.pull(s[own:], c[own:], (at + np.arange(len(s)))[own:])
                    g[own:], h[own:] = (x * unit for x in more)
                at += len(s)
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(g), pa.array(np.maximum(h, 1e-9))], [*names, "_g", "_h"])

        return run

    def add(df: DataFrame) -> DataFrame:
        kinds, names = dict(df.dtypes), df.columns
        rows = df.filter("y_ret_1d is not null")
        rows = rows if "_grade" in names else rows.withColumn("_grade", relevance(F.col("y_ret_1d"), keys.date, bins))
        by = [keys.date, F.col("_score").desc(), keys.entity]
        lists = rows.select(keys.date, keys.entity, "_score", "_grade").repartition(keys.date).sortWithinPartitions(*by)
        first = lists.mapInArrow(summed, f"`{keys.date}` {kinds[keys.date]}, _first array<double>")
        both = rows.unionByName(first, allowMissingColumns=True).repartition(keys.date)
        both = both.sortWithinPartitions(keys.date, F.col("_first").isNull(), *by[1:])
        return both.mapInArrow(graded_by(names), f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, _g double, _h double")

    return add


def ranker(df: DataFrame, features: list[str], keys: Keys = KEYS, truncation: int = 500, gains: np.ndarray | None = None, list_rows: int = LIST_ROWS, **options) -> Boosted:
    """Boosted trees on LambdaRank's gradients, for lists of any length. The rows are computed and graded once; only of a
    sample of rows are the grades that round's own."""
    way = lambda_gradients_by_blocks(keys, truncation=truncation, gains=gains, block=list_rows)
    rows = df.filter("y_ret_1d is not null")
    if options.get("bagging", 1.0) >= 1:
        rows = rows.select(*keys.both, "y_ret_1d", *features).withColumn("_grade", relevance(F.col("y_ret_1d"), keys.date))
    rows = rows.persist()
    try:
        return boost(rows, features, gradients=way, base=0.0, **options)
    finally:
        rows.unpersist()


def ndcg(df: DataFrame, keys: Keys = KEYS, bins: int = 10, at: int | None = None, score: str = "pred") -> DataFrame:
    """date, ndcg with the grade as gain."""
    graded = df.filter("y_ret_1d is not null").withColumn("_grade", relevance(F.col("y_ret_1d"), keys.date, bins))
    over = Window.partitionBy(keys.date)
    ranked = graded.withColumns({"_i": F.row_number().over(over.orderBy(F.col(score).desc(), keys.entity)), "_j": F.row_number().over(over.orderBy(F.col("_grade").desc(), keys.entity))})
    gain = lambda i: F.sum(F.when(F.lit(True) if at is None else F.col(i) <= at, F.col("_grade") / F.log2(F.col(i) + 1)))
    return ranked.groupBy(keys.date).agg(F.try_divide(gain("_i"), gain("_j")).alias("ndcg"))


def grades(df: DataFrame, keys: Keys = KEYS, bins: int = 10) -> DataFrame:
    """Rows by grade."""
    return df.filter("y_ret_1d is not null").select(relevance(F.col("y_ret_1d"), keys.date, bins).alias("grade")).groupBy("grade").agg(F.count(F.lit(1)).alias("rows"))


def nested_blend(df: DataFrame, scores: list[str], inner: tuple[float, float], outer: tuple[float, ...], keys: Keys = KEYS) -> DataFrame:
    """The first two scores are ranked by date and mixed, the mix and the others are ranked and mixed again. The inner mix
    is rounded to nine digits, so that sums that should tie do."""
    rank = lambda x: tie_rank(x, keys.date) / F.count(x).over(Window.partitionBy(keys.date))
    out = df.withColumns({f"_r{k}": rank(F.col(s)) for k, s in enumerate(scores)})
    out = out.withColumn("_sleeve", F.round(inner[0] * F.col("_r0") + inner[1] * F.col("_r1"), 9))
    out = out.withColumn("_r0", rank(F.col("_sleeve")))
    parts = [F.col("_r0"), *[F.col(f"_r{k}") for k in range(2, len(scores))]]
    return out.select(*df.columns, sum((w * p for w, p in zip(outer, parts, strict=True)), F.lit(0.0)).alias("pred"))
