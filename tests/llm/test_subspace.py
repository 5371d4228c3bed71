"""Near duplicates of embeddings against all pairs: groups, copies, hostile vectors, strips cut into chunks."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import subspace_join as sj

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=0.9):
    """(n_links, component_id) of each row, by its place."""
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v in rows]
    near = [[j for j, y in enumerate(units) if j != i and x is not None and y is not None and len(x) == len(y) and x @ y >= threshold] for i, x in enumerate(units)]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids, default=None)))
    return sorted(out, key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA).withColumns({"node": F.lit(1), "key": F.lit("x")}).repartition(5)
    found = sj.near_duplicates(df, **options).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=str)


def groups(rng, size, sizes, noise, alone=150):
    """Vectors around a center for each group, and others."""
    out = []
    for n, s in zip(sizes, noise, strict=True):
        c = rng.standard_normal(size)
        out += [c + s * np.linalg.norm(c) / math.sqrt(size) * rng.standard_normal(size) for _ in range(n)]
    out += list(rng.standard_normal((alone, size)))
    order = rng.permutation(len(out))
    return [(int(k), (out[i] * 10.0 ** rng.integers(-3, 4)).tolist()) for k, i in enumerate(order)]


@pytest.mark.parametrize("size,chunk", [(64, 40), (50, 1 << 14), (3, 50), (1, 64), (200, 1 << 14)])
def test_equals_all_pairs(spark, size, chunk):
    """Noise about the threshold: many pairs lie on either side of it; small chunks cut every strip."""
    rng = np.random.default_rng(size + chunk)
    rows = groups(rng, size, (60, 40, 30, 2, 3), (0.33, 0.1, 0.4, 0.2, 0.3), alone=100)
    want = brute(rows)
    assert got(spark, rows, chunk=chunk) == want and any(n for _, n, _ in want)


@pytest.mark.parametrize("threshold", [0.5, 0.99])
def test_thresholds(spark, threshold):
    rows = groups(np.random.default_rng(7), 48, (50, 30), (0.8, 0.12), alone=60)
    assert got(spark, rows, threshold=threshold, chunk=64) == brute(rows, threshold)


def test_copies_and_hostile_vectors(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal(8).tolist(), rng.standard_normal(8).tolist()
    rows = [(9, a), (4, a), (4, a), (None, a), (7, [2 * x for x in a]), (11, [-x for x in a]), (1, b), (2, [x + 1e-9 for x in b]), (20, None), (21, []), (22, [0.0] * 8), (23, [1.0, None, *a[2:]]), (24, [math.nan, *a[1:]]), (25, [math.inf, *a[1:]])]
    rows += [(30, a[:4]), (31, a[:4]), (32, [x * 1e-310 for x in a]), (33, [x * 1e300 for x in a]), (34, [0.0, -0.0, 1.0]), (35, [-0.0, 0.0, 1.0]), (None, None)]
    want = brute([(k, v) for k, v in rows if k != 32])
    # 32 has lost digits, but not its direction
    found = got(spark, [(k, v) for k, v in rows if k != 32])
    assert found == want
    assert got(spark, rows)[0][1] >= 0 and got(spark, []) == []


def test_exactly_at_the_threshold(spark):
    """A cosine of 0.6 and of 0.8 that doubles hold exactly is a link at that threshold, and none just above it."""
    rows = [(1, [5.0, 0.0]), (2, [3.0, 4.0]), (3, [4.0, 3.0]), (4, [-3.0, 4.0])]
    assert got(spark, rows, threshold=0.6) == brute(rows, 0.6)
    assert {r[0]: r[1] for r in got(spark, rows, threshold=0.8)} == {1: 1, 2: 1, 3: 2, 4: 0}


def test_hot_group_is_shared(spark):
    """A third of all vectors are near copies: no group of rows holds them all, and no row is made for a pair."""
    rng = np.random.default_rng(3)
    rows = groups(rng, 64, (700,), (0.05,), alone=1400)
    found = got(spark, rows, chunk=256)
    linked = [r for r in found if r[1]]
    assert len(linked) == 700 and all(r[1] == 699 and r[2] == min(x[0] for x in linked) for r in linked)


def test_budgets_miss_nothing():
    """By the pigeonhole: of vectors within the distance, some block is within its budget, rounding included."""
    rng = np.random.default_rng(11)
    for size in (2, 17, 64, 100, 768):
        spans, budget, _ = sj.blocks(size, 0.9)
        assert spans[0][0] == 0 and spans[-1][1] == size and all(1 <= b - a <= sj.BLOCK for a, b in spans)
        turn = sj.rotation(size)
        assert np.allclose(turn @ turn.T, np.eye(size))
        x = rng.standard_normal((300, size))
        x /= np.linalg.norm(x, axis=1)[:, None]
        d = rng.standard_normal((300, size))
        d -= (d * x).sum(1)[:, None] * x
        y = 0.9000001 * x + math.sqrt(1 - 0.9000001**2) * d / np.linalg.norm(d, axis=1)[:, None]
        p, q = (np.rint(z @ turn.T * sj.SCALE) for z in (x, y))
        apart = np.stack([((p - q)[:, a:b] ** 2).sum(1) for a, b in spans])
        assert (apart <= budget[:, None]).any(0).all()
