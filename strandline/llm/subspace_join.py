"""Near duplicates of embeddings: a subspace pigeonhole join, all pairs of vectors whose cosine reaches a threshold.

A cosine of t between unit vectors is a squared distance of 2 - 2t. The vectors are turned by one random rotation, fixed by
its seed, which spreads their length evenly over all coordinates, and are split into blocks of BLOCK coordinates. A block's
budget is the part of that squared distance which its share of the coordinates deserves; if two vectors are within the
distance in all, they are within budget in some block. So each block is range joined by itself, and what the blocks find,
taken together, misses nothing.

Range join of a block: the first coordinate is cut into strips as wide as the block's radius, and each vector is a guest in
the strip above its own, so every pair within budget meets in exactly one strip of the block. Inside a strip the rows are
sorted by the second coordinate, which bounds the window that each tile of rows is compared with; a product of matrices gives
the tile's distances in the block. A strip with more than CHUNK rows is cut into chunks, and pairs of chunks are groups, so
that no task holds more than two. Coordinates are rounded to whole numbers (SCALE for the length of a vector), and budgets
are widened by what rounding can take away; sums and products of these numbers are exact, so each task judges a pair alike:
it belongs to the first block that has it within budget, and is verified there, once, by the cosine of the given vectors in
double precision. A tile hands on counts, and links only as far as they join rows that weren't joined: no row is made for a
pair.

Vectors that are equal are one class, compared once, with a weight. A hot group of near copies costs products of matrices.
The join is quadratic in what a strip holds; that is inherent to an exact answer where distances in low dimensions tell
little (vectors without structure). Each vector is sent twice for each block, and again for each chunk of its strip.

Rows: a vector that is null, empty, zero, or holds a null or a component that isn't finite, links with nothing and is a
component of its own. Only vectors of equal length are compared. Rows that repeat, and rows that share a vec_id, are vectors
of their own; a component takes its smallest vec_id that isn't null. Labels and other columns are ignored. Components of any
finite size are scaled by a power of two first. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, hot_join, lean
from .jaccard_join import GROUP, _groups

BLOCK, SCALE, SEED = 16, 2000, 20_011
CHUNK, TILE = 1 << 14, 512


@lru_cache(maxsize=4)
def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=16)
def blocks(size: int, threshold: float) -> tuple[tuple[tuple[int, int], ...], np.ndarray, np.ndarray]:
    """Coordinates from and to of each block, its squared radius in rounded coordinates, and its strips' width."""
    ends = np.linspace(0, size, max(1, math.ceil(size / BLOCK)) + 1).round().astype(int)
    spans = tuple(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
    wide = np.array([b - a for a, b in spans])
    radius = SCALE * np.sqrt((2 - 2 * threshold) * wide / size) * (1 + 1e-9) + np.sqrt(wide)
    return spans, np.floor(radius**2).astype(np.int64), np.ceil(radius).astype(np.int64)


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, key (a digest of the vector; null if it can't link) and raw (its components, scaled, as doubles)."""
    for b in batches:
        keys, raws = [], []
        for x in b.column(1):
            v = None if not x.is_valid or x.values.null_count or not len(x.values) else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            top = 0.0 if v is None else np.abs(v).max()
            if not (0 < top < np.inf):  # NaN too
                keys.append(None)
                raws.append(None)
                continue
            raw = (np.ldexp(v, -math.frexp(top)[1]) + 0.0).tobytes()
            raws.append(raw)
            keys.append(hashlib.blake2b(raw, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["vec_id", "key", "raw"])


def _place(threshold: float):
    """Of each class: the rounded, rotated vector and its strip in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rounded, strips = [], []
            for raw in b.column("raw").to_pylist():
                v = np.frombuffer(raw)
                spans, _, width = blocks(len(v), threshold)
                q = np.rint(rotation(len(v)) @ (v / math.sqrt(v @ v)) * SCALE).astype(np.int16)
                rounded.append(q.tobytes())
                strips.append(np.floor_divide(q[[a for a, _ in spans]].astype(np.int64), width).tolist())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("weight"), b.column("raw"), pa.array(rounded, pa.binary()), pa.array(strips, pa.list_(pa.int64()))], ["node", "weight", "raw", "rounded", "strips"])

    return run


def _exact(x: np.ndarray, y: np.ndarray) -> float:
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


class _Group:
    """Rows of one or two chunks of a strip."""

    def __init__(self, rows: pa.Table, threshold: float) -> None:
        cells = lambda c, kind: np.frombuffer(b"".join(rows.column(c).to_pylist()), kind).reshape(rows.num_rows, -1)
        raw = cells("raw", np.float64)
        self.node, self.weight = rows.column("node").to_numpy(), rows.column("weight").to_numpy()
        self.raw, self.unit = raw, raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]
        self.q = cells("rounded", np.int16).astype(np.float32)
        self.threshold, self.band = threshold, int(rows.column("band")[0].as_py())
        self.spans, self.budget, self.width = blocks(raw.shape[1], threshold)
        a, b = self.spans[self.band]
        self.own = np.ascontiguousarray(self.q[:, a:b])
        self.norm = np.einsum("ij,ij->i", self.own, self.own)
        self.second = self.own[:, min(1, b - a - 1)]
        self.links = np.zeros(rows.num_rows, np.int64)
        self.up = np.arange(rows.num_rows)

    def candidates(self, left: np.ndarray, right: np.ndarray, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows within the block's budget, tile by tile; within: of one set with itself, each pair once."""
        left, right = (x[np.argsort(self.second[x], kind="stable")] for x in (left, right))
        width, budget = self.width[self.band], np.float32(self.budget[self.band])
        there = self.second[right]
        for k in range(0, len(left), TILE):
            mine = left[k : k + TILE]
            a, b = np.searchsorted(there, self.second[mine[0]] - width), np.searchsorted(there, self.second[mine[-1]] + width, "right")
            a = max(a, k) if within else a
            for c in range(a, b, 8 * TILE):
                other = right[c : min(b, c + 8 * TILE)]
                apart = self.norm[mine][:, None] + self.norm[other] - 2 * (self.own[mine] @ self.own[other].T)
                p, q = np.nonzero(apart <= budget)
                if within:
                    once = c + q > k + p
                    p, q = p[once], q[once]
                if len(p):
                    yield mine[p], other[q]

    def verified(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which pairs have no earlier block within budget, and the cosine."""
        keep = np.ones(len(p), bool)
        for (a, b), budget in zip(self.spans[: self.band], self.budget, strict=False):
            at = np.flatnonzero(keep)
            apart = self.q[p[at], a:b] - self.q[q[at], a:b]
            keep[at] = np.einsum("ij,ij->i", apart, apart) > budget
        at = np.flatnonzero(keep)
        cos = np.einsum("ij,ij->i", self.unit[p[at]], self.unit[q[at]])
        keep[at] = cos >= self.threshold
        for k in at[np.abs(cos - self.threshold) < 1e-12]:
            keep[k] = _exact(self.raw[p[k]], self.raw[q[k]]) >= self.threshold
        return keep

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        """Counts the links, and unites the sets of rows that they join."""
        np.add.at(self.links, p, self.weight[q])
        np.add.at(self.links, q, self.weight[p])
        while True:
            a, b = self.up[p], self.up[q]
            new = a != b
            if not new.any():
                return
            p, q, a, b = p[new], q[new], a[new], b[new]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while (self.up[self.up] != self.up).any():
                self.up = self.up[self.up]


def _links(threshold: float):
    """node, links (weights of the classes linked to it here), root (a class of the group that links join it to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, t in _groups(batches, ["node", "weight", "raw", "rounded", "guest", "blk"]):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                rows = t.slice(a, b - a)
                guest, blk = rows.column("guest").to_numpy(), rows.column("blk").to_numpy()
                i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
                at = lambda g, k: np.flatnonzero((guest == g) & (blk == k))  # noqa: E731, B023
                sets = [(at(0, i), at(0, i), True), (at(1, i), at(0, i), False)] if i == j else [(at(0, i), at(0, j), False), (at(1, i), at(0, j), False), (at(0, i), at(1, j), False)]
                sets = [s for s in sets if len(s[0]) and len(s[1]) and (not s[2] or len(s[0]) > 1)]
                if not sets:
                    continue
                group = _Group(rows, threshold)
                for left, right, within in sets:
                    for p, q in group.candidates(left, right, within):
                        for k in range(0, len(p), 1 << 16):
                            keep = group.verified(p[k : k + (1 << 16)], q[k : k + (1 << 16)])
                            if keep.any():
                                group.join(p[k : k + (1 << 16)][keep], q[k : k + (1 << 16)][keep])
                hit = np.flatnonzero(group.links)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([pa.array(group.node[hit]), pa.array(group.links[hit]), pa.array(group.node[group.up[hit]])], ["node", "links", "root"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id that links reach, itself included),
    kept (vec_id is the component's). One row per row of vectors (vec_id, embedding). threshold: above 0, below 1."""
    lean(vectors.sparkSession)
    prepared = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_prepare, "vec_id long, key binary, raw binary")
    ids = cut(prepared.select("vec_id", "key"))
    classes = prepared.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("raw").alias("raw"))
    classes = cut(classes)  # then its rows have lasting numbers
    classes = classes.withColumn("node", F.monotonically_increasing_id())
    placed = cut(classes.select("node", "weight", "raw").mapInArrow(_place(threshold), "node long, weight long, raw binary, rounded binary, strips array<bigint>"))

    strips = placed.select("node", F.octet_length("raw").cast("long").alias("size"), F.posexplode("strips").alias("band", "strip"))
    # own strip, and guest in the next; strips of vectors of unlike length are kept apart
    own = F.explode(F.array(F.lit(0), F.lit(1))).alias("guest")
    lanes = strips.select("node", "band", "size", "strip", own).select("node", "band", (F.col("size") * (1 << 24) + F.col("strip") + F.col("guest")).alias("key"), "guest")
    held = lanes.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("guest")).alias("guests"))
    held = held.filter("n > 1 and guests < n").select("band", "key", F.ceil(F.col("n") / chunk).cast("int").alias("nb"))
    # a strip for each radius of a coordinate between -1 and 1: some thousand rows at the very most
    members = lanes.join(F.broadcast(held), ["band", "key"]).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    members = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    members = members.select("band", "key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "guest", "node")
    dealt = members.join(placed.select("node", "weight", "raw", "rounded"), "node").repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = cut(dealt.select(*GROUP, "blk", "guest", "node", "weight", "raw", "rounded").mapInArrow(_links(threshold), "node long, links long, root long"))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = classes.select("key", "node", "rep", "weight").join(links, "node", "left").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = cut(known.select("key", "rep", "weight", "component", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    # a component may hold a third of all classes, a class a third of all vectors
    lowest = known.filter("n_links > 0").groupBy("component").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("n"))
    low = hot_join(known.filter("n_links > 0"), lowest.select("component", "low"), ["component"], lowest.select("component", "n"))
    known = cut(low.unionByName(known.filter("n_links = 0").withColumn("low", F.col("rep"))).select("key", "n_links", F.col("low").alias("component_id"), "weight"))
    out = hot_join(ids.filter("key is not null"), known.select("key", "n_links", "component_id"), ["key"], known.select("key", F.col("weight").alias("n")))
    alone = ids.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    told = out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)
    return told.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
