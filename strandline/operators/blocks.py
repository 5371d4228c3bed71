"""Products of wide frames with themselves, X'X by group, in blocks.

Each task multiplies the rows that it has (one product of matrices for each batch, group and tile), and hands on one row for
each group and tile; a tree of two aggregates sums these up. So the plan has the same size for any number of features, no
row is made for a pair of them, and what is shuffled is the size of the matrices. A tile is the product of two ranges of
columns together with their sums and their sums of squares, which is all that a correlation needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a tile; tasks that the first aggregate puts together; bytes of sums that a task holds at a time.
TILE, SALTS, HELD = 128, 64, 1 << 26


def tiles(k: int, size: int = TILE) -> list[tuple[int, int]]:
    return [(a, min(a + size, k)) for a in range(0, k, size)]


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def codes(batch: pa.RecordBatch, groups: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its group within the batch, and each group's first row."""
    code = np.zeros(batch.num_rows, np.int64)
    for g in groups:
        d = batch.column(g).dictionary_encode(null_encoding="encode")
        code = code * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _partial(groups: list[str], k: int, size: int, centre: float = 0.0):
    edges = tiles(k, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        fields, task = None, 0
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def told() -> pa.RecordBatch:
            columns = [pa.array([key[i] for key in held], fields.field(g).type) for i, g in enumerate(groups)]
            rest = [pa.array([key[len(groups) + i] for key in held], pa.int32()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*columns, *rest, pa.array([task % SALTS] * len(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], [*groups, "i", "j", "salt", "v"])

        size_held = 0
        for b in batches:
            if not b.num_rows:
                continue
            fields = b.schema
            x = _flat(b.column("x")).reshape(-1, k) - centre
            code, first = codes(b, groups)
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(first) + 1))
            for g, at in enumerate(first):
                rows = x[order[cuts[g] : cuts[g + 1]]]
                name = tuple(b.column(c)[int(at)].as_py() for c in groups)
                sums, squares = rows.sum(0), np.einsum("ij,ij->j", rows, rows)
                for i, (a, z) in enumerate(edges):
                    for j in range(i, len(edges)):
                        c, y = edges[j]
                        v = np.concatenate([[len(rows)], sums[a:z], squares[a:z], sums[c:y], squares[c:y], (rows[:, a:z].T @ rows[:, c:y]).ravel()])
                        key = (*name, i, j)
                        if key in held:
                            held[key] += v
                        else:
                            held[key] = v
                            size_held += v.nbytes
                if size_held > HELD:
                    yield told()
                    held.clear()
                    size_held = 0
        if held:
            yield told()

    return run


def _summed(by: list[str]) -> Callable[[pa.Table], pa.Table]:
    def add(t: pa.Table) -> pa.Table:
        v = np.zeros(len(t.column("v")[0]))
        for chunk in t.column("v").chunks:
            v += _flat(chunk).reshape(len(chunk), -1).sum(0)
        return t.slice(0, 1).select(by).append_column("v", pa.array([v], pa.list_(pa.float64())))

    return add


def products(df: DataFrame, x: Column, k: int, groups: list[str] | None = None, size: int = TILE, centre: float = 0.0) -> DataFrame:
    """groups, i, j, v: for each group and pair of tiles i <= j the rows' number, the sums and the sums of squares of the
    columns of i and of j, and the products of each column of i with each of j, added up. x: the k columns as an array of
    doubles without nulls, of which centre is subtracted.

    Groups that lie in many tasks, and the whole frame if there are no groups, are summed up in two steps."""
    own = groups or []
    kinds = dict(df.dtypes)
    rows = df.select(*own, x.alias("x"))
    named = "".join(f"`{g}` {kinds[g]}, " for g in own)
    part = rows.mapInArrow(_partial(own, k, size, centre), f"{named}i int, j int, salt int, v array<double>")
    some = part.groupBy(*own, "i", "j", "salt").applyInArrow(_summed([*own, "i", "j"]), f"{named}i int, j int, v array<double>")
    return some.groupBy(*own, "i", "j").applyInArrow(_summed([*own, "i", "j"]), f"{named}i int, j int, v array<double>")


def split(v: np.ndarray, wide: int, high: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tile's n, sums and squares of its i columns (wide of them), those of its j columns (high of them), products."""
    at = np.cumsum([1, wide, wide, high, high])
    return (float(v[0]), *np.split(v[1 : at[-1]], at[:-1][1:] - 1), v[at[-1] :].reshape(wide, high))


def correlations(df: DataFrame, x: Column, names: list[str], by: str, least: int, size: int = TILE) -> DataFrame:
    """x: an array with a column for each name. f1, f2 (f1 not behind f2 in names), rank_corr (the mean of the columns' correlations over the groups of `by` that
    have at least that many rows and in which neither column is constant), days (the number of these groups)."""
    k = len(names)
    edges = tiles(k, size)

    def daily(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for i, j, v in zip(b.column("i").to_pylist(), b.column("j").to_pylist(), b.column("v"), strict=True):
                (a, z), (c, y) = edges[i], edges[j]
                n, si, qi, sj, qj, xy = split(v.values.to_numpy(zero_copy_only=False), z - a, y - c)
                if n < least:
                    continue
                vi, vj = qi / n - (si / n) ** 2, qj / n - (sj / n) ** 2
                # a constant column leaves nothing but rounding
                live = (vi > 1e-13 * qi / n)[:, None] & (vj > 1e-13 * qj / n)[None, :]
                r = np.divide(xy / n - np.outer(si / n, sj / n), np.sqrt(np.outer(np.maximum(vi, 0), np.maximum(vj, 0))), out=np.zeros_like(xy), where=live)
                more = np.concatenate([r.ravel(), live.ravel().astype(float)])
                held[i, j] = held[i, j] + more if (i, j) in held else more
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int32()), pa.array([x[1] for x in held], pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["i", "j", "v"])

    def told(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        total, days = np.split(_summed(["i", "j"])(t).column("v")[0].values.to_numpy(), 2)
        (a, z), (c, y) = edges[i], edges[j]
        f1, f2 = (x.ravel() for x in np.meshgrid(np.arange(a, z), np.arange(c, y), indexing="ij"))
        at = np.flatnonzero((f1 <= f2) & (days > 0))
        return pa.table({"f1": [names[x] for x in f1[at]], "f2": [names[x] for x in f2[at]], "rank_corr": total[at] / days[at], "days": pa.array(days[at].astype(np.int64))})

    # ranks lie around a half; sums about zero leave a nearly constant column its digits
    parts = products(df, x, k, [by], size, 0.5).mapInArrow(daily, "i int, j int, v array<double>")
    return parts.groupBy("i", "j").applyInArrow(told, "f1 string, f2 string, rank_corr double, days long")


#: Features that are ranked together: a task holds this many columns of a date.
RANKED = 8
_MISSING = np.iinfo(np.int64).max


def _sortable(column: pa.Array) -> np.ndarray:
    """Integers in the order of the values, as Spark has it: both zeros are one value, NaN the largest; missing ones last."""
    x = column.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    bits = x.view(np.int64)
    out = bits ^ ((bits >> 63) & _MISSING)
    out[np.isnan(x)] = _MISSING - 1
    out[~column.is_valid().to_numpy(zero_copy_only=False)] = _MISSING
    return out


def _percentiles(x: np.ndarray, fill: float) -> np.ndarray:
    order = np.argsort(x)
    x = x[order]
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    ties = np.diff(np.r_[starts, len(x)])
    n = int(np.searchsorted(x, _MISSING))
    rank = np.repeat((starts + 1 + (ties - 1) / 2.0) / max(n, 1), ties)
    rank[n:] = fill
    out = np.empty(len(x))
    out[order] = rank
    return out


def ranks(df: DataFrame, features: list[str], entity: str, date: str, keep: tuple[str, ...] = (), fill: float = 0.5, size: int = RANKED) -> DataFrame:
    """keep, entity, date, ranks: an array with the percentile rank of each feature (by name) within its date; missing ones
    get fill. For many features: no row is made for a value.

    A task's rows are cut by date into blocks, whose columns go, as bytes, to the tasks that rank a date's values of a few
    features; ranks go back to their block. A task that ranks holds 8 bytes for each of its date's rows and features."""
    names, kinds = sorted(features), dict(df.dtypes)
    edges = tiles(len(names), size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        number = 0

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal number
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            code, first = codes(b, [date])
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(first) + 1))
            x = np.stack([_sortable(b.column(n)) for n in names])[:, order]
            rest = b.select([entity, *keep]).take(pa.array(order))
            days = b.column(date).take(pa.array(first))
            for g in range(len(first)):
                a, z = int(cuts[g]), int(cuts[g + 1])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as out:
                    out.write_batch(rest.slice(a, z - a))
                values = [sink.getvalue().to_pybytes(), *[x[i:j, a:z].tobytes() for i, j in edges]]
                yield pa.RecordBatch.from_arrays([days.take(pa.array([g] * len(values))), pa.array(range(-1, len(edges)), pa.int32()), pa.array([task << 32 | number] * len(values), pa.int64()), pa.array(values, pa.binary())], [date, "tile", "block", "v"])
                number += 1

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(h.nbytes for h in held) > HELD:
                yield from told()
                held.clear()
        if held:
            yield from told()

    def ranked(t: pa.Table) -> pa.Table:
        tile = t.column("tile")[0].as_py()
        if tile < 0:
            return t
        wide = edges[tile][1] - edges[tile][0]
        parts = [np.frombuffer(v.as_buffer(), np.int64).reshape(wide, -1) for v in t.column("v")]
        ends = np.cumsum([0, *(p.shape[1] for p in parts)])
        whole = np.stack([_percentiles(np.concatenate([p[i] for p in parts]), fill) for i in range(wide)])
        return t.set_column(t.schema.get_field_index("v"), "v", pa.array([whole[:, a:z].tobytes() for a, z in zip(ends, ends[1:], strict=False)], pa.binary()))

    def rows(t: pa.Table) -> pa.Table:
        t = t.sort_by("tile")
        v = t.column("v")
        rest = pa.ipc.open_stream(v[0].as_buffer()).read_all()
        x = np.concatenate([np.frombuffer(v[i + 1].as_buffer()).reshape(z - a, -1) for i, (a, z) in enumerate(edges)]).T
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(names), pa.int32()), pa.array(x.ravel()))
        return rest.append_column(date, t.column(date).take(pa.array([0] * len(x)))).append_column("ranks", lists)

    # in the order of keys, so that a task that runs again cuts the same blocks; rows of window functions have it already
    source = df.select(entity, date, *keep, *[F.col(f).cast("double").alias(f) for f in names]).sortWithinPartitions(entity, date)
    kind = f"`{date}` {kinds[date]}, tile int, block long, v binary"
    found = source.mapInArrow(cut, kind).groupBy(date, "tile").applyInArrow(ranked, kind)
    return found.groupBy(date, "block").applyInArrow(rows, "".join(f"`{c}` {kinds[c]}, " for c in (entity, *keep, date)) + "ranks array<double>")


def moments(df: DataFrame, features: list[Column], label: Column, groups: list[str] | None = None, size: int = TILE) -> DataFrame:
    """groups, n, sx, sy, sxx (upper triangle by rows), sxy: the sums that a linear fit needs, one row by group."""
    own, k = groups or [], len(features)
    kinds, edges = dict(df.dtypes), tiles(k + 1, size)

    def told(t: pa.Table) -> pa.Table:
        whole, sums, n = np.zeros((k + 1, k + 1)), np.zeros(k + 1), 0.0
        for i, j, v in zip(t.column("i").to_pylist(), t.column("j").to_pylist(), t.column("v").to_pylist(), strict=True):
            (a, z), (c, y) = edges[i], edges[j]
            n, sums[a:z], _, sums[c:y], _, whole[a:z, c:y] = split(np.array(v), z - a, y - c)
        lists = [pa.array([x], pa.list_(pa.float64())) for x in (sums[:k], whole[:k, :k][np.triu_indices(k)], whole[:k, k])]
        out = pa.table({"n": pa.array([int(n)], pa.int64()), "sx": lists[0], "sy": [float(sums[k])], "sxx": lists[1], "sxy": lists[2]})
        for p, g in enumerate(own):
            out = out.add_column(p, g, t.column(g).slice(0, 1))
        return out

    found = products(df, F.array(*[c.cast("double") for c in (*features, label)]), k + 1, own, size)
    named = "".join(f"`{g}` {kinds[g]}, " for g in own)
    found = found if own else found.withColumn("_all", F.lit(0))
    return found.groupBy(*(own or ["_all"])).applyInArrow(told, f"{named}n long, sx array<double>, sy double, sxx array<double>, sxy array<double>")
