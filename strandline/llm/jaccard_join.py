"""N-gram Jaccard join with Bayesian candidate pruning.

Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

1. A pass over the texts gives each a MinHash signature of 128 16-bit values and a 64-bit key of its shingle set. Texts
   with the same set (exact copies and such that differ in case or white space) are one class from here on.
2. The first 96 values form 24 bands of four. Classes that agree on a band are candidates; at similarity 0.8 a pair
   agrees on none with probability 3e-6. A large bucket is cut into blocks, and each pair of blocks is a group of its
   own, so no task holds more than two blocks and no row is made for a pair.
3. In each group, a pair belongs to the first band that it agrees on. Its signatures are compared 16 values at a time;
   when the posterior probability (uniform prior) that the similarity reaches the threshold falls below 1e-7, the pair
   is dropped (the incremental test of BayesLSH, Satuluri and Parthasarathy 2012).
4. The shingle sets of what is left are fetched, the rest of the pairs are verified exactly, and each group returns, for
   each class with a link, the number of its links there and one edge to the smallest class it hangs together with.

Words are runs of anything but ASCII white space, in lower case. A text of one to four words has one shingle, all its
words. A null or empty text (or one of white space) has none: it links with nothing, not even with another of its kind.
Repeated rows are copies; a null doc_id is kept and never represents a class that has others. Other columns don't matter.
"""

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import boxed, components, cut, hot_join, lean, same_document, sieved

VALUES, BANDS = 128, 24
LONGS = VALUES // 4
SEEDS = tk.stream(2 * VALUES, 3)


def fewest_matches(threshold: float, tolerance: float, step: int = 16) -> dict[int, int]:
    """By the number n of values compared: the fewest matches m at which P(similarity >= threshold | m of n) is at least
    tolerance. With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is P(Bin(n + 1, t) <= m)."""
    out = {}
    for n in range(step, VALUES + 1, step):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                out[n] = m
                break
    return out


def set_keys(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key for each set of hashes."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, tk.U64)
        np.cumsum(tk.mix(values ^ tk.U64(0x51ED270B)), out=sums[1:])
        return tk.mix(sums[ends[1:]] - sums[ends[:-1]] ^ np.diff(ends).astype(tk.U64)).view(np.int64)


def signatures(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """MinHash signatures of sets that aren't empty, a row of 128 16-bit values each."""
    out = np.empty((len(ends) - 1, VALUES), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(VALUES):
            low = np.minimum.reduceat((values ^ SEEDS[2 * k]) * (SEEDS[2 * k + 1] | tk.U64(1)), ends[:-1])
            out[:, k] = tk.mix(low) >> tk.U64(48)
    return out


def longs(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), rows.shape[1]).cast(pa.list_(pa.int64()))


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.texts_of(batch.column("text"), lower=True)
            for a, part in texts.slices():
                found, owner = tk.shingles(tk.words(part), n)
                values, ends = tk.distinct(found, owner, len(part))
                sizes = np.diff(ends)
                full = np.flatnonzero(sizes)
                sig = np.zeros((len(part), LONGS), np.int64)
                if len(full):
                    sig[full] = np.ascontiguousarray(signatures(values, np.append(ends[full], ends[-1]))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, len(part)), batch.column("text_key").slice(a, len(part)), pa.array(set_keys(values, ends)), pa.array(sizes.astype(np.int32)), longs(sig)],
                    ["doc_id", "text_key", "cid", "size", "sig"],
                )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in tk.texts_of(batch.column("text"), lower=True).slices():
                found, owner = tk.shingles(tk.words(part), n)
                values, ends = tk.distinct(found, owner, len(part))
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(values, ends)), pa.LargeListArray.from_arrays(ends, values.view(np.int64)).cast(pa.list_(pa.int64()))], ["cid", "shingles"])

    return run


GROUP = ["band", "key", "i", "j"]


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[list[np.ndarray], pa.Table]]:
    """Runs of rows with equal GROUP, of rows sorted by it: the groups' bounds and the rows, many groups at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in GROUP]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        same = bool(held) and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in GROUP)
        if held and not same:
            yield _bounds(held, names)
            held = []
        if not len(new):
            held.append(batch)
            continue
        yield _bounds([*held, batch.slice(0, int(new[-1]))], names)
        held = [batch.slice(int(new[-1]))]
    if held:
        yield _bounds(held, names)


def _bounds(batches: list[pa.RecordBatch], names: list[str]):
    t = pa.Table.from_batches(batches).combine_chunks()
    keys = [t.column(c).to_numpy() for c in GROUP]
    cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
    return np.concatenate([[0], cuts, [t.num_rows]]), t.select([*GROUP, *names])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    at = column.offsets.to_numpy()
    return column.values.to_numpy()[at[0] : at[-1]], at - at[0]


def _pairs(a: int, b: int, sides: np.ndarray | None, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows a to b - 1, at most about `most` at a time; with sides, those from one side to the other only."""
    left, right = (np.arange(a, b), None) if sides is None else (a + np.flatnonzero(~sides), a + np.flatnonzero(sides))
    step = max(1, most // max(1, b - a))
    for k in range(0, len(left), step):
        x = left[k : k + step]
        if right is None:
            p, q = np.repeat(x, b - a), np.tile(np.arange(a, b), len(x))
            yield p[p < q], q[p < q]
        elif len(right):
            yield np.repeat(x, len(right)), np.tile(right, len(x))


def _survive(sig: np.ndarray, band: np.ndarray, p: np.ndarray, q: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs belong to their band and aren't pruned."""
    agree = sig[p, :BANDS] == sig[q, :BANDS]
    alive = np.flatnonzero(agree.argmax(axis=1) == band)
    small = sig.view(np.uint16).reshape(len(sig), VALUES)
    matches = np.zeros(len(alive), np.int32)
    done = 0
    for n, m in least.items():
        matches += (small[p[alive], done:n] == small[q[alive], done:n]).sum(axis=1, dtype=np.int32)
        alive, matches, done = alive[matches >= m], matches[matches >= m], n
    return alive


def _candidates(bounds: np.ndarray, t: pa.Table, sig: np.ndarray, least: dict[int, int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Surviving pairs: first and last + 1 row that they may lie in, then both rows. Small groups are taken many at once."""
    band, side = t.column("band").to_numpy(), t.column("blk").to_numpy() != t.column("i").to_numpy()
    cross = t.column("i").to_numpy() != t.column("j").to_numpy()
    sizes = np.diff(bounds)
    plain = ~cross[bounds[:-1]]
    for n in np.unique(sizes[plain & (sizes <= 64)]):
        if n < 2:
            continue
        starts = bounds[:-1][plain & (sizes == n)]
        p, q = np.triu_indices(n, 1)
        for k in range(0, len(starts), max(1, (1 << 16) // len(p))):
            some = starts[k : k + max(1, (1 << 16) // len(p))]
            pp, qq = (some[:, None] + p).ravel(), (some[:, None] + q).ravel()
            alive = _survive(sig, band[pp], pp, qq, least)
            base = np.repeat(some, len(p))[alive]
            for mine in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(base)) + 1):
                if len(mine):
                    s = int(base[mine[0]])
                    yield s, s + int(n), pp[alive[mine]], qq[alive[mine]]
    for g in np.flatnonzero(~plain | (sizes > 64)):
        a, b = int(bounds[g]), int(bounds[g + 1])
        found = [(p[k], q[k]) for p, q in _pairs(a, b, side[a:b] if cross[a] else None) if len(k := _survive(sig, band[p], p, q, least))]
        if found:
            yield a, b, np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found])


def _prune(least: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, t in _groups(batches, ["blk", "cid", "sig"]):
            sig = np.ascontiguousarray(_flat(t.column("sig"))[0].reshape(-1, LONGS))
            hit = np.zeros(t.num_rows, bool)
            for _, _, p, q in _candidates(bounds, t, sig, least):
                hit[p] = hit[q] = True
            kept = [*GROUP, "blk", "cid"]
            yield pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[hit]) for c in kept], kept)

    return run


def _shared(values: np.ndarray, at: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Shingles that both texts of each pair have."""
    rows = np.unique(np.concatenate([p, q]))
    sizes = np.diff(at)[rows]
    if len(p) * 40e-6 < 1e-7 * sizes.sum() + len(rows) ** 2 * sizes.mean() * 4e-10 or len(rows) < 8:
        return np.array([len(np.intersect1d(values[at[x] : at[x + 1]], values[at[y] : at[y + 1]], assume_unique=True)) for x, y in zip(p, q, strict=True)])
    # many pairs among few texts: products of 0/1 matrices, over the shingles that two or more texts have
    everything = np.concatenate([values[at[r] : at[r + 1]] for r in rows])
    _, column, count = np.unique(everything, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), sizes)
    number = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(rows), len(rows)), np.float32)
    wide = 2048
    for c in range(0, int(number[-1]) + 1, wide):
        a, b = np.searchsorted(column, (c, c + wide))
        m = np.zeros((len(rows), wide), np.float32)
        m[row[a:b], column[a:b] - c] = 1
        both += m @ m.T
    return both[np.searchsorted(rows, p), np.searchsorted(rows, q)].astype(np.int64)


def _verify(least: dict[int, int], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, t in _groups(batches, ["blk", "cid", "sig", "shingles"]):
            cid = t.column("cid").to_numpy()
            sig = np.ascontiguousarray(_flat(t.column("sig"))[0].reshape(-1, LONGS))
            values, at = _flat(t.column("shingles"))
            sizes = np.diff(at)
            node, root, links = [], [], []
            for a, b, p, q in _candidates(bounds, t, sig, least):
                inter = _shared(values, at, p, q)
                hit = inter >= threshold * (sizes[p] + sizes[q] - inter) - 1e-9
                p, q = p[hit], q[hit]
                if not len(p):
                    continue
                count = np.bincount(p - a, minlength=b - a) + np.bincount(q - a, minlength=b - a)
                low = cid[a:b].copy()
                while True:  # to the smallest class that each hangs together with
                    old = low.copy()
                    np.minimum.at(low, p - a, low[q - a])
                    np.minimum.at(low, q - a, low[p - a])
                    if (old == low).all():
                        break
                mine = np.flatnonzero(count)
                node.append(cid[a:b][mine])
                root.append(low[mine])
                links.append(count[mine])
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (node, root, links)], ["cid", "root", "links"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-7, block: int = 512, block_shingles: int = 1 << 19) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), class_id (the smallest doc_id among all documents that links join to it,
    itself included), n_links (other texts at the threshold or above; texts with the same shingles count once), n_copies
    (documents with the same shingles, itself included), component (a key of the class). One row per row of docs."""
    spark = docs.sparkSession
    lean(spark)
    least = fewest_matches(threshold, tolerance)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    signed = cut(narrow.mapInArrow(_sign(n), "doc_id long, text_key long, cid long, size int, sig array<bigint>"))

    classes = signed.filter("size > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    classes = cut(classes)
    banded = classes.select("cid", "size", F.posexplode(F.slice("sig", 1, BANDS)).alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("s")).filter("m > 1")
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("s") / block_shingles)).cast("int")
    # a bucket may hold a third of all classes
    buckets = cut(buckets.withColumn("nb", blocks).select("band", "key", "nb", F.col("m").alias("n")))
    members = hot_join(banded.select("band", "key", "cid"), buckets.select("band", "key", "nb"), ["band", "key"], buckets.select("band", "key", "n"))
    members = members.withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    members = members.withColumn("o", other).select("band", "key", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "cid")

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(*GROUP).sortWithinPartitions(*GROUP, "cid")  # adaptive execution may merge small parts

    kinds = "band int, key long, i int, j int, blk int, cid long"
    left = dealt(members.join(classes.select("cid", "sig"), "cid").select(*GROUP, "blk", "cid", "sig")).mapInArrow(_prune(least), kinds)
    left = cut(left)

    # the texts of the classes that are left; a bitmap of their doc_ids spares a shuffle of all texts
    wanted = cut(left.select("cid").distinct().join(classes.select("cid", "rep", "sig"), "cid"))
    key = F.coalesce("rep", F.lit(0)).alias("_rep")
    _, texts = sieved(narrow.select(F.coalesce("doc_id", F.lit(0)).alias("_rep"), "text"), wanted.select(key).distinct(), "_rep")
    sets = texts.select("text").mapInArrow(_sets(n), "cid long, shingles array<bigint>").join(wanted.select("cid", "sig"), "cid").dropDuplicates(["cid"])
    linked = cut(dealt(left.join(sets, "cid").select(*GROUP, "blk", "cid", "sig", "shingles")).mapInArrow(_verify(least, threshold), "cid long, root long, links long"))

    links = linked.groupBy("cid").agg(F.sum("links").alias("n_links"))
    joined = components(linked.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    known = classes.select("cid", "rep", "n_copies").join(links, "cid", "left").join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    # a component may hold a third of all classes, a class a third of all documents
    linking = cut(known.filter("n_links is not null"))
    lowest = linking.groupBy("component").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("n"))
    low = hot_join(linking, lowest.select("component", "low"), ["component"], lowest.select("component", "n"))
    known = low.unionByName(known.filter("n_links is null").withColumn("low", F.lit(None).cast("long")))
    known = cut(known.select("cid", "component", F.coalesce("low", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n_copies").cast("long").alias("n_copies")))
    told = ["doc_id", "text_key", "class_id", "n_links", "n_copies", "component"]
    out = hot_join(signed.filter("size > 0").select("doc_id", "text_key", "cid"), known, ["cid"], known.select("cid", F.col("n_copies").alias("n"))).select(*told)
    alone = signed.filter("size = 0").select("doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.col("cid").alias("component"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, that with the smallest doc_id; texts without words all stay. The columns of docs.

    Documents that are alone in their class pass by a bitmap, only the rest is shuffled."""
    found = cut(near_duplicates(docs, **options)).withColumn("_alone", F.expr("n_copies = 1 and n_links = 0"))
    one = found.filter("_alone or doc_id <=> class_id").groupBy("doc_id", "component").agg(F.min("text_key").alias("text_key"))
    alone, rows = sieved(boxed(docs), found.filter("not _alone").select("text_key").distinct(), "text_key")
    # a wrong hit of the bitmap is alone in its class
    kept = rows.join(one, same_document(rows, one)).select(rows["doc_id"], rows["text_key"], one["component"], rows["row"])
    return alone.select("row").unionByName(kept.dropDuplicates(["doc_id", "text_key", "component"]).select("row")).select("row.*")
