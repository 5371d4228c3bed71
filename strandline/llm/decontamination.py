"""Benchmark decontamination: size-partitioned MinHash containment search.

Finds the test items of which a document holds 80 % or more of the five-word shingles, however long the document is.

1. Items are partitioned by size, each partition up to twice the shingles of the one before. A partition has a signature
   length and a number of hits of its own: an item's signature is its bottom-k MinHash, the k shingles with the smallest
   hashes, k being what the partition's largest item may miss, (1 - threshold) of its shingles, and HITS more.
2. A document is probed once, shingle by shingle, against the signatures (a table of bits, then a binary search). A document
   and an item with fewer signature hits than k less what the item may miss can't reach the threshold, as a document that
   holds the threshold's share lacks no more than that of any k shingles; the others are candidate pairs.
3. Of each candidate pair, and no other, the containment is counted exactly over all the item's shingles.

So nothing is missed (recall 1), at any length of the document. The usual form, signatures of the documents in partitions of
their own sizes, would lose short items: a document a thousand times as long as an item has one of its values among a
thousand signature values by chance only.

The items are the query set: they are taken in blocks of a bounded number of shingles, with one scan of the documents for
each block. Where there are several, each block's matches are computed and its broadcast is dropped before the next, so a
block is all that driver and tasks hold at a time. Words are runs of letters, digits and anything beyond ASCII, in lower
case. An item of m < 5 words has one shingle, its m words, sought among the runs of m words. Items without a word and
documents without one match nothing. Rows that repeat, in either table, give rows that repeat; ids may be null. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import boxed, cut, lean, same_document, sieved

#: Shingles in a block of items: 16 MB to each task.
BLOCK_SHINGLES = 1 << 20
#: Signature values of an item beyond those that a document at the threshold may lack.
HITS = 4
_BITS = 22


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in tk.texts_of(batch.column("text"), lower=True).slices():
                w = tk.words(part, tk.NOT_ALNUM)
                values, ends = tk.distinct(*tk.shingles(w, n), len(part))
                width = np.minimum(np.diff(w.first), n).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(a, len(part)), pa.array(width), pa.LargeListArray.from_arrays(ends, values.view(np.int64)).cast(pa.list_(pa.int64()))], ["item_id", "width", "shingles"])

    return run


class Block:
    """A block of items: their sets, and the signatures of all partitions as one sorted table."""

    def __init__(self, ids: list, widths: list[int], sets: list[np.ndarray], threshold: float, times: list[int] | None = None) -> None:
        self.times = np.array(times or [1] * len(ids), np.int64)
        self.ids, self.widths, self.threshold, self.sets = ids, sorted(set(widths)), threshold, sets
        self.size = np.array([len(s) for s in sets], np.int64)
        misses = lambda n: np.floor((1 - threshold) * n + 1e-9).astype(np.int64)
        self.partition = np.ceil(np.log2(np.maximum(self.size, 1))).astype(np.int64)
        k = np.minimum(misses(1 << self.partition) + HITS, self.size)
        #: the signature hits that make a candidate
        self.need = k - misses(self.size)
        # sets are sorted by hash, so the first k are the k smallest
        values = np.concatenate([s[:m] for s, m in zip(sets, k, strict=True)])
        owner = np.repeat(np.arange(len(sets)), k)
        order = np.argsort(values, kind="stable")
        self.value, self.owner = values[order], owner[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[values >> tk.U64(64 - _BITS)] = True

    def candidates(self, found: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text and item with enough signature hits, of all shingles of a slice and their texts."""
        maybe = np.flatnonzero(self.bits[found >> tk.U64(64 - _BITS)])
        at = np.minimum(np.searchsorted(self.value, found[maybe]), len(self.value) - 1)
        maybe = maybe[self.value[at] == found[maybe]]
        if not len(maybe):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        order = maybe[np.lexsort((found[maybe], owner[maybe]))]
        value, text = found[order], owner[order]
        new = np.append(True, (value[1:] != value[:-1]) | (text[1:] != text[:-1]))  # a shingle counts once in a text
        value, text = value[new], text[new]
        a, b = np.searchsorted(self.value, value), np.searchsorted(self.value, value, side="right")
        item = self.owner[np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())]
        pair, hits = np.unique(np.repeat(text, b - a) * len(self.ids) + item, return_counts=True)
        text, item = pair // len(self.ids), pair % len(self.ids)
        enough = hits >= self.need[item]
        return text[enough], item[enough]

    def search(self, part: tk.Texts, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and number of shared shingles of each match."""
        w = tk.words(part, tk.NOT_ALNUM)
        runs = [tk.shingles(w, n, whole=False) if width == n else short_runs(w, width) for width in self.widths]
        found, owner = (np.concatenate(x) for x in zip(*runs, strict=True))
        text, item = self.candidates(found, owner)
        shared = np.zeros(len(text), np.int64)
        wanted = np.isin(owner, text)
        found, owner = found[wanted], owner[wanted]
        for t in np.unique(text):
            mine = np.sort(found[owner == t])
            for p in np.flatnonzero(text == t):
                want = self.sets[item[p]]
                shared[p] = (mine[np.minimum(np.searchsorted(mine, want), len(mine) - 1)] == want).sum()
        enough = shared >= self.threshold * self.size[item] - 1e-9
        return text[enough], item[enough], shared[enough]


def short_runs(w: tk.Words, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of m words, hashed as a text of these m words alone is."""
    count = max(0, len(w.hash) - m + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(count, tk.U64)
        for k in range(m):
            total += w.hash[k : k + count] * tk._STEPS[k]
        fits = w.text[:count] == w.text[m - 1 :] if count else np.empty(0, bool)
        return tk.mix(total[fits] ^ tk.U64(m)), w.text[:count][fits]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, n: int = 5, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), item_id, n_shared, n_item, containment: a row for each document and item
    at the threshold or above."""
    spark = docs.sparkSession
    lean(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_sets(n), "item_id long, width int, shingles array<bigint>").filter("width > 0")
    # rows that repeat are held once, with their number
    items = items.groupBy("item_id", "width", "shingles").agg(F.count(F.lit(1)).alias("times"))
    total = items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = max(1, -(-total // block_shingles))
    if blocks > 1:
        items = cut(items)
    kinds = "doc_id long, text_key long, item_id long, n_shared long, n_item long, containment double, times long"
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    out = []
    for k in range(blocks):
        held = items.filter(F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) == k).toArrow()
        if not held.num_rows:
            continue
        sets = [np.sort(np.array(x, np.int64).view(tk.U64)) for x in held.column("shingles").to_pylist()]
        block = spark.sparkContext.broadcast(Block(held.column("item_id").to_pylist(), held.column("width").to_pylist(), sets, threshold, held.column("times").to_pylist()))
        found = narrow.mapInArrow(_scan(block, n), kinds)
        if blocks > 1:
            found = cut(found)
            block.destroy()
        out.append(found)
    rows = reduce(DataFrame.unionByName, out) if out else narrow.mapInArrow(_nothing, kinds)
    told = [x.split()[0] for x in kinds.split(", ")][:-1]
    return rows.select(*told, F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*told)


def _nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return iter(())


def _scan(block, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        ids = pa.array(own.ids, pa.int64())
        for batch in batches:
            for a, part in tk.texts_of(batch.column("text"), lower=True).slices():
                text, item, shared = own.search(part, n)
                at, size = pa.array(text + a), own.size[item]
                columns = [batch.column("doc_id").take(at), batch.column("text_key").take(at), ids.take(pa.array(item)), pa.array(shared), pa.array(size), pa.array(shared / np.maximum(size, 1)), pa.array(own.times[item])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "item_id", "n_shared", "n_item", "containment", "times"])

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item. The columns of docs."""
    hits = cut(contaminated(docs, benchmark, **options).select("doc_id", "text_key").distinct())
    clean, rows = sieved(boxed(docs), hits.select("text_key").distinct(), "text_key")
    return clean.select("row").unionByName(rows.join(hits, same_document(rows, hits), "left_anti").select("row")).select("row.*")
