"""Packing: optimal length buckets.

One aggregate makes the histogram of lengths over all documents. A dynamic program over it chooses the bucket boundaries
that pad least: best[k][j] = min over i of best[k - 1][i] + padding of the lengths i + 1 to j brought to the j-th. Written
out, that is the lowest at the j-th length of lines whose slopes fall with i, so each row is one sweep along their lower
envelope. Inside each bucket the documents, in hashed order, fill batches of padded_tokens // bucket length; a document
longer than the budget has a batch of its own.

A document's length is its words (runs of anything but ASCII white space) and one end mark, or a column's value. Null
and empty texts have length 1, a null in the column is 0. The histogram is exact at any length. Lengths that differ take words that differ: D lengths
need D * D / 2 words, so what comes to the driver grows with the root of the corpus at most. Of boundaries that pad
equally the earliest are taken. Rows that repeat are packed as often; documents are ordered by a hash of doc_id (null as
empty), then by length and a hash of the text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, even, gapless

BUCKETS, PADDED_TOKENS = 16, 65_536


def words_and_mark(text: Column) -> Column:
    return (F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper ends of the buckets, at most so many, that pad least in total. lengths is sorted, without repeats."""
    n = len(lengths)
    if n == 0:
        return []
    buckets = min(buckets, n)
    rows = [0, *np.cumsum(counts).tolist()]
    words = [0, *np.cumsum(counts * lengths).tolist()]
    top = [0, *lengths.tolist()]
    best: list[int | None] = [0] + [None] * n
    choice = np.zeros((buckets + 1, n + 1), np.int64)
    for k in range(1, buckets + 1):
        # the line of i is best[i] + words[i] - rows[i] * x, asked at x = top[j]
        row: list[int | None] = [None] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # slope, height, i: the lower envelope
        at = 0
        for j in range(k, n + 1):
            i = j - 1
            if best[i] is not None:
                m, h = -rows[i], best[i] + words[i]
                while len(hull) >= 2 and (h - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) < (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - m):
                    hull.pop()
                hull.append((m, h, i))
            at = min(at, len(hull) - 1)
            x = top[j]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            m, h, i = hull[at]
            row[j], choice[k, j] = m * x + h + x * rows[j] - words[j], i
        best = row
    ends, j = [], n
    for k in range(buckets, 0, -1):
        ends.append(int(lengths[j - 1]))
        j = int(choice[k, j])
    return ends[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, padded_tokens: int = PADDED_TOKENS, length: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_tokens, batch (from 0, over all buckets), slot (from 0 in the batch)."""
    spark = docs.sparkSession
    n = words_and_mark(F.col("text")) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    read = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), n.alias("n_tokens")))
    counted = read.groupBy(F.col("n_tokens").alias("at")).agg(F.count(F.lit(1)).alias("c")).orderBy("at").toPandas()
    lengths, counts = counted["at"].to_numpy(np.int64), counted["c"].to_numpy(np.int64)
    ends = boundaries(lengths, counts, buckets)
    size, first, total = [], [], 0
    for b, end in enumerate(ends):
        low = ends[b - 1] if b else -1
        size.append(max(1, padded_tokens // max(1, end)))
        first.append(total)
        total += -(-int(counts[(lengths > low) & (lengths <= end)].sum()) // size[-1])
    plan = spark.createDataFrame(list(zip(range(len(ends)), ends, size, first, strict=True)), "bucket int, bucket_tokens long, _size long, _first long")
    # the plan has `buckets` rows at most, the ends are a literal array as short
    bucket = F.coalesce(F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e < F.col("n_tokens"))), F.lit(0)) if ends else F.lit(0)
    dealt = read.withColumn("bucket", bucket.cast("int"))
    hashed, spread = even(F.col("doc_id"))
    numbered = gapless(dealt, ["bucket"], [hashed, F.col("n_tokens"), F.col("text_key")], spread, into="_at")
    out = numbered.join(F.broadcast(plan), "bucket")
    return out.select("doc_id", "n_tokens", "bucket", "bucket_tokens", (F.col("_first") + F.floor(F.col("_at") / F.col("_size"))).cast("long").alias("batch"), (F.col("_at") % F.col("_size")).cast("long").alias("slot"))
