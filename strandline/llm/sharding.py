"""Sharding along a Hilbert curve.

Several metadata columns are quantised, each at its own quantiles, to BITS bits; rows are ordered by the index of their
cell on the Hilbert curve, and the order is cut into runs of equal counts. A shard so holds a compact region of the
metadata space, and a reader that filters on any of the columns skips most files by their minima and maxima.

A column is quantised by the place of its values among all rows in sorted order: level k begins at the least value that
reaches k / levels of the rows with one. So quantised order follows column order, whatever strings begin with; null is below
everything, and a column that the table lacks is null. Within a cell the order is by a hash of doc_id (null as empty), then
by one of the text, so a cell of any size, such as a source with a third of all rows or a text with as many copies, is
numbered in parts. The counts of two shards differ by at most one (the law `rows`). A null text has size 8 and checksum 0.
Extra columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, even, gapless

BITS = 4
DIMENSIONS = ("source", "lang", "n_chars")


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """The place of a cell on the Hilbert curve (Skilling 2004: transpose form, then interleaved)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                t = (x[0] ^ x[i]) & low
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def cuts(df: DataFrame, name: str, levels: int) -> list:
    """The least values that reach each k / levels of the rows with one, k < levels, in order. Distinct values are counted
    and dealt by range; the driver sees the parts' sizes and the cuts."""
    counted = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    dealt = cut(counted.repartitionByRange("v").select("v", "n", F.spark_partition_id().alias("part")))
    total, before = 0, []
    for r in dealt.groupBy("part").agg(F.sum("n").alias("n"), F.min("v").alias("v")).orderBy("v").toLocalIterator():
        before.append((r["part"], total))
        total += r["n"]
    if not total:
        return []
    first = df.sparkSession.createDataFrame(before, "part int, before long")
    window = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("upto", F.sum("n").over(window)).join(F.broadcast(first), "part").withColumn("upto", F.col("upto") + F.col("before"))
    reached = lambda c: F.floor(c * levels / F.lit(total))
    steps = placed.withColumn("k", F.least(reached(F.col("upto")), F.lit(levels - 1))).filter(F.col("k") > reached(F.col("upto") - F.col("n")))
    return [r["v"] for r in steps.select("v", "upto").orderBy("upto").collect()]


def cells(df: DataFrame, dimensions: tuple[str, ...], bits: int) -> Column:
    """The number of each row's cell, the first dimension in the highest bits. Reads the cuts, at most 2^bits - 1 values
    for each dimension, to the driver."""
    cell = F.lit(0)
    for d in dimensions:
        level = F.lit(0)
        for c in cuts(df, d, 1 << bits):
            level = level + F.when(F.col(d) >= F.lit(c).cast(df.schema[d].dataType), 1).otherwise(0)
        cell = cell * (1 << bits) + level
    return cell


def curve(n: int, bits: int) -> list[int]:
    """The place on the curve of each cell of n dimensions, by its number."""
    return [hilbert_index(tuple(c >> bits * (n - 1 - i) & ((1 << bits) - 1) for i in range(n)), bits) for c in range(1 << bits * n)]


def shard(docs: DataFrame, shards: int = 24, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 8), text_crc32, hilbert (place on the curve), shard, slot. Cells are
    counted, at most 2^(bits * dimensions) of them; their running sum gives each its first number."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    found = [F.col(f"`{d}`") if d in docs.columns else F.lit(None).cast("string") for d in dimensions]
    names = tuple(f"_d{k}" for k in range(len(dimensions)))
    own = [F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64("text").alias("_key")]
    keyed = cut(docs.select(*own, *[c.alias(x) for c, x in zip(found, names, strict=True)]))
    order, spread = even(F.col("doc_id"))
    placed = keyed.withColumn("_cell", cells(keyed, names, bits)).drop(*names)
    counted = {r["_cell"]: r["c"] for r in placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("c")).toLocalIterator()}
    total, rows = 0, []
    for c, h in sorted(((c, h) for c, h in enumerate(curve(len(dimensions), bits)) if c in counted), key=lambda x: x[1]):
        rows.append((c, h, total))
        total += counted[c]
    first = spark.createDataFrame(rows, "_cell int, hilbert int, _first long")
    numbered = gapless(placed, ["_cell"], [order, F.col("_key")], spread, into="_at")
    # at most 2^(bits * dimensions) rows, 4096 as shipped
    ranked = numbered.join(F.broadcast(first), "_cell").withColumn("_rank", F.col("_first") + F.col("_at"))
    small, larger = divmod(total, shards) if total else (1, 0)
    edge = larger * (small + 1)
    early = F.col("_rank") < edge
    number = F.when(early, F.floor(F.col("_rank") / (small + 1))).otherwise(larger + F.floor((F.col("_rank") - edge) / max(small, 1)))
    slot = F.when(early, F.col("_rank") % (small + 1)).otherwise((F.col("_rank") - edge) % max(small, 1))
    return ranked.select("doc_id", "size", "text_crc32", "hilbert", number.cast("int").alias("shard"), slot.cast("long").alias("slot"))
