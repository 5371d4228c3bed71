"""What the operators share: the shared folder, checkpoints, gapless numbering."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset (one machine, as in
    tests) a temporary folder takes its place."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        held = tempfile.mkdtemp(prefix="strandline-")
        spark.sparkContext.setCheckpointDir(held)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(held)
    return held


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor doesn't cost the work before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lean(spark: SparkSession, rows: int = 512, size: int = 4 << 20) -> None:
    """Smaller Arrow batches from here on: a batch of documents is held a few times over on its way through Python, and
    ten thousand long ones would fill an executor. Spark reads these settings when the result is computed, which is after
    the operator has returned, so they stay lowered for the session."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        held = spark.conf.get(key, None)
        if held is not None and not 0 < int("".join(c for c in held if c.isdigit()) or 0) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and row, a struct of all columns: whatever these are called, nothing clashes with them."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, how: str = "inner", most: int = 1024) -> DataFrame:
    """left joined with right, which has a row at most for each of keys, however many rows of left share one.

    counts has a row (keys, n) for each key of left, or for each that may be hot: no more than `most` keys can have more
    than a most-th of all rows each, so these and their rows of right are broadcast, whether right has them or not; the other
    keys are joined by shuffle. keys have no nulls, and left should be cheap to read twice."""
    at_least = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / most
    hot = F.broadcast(counts.filter(F.col("n") > at_least).select(*keys))
    some = left if how == "inner" else left.join(hot, keys, "left_semi")
    cold = left.join(hot, keys, "left_anti").join(right, keys, how)
    return some.join(F.broadcast(right.join(hot, keys, "left_semi")), keys, how).unionByName(cold)


def even(doc_id: Column) -> tuple[Column, Column]:
    """An order of documents that has nothing to do with their ids or texts, the same in every engine, and the same as a
    double in [0, 1) that never falls along it."""
    hashed = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    return hashed, F.conv(F.substring(hashed, 1, 12), 16, 10).cast("double") / float(1 << 48)


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def sieved(rows: DataFrame, keys: DataFrame, key: str, most_bits: int = 1 << 28) -> tuple[DataFrame, DataFrame]:
    """rows whose key, a long without nulls, is certainly not among keys (a column of the same name), and the others.

    The keys make a bitmap, which is broadcast and tested in the JVM: it spares the rows that an exact join would let
    pass anyway their shuffle. Others go through the join, so a wrong hit does no harm. The bitmap has 16 bits for each key
    but never more than most_bits (32 MB), whatever the input; beyond some 100 million keys it lets fewer rows pass."""
    n = keys.count()
    bits = min(most_bits, max(1 << 15, 1 << (16 * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits).cast("long")) + 1
    # dealt by the part of the bitmap first: keys are smaller than the bitmaps that each task would make of its own
    placed = keys.select(place(F.col(key)).alias("_b")).withColumn("_part", F.bitmap_bucket_number("_b")).repartition("_part")
    bitmap = cut(placed.groupBy("_part").agg(F.bitmap_construct_agg(F.bitmap_bit_position("_b")).alias("_map")))
    at = F.bitmap_bit_position("_b")
    byte = F.conv(F.hex(F.substr("_map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("_b", place(F.col(key))).withColumn("_part", F.bitmap_bucket_number("_b")).join(F.broadcast(bitmap), "_part", "left")
    hit = F.coalesce(F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    marked = marked.withColumn("_hit", hit).drop("_b", "_part", "_map")
    return marked.filter(~F.col("_hit")).drop("_hit"), marked.filter("_hit").drop("_hit")


def gapless(df: DataFrame, group: list[str], order: list[Column], spread: Column, rows_per_part: int = 4096, into: str = "slot") -> DataFrame:
    """Numbers the rows of each group from 0 without a gap, in order of (part, order); no group meets in one task.

    Large groups are cut into parts of about rows_per_part rows by spread, a double in [0, 1) that should be even. One
    aggregate counts the groups, one counts the parts; their running sums are the parts' first numbers, and a window
    numbers the rows of a part. Only the counts (a row for each group and rows_per_part rows) are joined back.
    """
    kept = df.columns
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_parts", F.ceil(F.col("_rows") / F.lit(rows_per_part)).cast("int")).filter("_parts > 1").drop("_rows")
    parted = df.withColumn("_spread", spread).alias("l").join(sizes.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in group], "left")
    parted = parted.select("l.*", F.floor(F.col("_spread") * F.coalesce(F.col("_parts"), F.lit(1))).cast("int").alias("_part")).drop("_spread")
    counts = parted.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n").filter("_part > 0")
    numbered = parted.withColumn("_at", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)) - 1).alias("l")
    keys = [*group, "_part"]
    return numbered.join(first.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], "left").select(*[F.col(f"l.{c}") for c in kept], (F.col("_at") + F.coalesce(F.col("_first"), F.lit(0))).cast("long").alias(into))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a long, b long): node, component (the smallest node in it).

    Alternates the large-star and the small-star step of Kiveris et al. (2014) until nothing changes; each step is an
    aggregate and a join, its result is checkpointed, and only the number of changes comes to the driver.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        sym = both(edges)
        low = sym.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        # a node may be the smallest of a third of all others
        large = hot_join(sym.filter("b > a"), low.select("a", "m"), ["a"], low.select("a", "n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        # and one may be told as many smallest ones
        small_low = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")))
        small = hot_join(large, small_low.select("a", "m"), ["a"], small_low.select("a", "n")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(small_low.select("a", F.col("m").alias("b"))).distinct()
        after = cut(small)
        same = after.count() == edges.count() and after.exceptAll(edges).limit(1).count() == 0
        edges = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
