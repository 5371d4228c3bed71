"""Exact quantiles by distributed selection: no task holds the values, no sort and no shuffle of them.

Values are counted by bucket, which tasks do before anything is exchanged; running counts tell the buckets that hold the
wanted ranks, and only their rows are counted again, by finer buckets: first the logarithm in 4,096ths of an octave, then
2 ** 20 parts between the least and the largest value of the bucket, then the values themselves. A value that repeats,
however often, is one row of counts. Many quantiles and groups are selected at once; the ranks of a group travel with its
buckets. The frame is read three times, so it should be cheap to read or kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS, FINER = 4096, 1 << 20


def _octave(v: Column) -> Column:
    """Never falls as v rises: the logarithm on either side of zero, linear within 2 ** -40 of it."""
    size = F.abs(v)
    log = F.when(size >= 1, 40 + F.log2(size)).otherwise(F.log2(1 + size * float(1 << 40)))
    return F.floor(F.signum(v) * log * PARTS).cast("long")


def exact_quantiles(df: DataFrame, value: Column, probabilities: list[float], groups: list[str] | None = None, into: str = "quantiles") -> DataFrame:
    """groups, into: an array with the quantile of value for each probability, interpolated between the two nearest ranks.
    Missing values don't count; a group without values gives no row (nor does a frame, if there are no groups)."""
    own = groups or []
    x = df.select(*own, value.cast("double").alias("_v")).filter("_v is not null").withColumn("_b0", _octave(F.col("_v")))
    pos = lambda p, n: F.lit(float(p)) * (n - 1)

    def counted(rows: DataFrame, by: list[str], bucket: str) -> DataFrame:
        return rows.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))

    def holding(counts: DataFrame, by: list[str], bucket: str) -> DataFrame:
        """The buckets that hold a wanted rank, and these ranks: (rank in the group, rank in the bucket)."""
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
        kept = counts.withColumn("_before", before)
        here = F.filter("_ranks", lambda r: (r["at"] >= F.col("_before")) & (r["at"] < F.col("_before") + F.col("_n")))
        kept = kept.withColumn("_ranks", F.transform(here, lambda r: F.struct(r["rank"].alias("rank"), (r["at"] - F.col("_before")).alias("at"))))
        return kept.filter(F.size("_ranks") > 0).drop("_before", "_n")

    first = counted(x, own, "_b0")
    total = F.sum("_n").over(Window.partitionBy(*own))
    both = F.array(*[f(pos(p, F.col("_total"))).cast("long") for p in probabilities for f in (F.floor, F.ceil)])
    first = first.withColumn("_total", total).withColumn("_ranks", F.transform(F.array_distinct(both), lambda r: F.struct(r.alias("rank"), r.alias("at"))))
    level = holding(first, own, "_b0")
    done = []
    told = lambda d: d.select(*own, "_total", F.explode("_ranks").alias("_r"), F.col("_lo").alias("_x")).select(*own, "_total", "_r.rank", "_x")
    keys = ["_b0"]
    for finer in (F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * FINER), F.col("_v")):
        done.append(told(level.filter("_lo = _hi")))
        b = f"_b{len(keys)}"
        wide = level.filter("_lo < _hi").alias("k")
        source = x if len(keys) == 1 else rows  # noqa: F821
        on = [F.col(f"x.{c}").eqNullSafe(F.col(f"k.{c}")) for c in own] + [F.col(f"x.{c}") == F.col(f"k.{c}") for c in keys]
        rows = source.alias("x").join(wide, on).select("x.*", *[F.col(f"k.{c}") for c in ("_lo", "_hi", "_total", "_ranks")]).withColumn(b, finer)
        level = holding(counted(rows.drop("_lo", "_hi"), [*own, *keys, "_total", "_ranks"], b), [*own, *keys], b)
        rows = rows.drop("_lo", "_hi", "_total", "_ranks")
        keys.append(b)
    done.append(told(level))
    picked = reduce(DataFrame.unionByName, done).groupBy(*own, "_total").agg(F.map_from_entries(F.collect_list(F.struct("rank", "_x"))).alias("_at"))
    at = lambda r: F.element_at("_at", r.cast("long"))
    out = []
    for p in probabilities:
        here = pos(p, F.col("_total"))
        low, high, part = at(F.floor(here)), at(F.ceil(here)), here - F.floor(here)
        out.append(F.when(part == 0, low).otherwise(low * (1 - part) + high * part))
    return picked.select(*own, F.array(*out).alias(into))
