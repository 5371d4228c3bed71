"""Per-date aggregates and cross-sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import rank_pct, safe_div

from .panel import KEYS, Keys, joined_one_to_one


def market(df: DataFrame, keys: Keys = KEYS, down: str | None = "flag_limit_down") -> DataFrame:
    """One row for each date: counts, mean, median and deviation of ret_1, shares of risers, fallers and limit moves, sum
    and median of the amount. Shares are over the rows that have a return; one aggregate with partial sums."""
    ret = F.col("ret_1")
    share = lambda cond: F.avg(F.when(ret.isNotNull(), cond.cast("double")))
    aggs = [
        F.count(F.lit(1)).alias("market_count"), F.count(ret).alias("valid_return_count"), F.avg(ret).alias("market_mean_ret_1"), F.median(ret).alias("market_median_ret_1"), F.stddev_samp(ret).alias("market_std_ret_1"),
        share(ret > 0).alias("market_up_ratio"), share(ret < 0).alias("market_down_ratio"), F.avg(F.col("flag_limit_up").cast("double")).alias("market_limit_up_ratio"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("market_total_amount"), F.median("amount").alias("market_median_amount"),
    ]
    if down and down in df.columns:
        aggs.append(F.avg(F.col(down).cast("double")).alias("market_limit_down_ratio"))
    return df.groupBy(keys.date).agg(*aggs)


def unpivot(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Long form: keep, feature, x."""
    return df.unpivot(keep, [F.col(f).cast("double").alias(f) for f in features], "feature", "x")


def standardise(df: DataFrame, features: list[str], keys: Keys = KEYS, min_group: int = 30, flat: float = 0.0) -> DataFrame:
    """Long form of the percentile rank (ties share) and the z-score (deviation with divisor n) by date and feature. Both
    are missing where fewer than min_group values are there; a flat feature has z-score `flat`. One sort by (date,
    feature, value) serves all features."""
    long = unpivot(df, features, keys.both)
    g = [keys.date, "feature"]
    over = Window.partitionBy(*g)
    x = F.col("x")
    n, dev = F.count(x).over(over), F.stddev_pop(x).over(over)
    z = F.when(dev == 0, F.when(x.isNotNull(), F.lit(flat))).otherwise(safe_div(x - F.avg(x).over(over), dev))
    return long.withColumns({"rank": F.when(n >= min_group, rank_pct(x, *g)), "zscore": F.when(n >= min_group, z)})


def wide(long: DataFrame, features: list[str], keys: Keys = KEYS) -> DataFrame:
    """One row for each key with f__rank and f__zscore."""
    out = long.groupBy(*keys.both).pivot("feature", features).agg(F.first("rank").alias("_rank"), F.first("zscore").alias("_zscore"))
    return out.select(*keys.both, *[f"{f}__{k}" for k in ("rank", "zscore") for f in features])


def relevance(label: Column, date: str, bins: int = 10) -> Column:
    """Grade 0 to bins - 1 of a label within its date, by percentile rank."""
    if not 2 <= bins <= 31:
        raise ValueError("bins must be in 2 to 31")
    return F.least(F.greatest(F.ceil(rank_pct(label, date) * bins) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")


def ordinal(score: Column, keys: Keys = KEYS) -> Column:
    """(N - i) / N by falling score, ties by entity, i from 0."""
    over = Window.partitionBy(keys.date)
    return (F.count(F.lit(1)).over(over) - F.row_number().over(over.orderBy(score.desc(), keys.entity)) + 1) / F.count(F.lit(1)).over(over)


def audit(long: DataFrame, date: str = "dt", min_group: int = 30) -> DataFrame:
    """By feature: bounds of the rank, largest daily |mean z| and |deviation of z - 1|, small groups, flat cells, share
    of values there."""
    daily = long.groupBy(date, "feature").agg(F.count("x").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.avg("zscore").alias("m"), F.stddev_pop("zscore").alias("s"), F.stddev_pop("x").alias("d"))
    flat = (F.col("d") == 0) & (F.col("n") >= min_group)
    return daily.groupBy("feature").agg(
        F.min("lo").alias("rank_min"), F.max("hi").alias("rank_max"), F.max(F.abs("m")).alias("max_abs_mean"), F.max(F.when(~flat, F.abs(F.col("s") - 1))).alias("max_std_gap"),
        F.sum((F.col("n") < min_group).cast("int")).alias("small_groups"), F.sum(flat.cast("int")).alias("flat_cells"), safe_div(F.sum("n"), F.sum("rows")).alias("finite_ratio"),
    )


def model_view(base: DataFrame, cross: DataFrame, labels: DataFrame, market_daily: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """base, cross-section and labels one to one, the market's row of the date beside them. Whether the market is
    broadcast is left to Spark's size check."""
    view = joined_one_to_one(joined_one_to_one(base, cross, keys.both), labels, keys.both)
    return view.join(market_daily, keys.date, "left")


def augmented(base: DataFrame, more: DataFrame, ranked: list[str], keys: Keys = KEYS, fill: float = 0.5) -> DataFrame:
    """A model's view with the percentile ranks by date of further columns (such as the ATR ones), missing ones neutral.
    Both frames must have the same keys."""
    ranks = more.select(*keys.both, *[F.coalesce(rank_pct(F.col(c).cast("double"), keys.date), F.lit(fill)).alias(f"{c}__rank") for c in ranked])
    return joined_one_to_one(base, ranks, keys.both)
