"""Scores of predictions: rank correlation, top-decile excess, turnover, and their weighted sum.

Every function takes optional groups (fold, candidate): a whole grid is scored in one plan, by one shuffle on (groups,
date) that all three metrics share. Ties in the top set go by entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import correlation, rank_pct, safe_div, tie_rank

from .panel import KEYS, Keys

#: Fixed values of the score.
IC_WEIGHT, EXCESS_WEIGHT, TURNOVER_WEIGHT, DAYS = 0.4, 0.3, 0.3, 252
IC_MIN, POOL_MIN, TURNOVER_MIN, TOP = 30, 100, 100, 10


def merge(predictions: DataFrame, labels: DataFrame, flags: DataFrame, keys: Keys = KEYS) -> DataFrame:
    return predictions.join(labels, keys.both).join(flags, keys.both)


def daily_ic(df: DataFrame, keys: Keys = KEYS, groups: list[str] | None = None, least: int = IC_MIN, score: str = "pred") -> DataFrame:
    """Rank correlation with the label on each date with enough labelled rows; NULL if a side is constant."""
    g = [*(groups or []), keys.date]
    rows = df.filter(F.col("y_ret_1d").isNotNull())
    ranked = rows.select(*g, tie_rank(F.col(score), *g).alias("_p"), tie_rank(F.col("y_ret_1d"), *g).alias("_y"))
    return ranked.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), correlation(F.col("_p"), F.col("_y")).alias("ic")).filter(F.col("n") >= least).drop("n")


def _pool(df: DataFrame, g: list[str], keys: Keys, score: str) -> DataFrame:
    over = Window.partitionBy(*g)
    n = F.count(F.lit(1)).over(over)
    top = F.row_number().over(over.orderBy(F.col(score).desc(), keys.entity)) <= F.greatest(F.floor(n / TOP), F.lit(1))
    return df.withColumns({"_n": n, "_top": top})


def daily_excess(df: DataFrame, keys: Keys = KEYS, groups: list[str] | None = None, least: int = POOL_MIN, score: str = "pred") -> DataFrame:
    """Mean label of the top decile of what can be bought, and by how much it beats the pool."""
    g = [*(groups or []), keys.date]
    pool = _pool(df.filter("flag_limit_up = 0 and y_ret_1d is not null"), g, keys, score).filter(F.col("_n") >= least)
    top = F.avg(F.when(F.col("_top"), F.col("y_ret_1d")))
    return pool.groupBy(*g).agg(top.alias("top_ret"), (top - F.avg("y_ret_1d")).alias("excess"))


def daily_turnover(df: DataFrame, keys: Keys = KEYS, groups: list[str] | None = None, least: int = TURNOVER_MIN, score: str = "pred") -> DataFrame:
    """1 - overlap of the top sets of neighbouring dates, for dates of which both have a pool. A date without one breaks
    the chain. The members of a top set carry the number of their date, so the overlap is a lag over the entity."""
    g = groups or []
    dates = df.select(*g, keys.date).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*g).orderBy(keys.date) if g else Window.orderBy(keys.date)))
    pool = _pool(df.filter("flag_limit_up = 0"), [*g, keys.date], keys, score).filter((F.col("_n") >= least) & F.col("_top")).select(*g, *keys.both).join(dates, [*g, keys.date])
    was = F.lag("_i").over(Window.partitionBy(*g, keys.entity).orderBy("_i")) == F.col("_i") - 1
    sets = pool.withColumn("_was", F.coalesce(was, F.lit(False)).cast("int")).groupBy(*g, keys.date, "_i").agg(F.count(F.lit(1)).alias("size"), F.sum("_was").alias("common"))
    over = Window.partitionBy(*g).orderBy("_i") if g else Window.orderBy("_i")
    before = F.when(F.lag("_i").over(over) == F.col("_i") - 1, F.lag("size").over(over))
    return sets.withColumn("_before", before).filter("_before is not null").select(*g, keys.date, (1 - safe_div(F.col("common"), F.col("size") + F.col("_before") - F.col("common"))).alias("turnover"))


def _strict(aggregate: Column, x: str) -> Column:
    """An aggregate that a missing day makes missing."""
    return F.when(F.count(x) == F.count(F.lit(1)), aggregate)


def summarise(df: DataFrame, keys: Keys = KEYS, groups: list[str] | None = None, score: str = "pred", least: tuple[int, int, int] = (IC_MIN, POOL_MIN, TURNOVER_MIN)) -> DataFrame:
    """ic_mean, ic_std, icir, ic_positive_ratio, annual_excess, top1_annual_ret, mean_turnover, final_score by group."""
    g = groups or []
    ic = daily_ic(df, keys, g, least[0], score).groupBy(*g).agg(_strict(F.avg("ic"), "ic").alias("ic_mean"), _strict(F.stddev_samp("ic"), "ic").alias("ic_std"), safe_div(F.sum(F.coalesce((F.col("ic") > 0).cast("int"), F.lit(0))), F.count(F.lit(1))).alias("ic_positive_ratio"))
    ic = ic.withColumn("icir", F.when(F.col("ic_std") > 0, safe_div(F.col("ic_mean"), F.col("ic_std"))).otherwise(0.0))
    excess = daily_excess(df, keys, g, least[1], score).groupBy(*g).agg((F.avg("excess") * DAYS).alias("annual_excess"), (F.avg("top_ret") * DAYS).alias("top1_annual_ret"))
    turnover = daily_turnover(df, keys, g, least[2], score).groupBy(*g).agg(F.avg("turnover").alias("mean_turnover"))
    if g:
        out = ic.join(excess, g, "full").join(turnover, g, "full")
    else:  # three frames of one row each
        one = lambda d: d.withColumn("_one", F.lit(1))
        out = one(ic).join(one(excess), "_one", "full").join(one(turnover), "_one", "full").drop("_one")
    final = IC_WEIGHT * F.col("ic_mean") + EXCESS_WEIGHT * F.col("annual_excess") + TURNOVER_WEIGHT * (1 - F.col("mean_turnover"))
    return out.withColumn("final_score", final)


def diagnostics(df: DataFrame, keys: Keys = KEYS, least: tuple[int, int, int] = (IC_MIN, POOL_MIN, TURNOVER_MIN)) -> DataFrame:
    """By date: the sizes of the three pools, whether they are large enough, the top set's size, whether a turnover is
    compared."""
    can = F.col("flag_limit_up") == 0
    known = F.col("y_ret_1d").isNotNull()
    daily = df.groupBy(keys.date).agg(F.sum(known.cast("int")).alias("labelled"), F.sum((can & known).cast("int")).alias("portfolio_pool"), F.sum(can.cast("int")).alias("turnover_pool"))
    ok = F.col("turnover_pool") >= least[2]
    return daily.select(
        keys.date, "labelled", "portfolio_pool", "turnover_pool", (F.col("labelled") >= least[0]).alias("ic_eligible"), (F.col("portfolio_pool") >= least[1]).alias("portfolio_eligible"), ok.alias("turnover_eligible"),
        F.greatest(F.floor(F.col("portfolio_pool") / TOP), F.lit(1)).cast("int").alias("top_n"), F.coalesce(ok & F.lag(ok).over(Window.orderBy(keys.date)), F.lit(False)).alias("turnover_compared"),
    )


def by_date(df: DataFrame, keys: Keys = KEYS, score: str = "pred", least: tuple[int, int, int] = (IC_MIN, POOL_MIN, TURNOVER_MIN), groups: list[str] | None = None) -> DataFrame:
    """All dates (by group) with their ic, excess and turnover."""
    at = [*(groups or []), keys.date]
    out = df.select(*at).distinct()
    for daily in (daily_ic(df, keys, groups, least[0], score), daily_excess(df, keys, groups, least[1], score), daily_turnover(df, keys, groups, least[2], score)):
        out = out.join(daily, at, "left")
    return out


def errors(df: DataFrame, score: str = "pred", groups: list[str] | None = None) -> DataFrame:
    e = F.col(score) - F.col("y_ret_1d")
    return df.filter("y_ret_1d is not null").groupBy(*(groups or [])).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(F.lit(1)).alias("rows"))


def daily_predictions(df: DataFrame, date: str = "dt", score: str = "pred") -> DataFrame:
    return df.groupBy(date).agg(F.count(score).alias("count"), F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"))


def over_folds(scores: DataFrame, by: list[str], metrics: list[str], population: bool = False) -> DataFrame:
    """Equal-weight mean, deviation, minimum and maximum of each metric over folds."""
    dev = F.stddev_pop if population else F.stddev_samp
    return scores.groupBy(*by).agg(*[fn(m).alias(f"{m}_{k}") for m in metrics for k, fn in (("mean", F.avg), ("std", dev), ("min", F.min), ("max", F.max))])


#: Regimes of a date by the market's volatility and mean return, and on which side of which threshold they lie. A date
#: between a low and a high threshold is in neither; every date is in `all`.
REGIMES = {"low_volatility": ("market_std_ret_1", "low"), "high_volatility": ("market_std_ret_1", "high"), "bearish_market": ("market_mean_ret_1", "low"), "bullish_market": ("market_mean_ret_1", "high")}


def regime_thresholds(market_daily: DataFrame, first, last, low: float = 0.25, high: float = 0.75, keys: Keys = KEYS) -> dict[str, float]:
    """The quantiles of the market's figures over the dates of a screening period: a threshold for each of REGIMES."""
    part = market_daily.filter(F.col(keys.date).between(F.lit(first), F.lit(last)))
    return part.agg(*[F.percentile(F.col(c), low if side == "low" else high).alias(name) for name, (c, side) in REGIMES.items()]).first().asDict()


def regimes(df: DataFrame, market_daily: DataFrame, thresholds: dict[str, float], keys: Keys = KEYS, score: str = "pred", least: tuple[int, int, int] = (IC_MIN, POOL_MIN, TURNOVER_MIN), groups: list[str] | None = None) -> DataFrame:
    """groups (a source), regime, days, ic_mean, annual_excess, mean_turnover and score_proxy of out-of-fold predictions on
    all dates and in four regimes, a date being at a low threshold or below it, or at a high one or above it. A date without
    market figures is in `all` only. The proxy weighs the three like the final score; a turnover belongs to the later of
    its dates. A threshold that is None has no dates."""
    daily = by_date(df, keys, score, least, groups).join(market_daily.select(keys.date, *sorted({c for c, _ in REGIMES.values()})), keys.date, "left")
    marks = [F.lit("all")]
    for name, (c, side) in REGIMES.items():
        at = F.lit(thresholds[name]).cast("double")
        marks.append(F.when(F.col(c) <= at if side == "low" else F.col(c) >= at, name))
    long = daily.withColumn("regime", F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())))
    out = long.groupBy(*(groups or []), "regime").agg(F.count(F.lit(1)).alias("days"), F.avg("ic").alias("ic_mean"), (F.avg("excess") * DAYS).alias("annual_excess"), F.avg("turnover").alias("mean_turnover"))
    return out.withColumn("score_proxy", IC_WEIGHT * F.col("ic_mean") + EXCESS_WEIGHT * F.col("annual_excess") + TURNOVER_WEIGHT * (1 - F.col("mean_turnover")))


def two_model_grid(a: DataFrame, b: DataFrame, step: float = 0.05, keys: Keys = KEYS, score: str = "pred") -> DataFrame:
    """All blends of two models from the first alone (candidate 0) to the second alone."""
    n = round(1 / step)
    return blend_grid([a, b], [((n - k) / n, k / n) for k in range(n + 1)], keys, score)


def require_replay(grid_row: dict, alone: dict, metrics: list[str]) -> None:
    """Raises unless the end of a grid gives exactly what the model alone does."""
    if bad := {m: (grid_row[m], alone[m]) for m in metrics if grid_row[m] != alone[m]}:
        raise ValueError(f"the grid's end doesn't reproduce the model: {bad}")


def grid_summary(scores: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """By candidate, over folds: the mean of each metric, deviation and worst of the final score."""
    return scores.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics], F.stddev_samp("final_score").alias("final_score_std"), F.min("final_score").alias("final_score_worst"))


def winner(summary: DataFrame, criteria: list[tuple[str, bool]]) -> DataFrame:
    """The best row by ordered criteria (name, ascending)."""
    return summary.orderBy(*[F.col(n).asc() if up else F.col(n).desc() for n, up in criteria]).limit(1)


def blend(models: list[DataFrame], weights: list[float], keys: Keys = KEYS, score: str = "pred") -> DataFrame:
    """Weighted mean of each model's percentile rank by date. All models must have the same keys."""
    if len(models) != len(weights) or any(not 0 <= w <= 1 for w in weights) or abs(sum(weights) - 1) > 1e-12:
        raise ValueError("weights must lie in 0 to 1 and add up to 1")
    out = None
    for k, m in enumerate(models):
        one = m.select(*keys.both, rank_pct(F.col(score), keys.date).alias(f"_r{k}"))
        out = one if out is None else out.join(one, keys.both)
    total = sum((F.col(f"_r{k}") * w for k, w in enumerate(weights)), F.lit(0.0))
    return out.select(*keys.both, total.alias(score))


def simplex(parts: int, step: float) -> list[tuple[float, ...]]:
    """All weight vectors of so many parts on a grid; step must divide 1."""
    n = round(1 / step)
    if abs(n * step - 1) > 1e-9:
        raise ValueError("step must divide 1")

    def fill(k: int, left: int):
        if k == 1:
            yield (left,)
        else:
            for x in range(left + 1):
                for rest in fill(k - 1, left - x):
                    yield (x, *rest)

    return [tuple(x / n for x in v) for v in fill(parts, n)]


def blend_grid(models: list[DataFrame], grid: list[tuple[float, ...]], keys: Keys = KEYS, score: str = "pred") -> DataFrame:
    """All blends of a grid in one frame: candidate, keys, pred. Ranks are taken once, weights are exploded after."""
    out = None
    for k, m in enumerate(models):
        one = m.select(*keys.both, rank_pct(F.col(score), keys.date).alias(f"_r{k}"))
        out = one if out is None else out.join(one, keys.both)
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("candidate"), *[F.lit(w).alias(f"w{k}") for k, w in enumerate(v)]) for i, v in enumerate(grid)])).alias("p")
    rows = out.select("*", points)
    total = sum((F.col(f"_r{k}") * F.col(f"p.w{k}") for k in range(len(models))), F.lit(0.0))
    return rows.select(F.col("p.candidate").alias("candidate"), *[F.col(f"p.w{k}").alias(f"w{k}") for k in range(len(models))], *keys.both, total.alias(score))
