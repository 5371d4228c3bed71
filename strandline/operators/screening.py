"""Screening of features: daily rank correlations, their summaries, regimes, greedy selection, ablation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import correlation, rank_pct, safe_div

from .blocks import correlations, ranks
from .cross_section import unpivot
from .models import WIDE
from .panel import KEYS, Keys


def long_ranks(df: DataFrame, features: list[str], keys: Keys = KEYS, fill: float = 0.5, keep: tuple[str, ...] = ("y_ret_1d",)) -> DataFrame:
    """Long form with x and rank: percentile over the whole universe of the date, missing ones neutral."""
    long = unpivot(df, features, [*keys.both, *keep])
    return long.withColumn("rank", F.coalesce(rank_pct(F.col("x"), keys.date, "feature"), F.lit(fill)))


def daily_rank_ic(df: DataFrame, features: list[str], keys: Keys = KEYS, least: int = 30, fill: float = 0.5) -> DataFrame:
    """date, feature, ic, available_rows, universe_rows, labeled_rows, coverage. The feature is ranked over the universe,
    the label over the labelled rows; too few of these, or a constant side, give no ic."""
    long = long_ranks(df, features, keys, fill)
    known = F.col("y_ret_1d").isNotNull()
    label = rank_pct(F.col("y_ret_1d"), keys.date, "feature")
    ranked = long.withColumn("_y", label)
    daily = ranked.groupBy(keys.date, "feature").agg(F.count("x").alias("available_rows"), F.count(F.lit(1)).alias("universe_rows"), F.sum(known.cast("int")).alias("labeled_rows"), correlation(F.when(known, F.col("rank")), F.col("_y")).alias("ic"))
    return daily.withColumn("ic", F.when(F.col("labeled_rows") >= least, F.col("ic"))).withColumn("coverage", safe_div(F.col("available_rows"), F.col("universe_rows")))


def summarise(daily: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By feature (and period): mean, deviation, ratio of both, share of positive days, days, coverage by rows, least and
    mean daily coverage."""
    g = [*(by or []), "feature"]
    out = daily.groupBy(*g).agg(
        F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), safe_div(F.sum((F.col("ic") > 0).cast("int")), F.count("ic")).alias("positive_ratio"), F.count("ic").alias("ic_days"),
        safe_div(F.sum("available_rows"), F.sum("universe_rows")).alias("coverage"), F.min("coverage").alias("min_daily_coverage"), F.avg("coverage").alias("mean_daily_coverage"),
    )
    return out.withColumn("icir", F.when(F.col("ic_std") > 0, safe_div(F.col("ic_mean"), F.col("ic_std"))).otherwise(0.0))


def periods(daily: DataFrame, named: dict[str, tuple], date: str = "dt") -> DataFrame:
    """A row of daily for each named period (first, last) that it lies in."""
    marks = F.array(*[F.when(F.col(date).between(a, b), F.lit(k)) for k, (a, b) in named.items()])
    return daily.withColumn("period", F.explode(F.filter(marks, lambda x: x.isNotNull())))


def rank_rows(df: DataFrame, features: list[str], keys: Keys = KEYS, fill: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """entity, date, keep, ranks: an array with the percentile rank of each feature (by name) over the whole universe of the
    date, missing ones neutral. The wide rows are exchanged once, by date; ranking and putting together need no other."""
    # an explode keeps the partitioning by date, which an unpivot loses
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("p")
    rows = df.select(*keys.both, *keep, *features).repartition(keys.date).select(*keys.both, *keep, long).select(*keys.both, *keep, "p.*")
    ranked = rows.withColumn("rank", F.coalesce(rank_pct(F.col("x"), keys.date, "feature"), F.lit(fill)))
    told = F.array_sort(F.collect_list(F.struct("feature", "rank")))
    return ranked.groupBy(keys.date, keys.entity, *keep).agg(F.transform(told, lambda p: p["rank"]).alias("ranks"))


def rank_correlations(df: DataFrame, features: list[str], keys: Keys = KEYS, least: int = 30, fill: float = 0.5) -> DataFrame:
    """f1, f2 (f1 before f2 by name, or the same), mean of the daily correlations of their ranks, days.

    Many features are ranked in blocks of columns, a few as rows. Each date's matrix of ranks is multiplied with itself in the tasks that rank it, and the dates' matrices are summed up
    (operators/blocks.py): no row for a pair, and a plan that doesn't grow with their number."""
    ranked = ranks(df, features, keys.entity, keys.date, fill=fill) if len(features) > WIDE else rank_rows(df, features, keys, fill)
    return correlations(ranked, F.col("ranks"), sorted(features), keys.date, least)


def regimes(daily: DataFrame, market_daily: DataFrame, screen: tuple, periods_: dict[str, tuple], keys: Keys = KEYS) -> DataFrame:
    """summarise() in four market regimes (low and high volatility, falling and rising) and named periods. The regimes'
    thresholds are the quartiles over the dates of the screening period only."""
    cuts = market_daily.filter(F.col(keys.date).between(*screen)).agg(*[F.percentile(F.col(c), q).alias(n) for n, c, q in (("lv", "market_std_ret_1", 0.25), ("hv", "market_std_ret_1", 0.75), ("lm", "market_mean_ret_1", 0.25), ("hm", "market_mean_ret_1", 0.75))])
    marked = market_daily.select(keys.date, "market_std_ret_1", "market_mean_ret_1").crossJoin(F.broadcast(cuts))  # cuts is one row
    v, m = F.col("market_std_ret_1"), F.col("market_mean_ret_1")
    names = F.array(F.when(v <= F.col("lv"), "low_volatility"), F.when(v >= F.col("hv"), "high_volatility"), F.when(m <= F.col("lm"), "falling"), F.when(m >= F.col("hm"), "rising"))
    marked = marked.select(keys.date, F.explode(F.filter(names, lambda x: x.isNotNull())).alias("regime"))
    return summarise(periods(daily.join(marked, keys.date), periods_, keys.date), ["regime", "period"])


def eligible(summary: DataFrame, yearly: DataFrame, coverage: float = 0.8, ic: float = 0.01, icir: float = 0.1, positive: float = 0.52, years: int = 2) -> DataFrame:
    """The summary with the years that agree in sign and `reasons`: every threshold that a feature misses. A figure that
    is missing misses its threshold."""
    agree = yearly.select("feature", F.col("ic_mean").alias("_y")).join(summary.select("feature", F.col("ic_mean").alias("_m")), "feature").groupBy("feature").agg(F.sum((F.signum("_y") == F.signum("_m")).cast("int")).alias("consistent_years"))
    aligned = F.when(F.col("ic_mean") < 0, 1 - F.col("positive_ratio")).otherwise(F.col("positive_ratio"))
    out = summary.join(agree, "feature", "left").withColumn("aligned_positive", aligned)
    met = {"coverage": F.col("coverage") >= coverage, "ic": F.abs("ic_mean") >= ic, "icir": F.abs("icir") >= icir, "positive_ratio": F.col("aligned_positive") >= positive, "years": F.col("consistent_years") >= years}
    missed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in met.items()])
    return out.withColumn("reasons", F.filter(missed, lambda x: x.isNotNull()))


def select(candidates: list[dict], correlations: dict[tuple[str, str], float], family: dict[str, str], most: int = 16, per_family: int = 4, highest: float = 0.9, required: bool = True) -> list[dict]:
    """Greedy choice among the features, strongest first, under caps on number, family and correlation with those chosen
    before; each gets `selected`, all its reasons if not, and the first chosen feature that it is too close to. A few dozen
    rows, on the driver."""
    chosen: list[str] = []
    out = []
    for row in sorted(candidates, key=lambda r: (-abs(r["ic_mean"] or 0.0), r["feature"])):
        name, reasons, near = row["feature"], list(row.get("reasons") or []), None
        if not reasons:
            near = next((f for f in chosen if abs(correlations.get((min(name, f), max(name, f))) or 0.0) > highest), None)
            caps = {"total": len(chosen) >= most, "family": sum(family[f] == family[name] for f in chosen) >= per_family, "correlation": near is not None}
            reasons = [k for k, hit in caps.items() if hit]
        if not reasons:
            chosen.append(name)
        out.append(row | {"selected": not reasons, "reasons": reasons, "correlated_with": near})
    if required and not chosen:
        raise ValueError("no feature passes")
    return out


def ablation(df: DataFrame, directions: dict[str, int], family: dict[str, str], keys: Keys = KEYS) -> DataFrame:
    """candidate (all, only:family, drop:family), keys, label, flag, pred: the mean of the directed ranks of the features
    in each. Ranks are taken once."""
    names = sorted(directions)
    sets = {"all": names}
    for f in sorted({family[n] for n in names}):
        sets[f"only:{f}"] = [n for n in names if family[n] == f]
        if rest := [n for n in names if family[n] != f]:
            sets[f"drop:{f}"] = rest
    rank = lambda n: F.coalesce(rank_pct(F.col(n).cast("double"), keys.date), F.lit(0.5))
    ranked = df.select(*keys.both, "y_ret_1d", "flag_limit_up", *[(1 - rank(n) if directions[n] < 0 else rank(n)).alias(n) for n in names])
    points = [F.struct(F.lit(k).alias("candidate"), (sum((F.col(n) for n in v), F.lit(0.0)) / len(v)).alias("pred")) for k, v in sets.items()]
    return ranked.select(*keys.both, "y_ret_1d", "flag_limit_up", F.explode(F.array(*points)).alias("p")).select("p.*", *keys.both, "y_ret_1d", "flag_limit_up")


def top_dates(df: DataFrame, n: int, date: str = "dt") -> DataFrame:
    """The last n distinct dates."""
    return df.select(date).distinct().orderBy(F.col(date).desc()).limit(n)
