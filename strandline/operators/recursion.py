"""Recursions along the dates of a panel: exponential means, and the top set that members leave late."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import finite, rank_pct

from .panel import KEYS, ContractError, Keys


#: What the logarithms of decays may sum up to in a block: exp(-SPAN) is far from underflow, and far below any precision.
SPAN = 300.0


def affine_scan(df: DataFrame, steps: dict[str, tuple[Column, Column, Column | None]], keys: Keys = KEYS, groups: list[str] | None = None) -> DataFrame:
    """Adds, for each name: (log of a, b, start), the state m of the recursion m = a * m + b along an entity's dates, which
    begins with start, or with b at the first row where that is null. 0 < a <= 1; neither has nulls.

    A history is cut into blocks wherever its decays come to exp(-SPAN). Inside a block the state is a running sum of
    b over the product of the decays so far, times that product; the block's end is what the next one begins with. What lies
    further back than the block before counts for less than exp(-SPAN), which no double can hold beside it. So each row
    costs a constant number of running sums, window functions stream through a history of any length, and no row holds it.
    One exchange by entity, and one sort for each name."""
    own = [*(groups or []), keys.entity]
    along = Window.partitionBy(*own).orderBy(keys.date)
    before, upto = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(Window.unboundedPreceding, 0)
    out = df
    for name, (log_a, b, start) in steps.items():
        c = lambda k, name=name: f"_{k}_{name}"
        out = out.withColumns({c("la"): log_a, c("b"): b})
        out = out.withColumn(c("blk"), F.floor(-F.sum(c("la")).over(upto) / SPAN))
        out = out.withColumns({c("first"): ~F.lag(c("blk")).over(along).eqNullSafe(F.col(c("blk"))), c("last"): ~F.lead(c("blk")).over(along).eqNullSafe(F.col(c("blk")))})
        inside = Window.partitionBy(*own, c("blk")).orderBy(keys.date).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({c("p"): F.exp(F.sum(F.when(F.col(c("first")), 0.0).otherwise(F.col(c("la")))).over(inside)), c("into"): F.exp(F.first(c("la")).over(inside))})
        out = out.withColumn(c("m"), F.col(c("p")) * F.sum(F.col(c("b")) / F.col(c("p"))).over(inside))
        held = F.last(F.when(F.col(c("last")), F.col(c("m"))), ignorenulls=True).over(before)
        # the block's own rows lie behind `held` too, but none of them is its last
        held = F.coalesce(held, start) if start is not None else held
        out = out.withColumn(name, F.col(c("m")) + F.coalesce(F.col(c("p")) * F.col(c("into")) * held, F.lit(0.0)))
        out = out.drop(*[c(k) for k in ("la", "b", "blk", "first", "last", "p", "into", "m")])
    return out


def ema_columns(df: DataFrame, value: str, spans: dict[str, int], keys: Keys = KEYS) -> DataFrame:
    """Adds exponential means of value, alpha = 2 / (span + 1), missing until span values were there.

    A missing value carries the mean on and lowers its weight, so that over a gap of g rows the next value meets the weight
    (1 - alpha) ** (g + 1). Between values the mean is a recursion with known decays: an affine scan, in window functions."""
    along = Window.partitionBy(keys.entity).orderBy(keys.date)
    upto, before = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    there = F.col(value).isNotNull()
    rows = df.withColumn("_at", F.row_number().over(along)).withColumns({"_n": F.count(value).over(upto), "_gap": F.col("_at") - F.last(F.when(there, F.col("_at")), ignorenulls=True).over(before)})
    steps = {}
    for name, n in spans.items():
        alpha = 2.0 / (n + 1)
        if alpha == 1:  # nothing is carried over from one value to the next
            steps[name] = (F.when(there, -2 * SPAN).otherwise(0.0), F.when(there, F.col(value).cast("double")).otherwise(0.0), None)
            continue
        weight = F.pow(F.lit(1 - alpha), F.col("_gap"))
        begun = there & F.col("_gap").isNotNull()
        # the weight of a long gap is too small for a double, its logarithm is not
        log_a = F.col("_gap") * math.log(1 - alpha) - F.log(weight + alpha)
        steps[name] = (F.when(begun, log_a).otherwise(0.0), F.when(begun, alpha * F.col(value).cast("double") / (weight + alpha)).when(there, F.col(value).cast("double")).otherwise(0.0), None)
    out = affine_scan(rows, steps, keys)
    return out.withColumns({name: F.when(F.col("_n") >= n, F.col(name)) for name, n in spans.items()}).drop("_at", "_n", "_gap")


def ema_pandas(df: DataFrame, value: str, spans: dict[str, int], keys: Keys = KEYS) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys.date)
        for name, n in spans.items():
            pdf[name] = pdf[value].ewm(span=n, min_periods=n, adjust=False).mean()
        return pdf

    schema = f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, {', '.join(f'`{n}` double' for n in spans)}"
    return df.groupBy(keys.entity).applyInPandas(run, schema)


def rank_ema(df: DataFrame, alpha: float | list[float], keys: Keys = KEYS, state: DataFrame | None = None, score: str = "pred", finite_only: bool = False, groups: list[str] | None = None) -> DataFrame:
    """Adds rank (percentile by date, within groups such as folds) and smoothed = alpha * rank + (1 - alpha) * the entity's last value. An entity begins
    with its rank, or from state (entity, smoothed) if it is there. Rows of an entity count, not calendar days; a rank that
    is missing leaves the value as it is. finite_only: missing scores are an error. Several alphas: a row for each, with a
    column alpha; ranks are taken once."""
    alphas = alpha if isinstance(alpha, list) else [alpha]
    if not alphas or not all(0 < a <= 1 for a in alphas):
        raise ValueError("alpha must be in (0, 1]")
    if finite_only and not df.filter(finite(F.col(score).cast("double")).isNull()).isEmpty():
        raise ContractError(f"{score} must be finite")
    ranked = df.withColumn("rank", rank_pct(F.col(score), *(groups or []), keys.date))
    rows, told = ranked, [*ranked.columns, "smoothed"]
    if isinstance(alpha, list):
        rows, told = rows.withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas]))), ["alpha", *told]
    else:
        rows = rows.withColumn("alpha", F.lit(float(alpha)))
    prior = F.lit(None).cast("double")
    if state is not None:
        rows, prior = rows.join(state.select(keys.entity, F.col("smoothed").alias("_prior")), keys.entity, "left"), F.col("_prior")
    groups = [*(groups or []), *(["alpha"] if isinstance(alpha, list) else [])]
    along = Window.partitionBy(*groups, keys.entity).orderBy(keys.date)
    there = F.col("rank").isNotNull()
    rows = rows.withColumn("_seen", F.count("rank").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    opens = (F.col("_seen") == 1) & prior.isNull()
    log_a = F.when(~there, 0.0).when(F.col("alpha") == 1, -2 * SPAN).otherwise(F.log(1 - F.col("alpha")))
    b = F.when(~there, 0.0).when(opens, F.col("rank")).otherwise(F.col("alpha") * F.col("rank"))
    out = affine_scan(rows, {"smoothed": (log_a, b, prior)}, keys, groups)
    return out.withColumn("smoothed", F.when((F.col("_seen") > 0) | prior.isNotNull(), F.col("smoothed"))).select(*told)


def last_state(smoothed: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """entity, smoothed: the state that rank_ema goes on from."""
    return smoothed.groupBy(keys.entity).agg(F.max_by("smoothed", keys.date).alias("smoothed"))


def next_top(head: list, pool: int, before: set, exit_fraction: float, denominator: int, min_pool: int) -> list:
    """The top set of a date, in order. head: the eligible entities by falling score, as far as the wider exit set goes;
    pool: how many there are in all. Members of `before` stay while they are in the exit set, the best of the others follow."""
    if pool < min_pool:
        return []
    top = max(pool // denominator, 1)
    stay = [e for e in head[: max(top, int(pool * exit_fraction))] if e in before][:top]
    kept = set(stay)
    return stay + [e for e in head if e not in kept][: top - len(stay)]


def select_top(ordered: list, eligible: list[bool], before: set, exit_fraction: float, denominator: int, min_pool: int) -> tuple[list, list[float], set]:
    """One whole date of the hysteresis, for streams. ordered: entities by falling score. Returns entities and scores, and
    the new top set."""
    total = len(ordered)
    ordinal = [(total - k) / total for k in range(total)]
    pool = [k for k in range(total) if eligible[k]]
    names = [ordered[k] for k in pool]
    chosen = next_top(names, len(pool), before, exit_fraction, denominator, min_pool)
    top = set(chosen)
    wanted = chosen + [e for e in names if e not in top]
    score = dict(zip(wanted, (ordinal[k] for k in pool), strict=True))
    return ordered, [score.get(e, o) for e, o in zip(ordered, ordinal, strict=True)], top


def hysteresis(df: DataFrame, exit_fraction: float | str, keys: Keys = KEYS, groups: list[str] | None = None, denominator: int = 10, min_pool: int = 100, score: str = "smoothed", flag: str = "flag_limit_up", prior: set | None = None) -> DataFrame:
    """Adds final: scores under which members of the top set stay until they fall out of the wider exit set. The exit
    fraction may be one of the groups, so that a grid of candidates is one plan.

    Dates are ordered in parallel. Only the recursion itself, over the heads of the dates' orders (the exit set, a row for
    each date), runs date by date, an Arrow group for each fold or candidate. Behind the exit set nobody's place changes, so
    the recursion gives the new scores of the heads, and one join brings them back. Scores, means of ranks, are compared at
    12 digits, so that those which tie don't differ by the order of their sums; ties go by entity."""
    own, told = groups or [], isinstance(exit_fraction, str)
    if told and exit_fraction not in own or not told and not 1 / denominator <= exit_fraction <= 1:
        raise ValueError("exit_fraction must be between 1 / denominator and 1, or a group")
    at, begin = [*own, keys.date], set(prior or ())
    day = Window.partitionBy(*at)
    order = day.orderBy(F.round(score, 12).desc(), keys.entity)
    can = F.coalesce(F.col(flag) == 0, F.lit(False))
    ranked = df.withColumns({"_pos": F.row_number().over(order), "_slot": F.sum(can.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_total": F.count(F.lit(1)).over(day), "_pool": F.sum(can.cast("int")).over(day)})
    leave = F.greatest(F.floor(F.col("_pool") / denominator), F.lit(1), F.floor(F.col("_pool") * (F.col(exit_fraction) if told else F.lit(exit_fraction))))
    head = F.array_sort(F.collect_list(F.when(can & (F.col("_slot") <= leave), F.struct("_pos", F.col(keys.entity).alias("e")))))
    heads = ranked.groupBy(*at).agg(F.transform(head, lambda x: x["e"]).alias("_head"), F.transform(head, lambda x: x["_pos"]).alias("_places"), F.coalesce(F.max("_pool"), F.lit(0)).cast("int").alias("_pool"))
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, before, names, places = pdf.sort_values(keys.date), set(begin), [], []
        part = float(pdf[exit_fraction].iloc[0]) if told else exit_fraction
        for head, own_places, pool in zip(pdf["_head"], pdf["_places"], pdf["_pool"], strict=True):
            head = list(head)
            chosen = next_top(head, pool, before, part, denominator, min_pool)
            before = set(chosen)
            moved = [(e, p) for e, p, old in zip(chosen + [e for e in head if e not in before], own_places, head, strict=True) if e != old]
            names.append([e for e, _ in moved])
            places.append([int(p) for _, p in moved])
        return pdf[at].assign(_names=names, _at=places)

    schema = f"{', '.join(f'`{c}` {kinds[c]}' for c in at)}, _names array<{kinds[keys.entity]}>, _at array<int>"
    heads = heads if own else heads.withColumn("_all", F.lit(0))
    moved = heads.groupBy(*(own or ["_all"])).applyInPandas(run, schema).select(*at, F.explode(F.arrays_zip("_names", "_at")).alias("_m"))
    moved = moved.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(at)], F.col("_m._names").alias("_e"), F.col("_m._at").alias("_new"))
    # null-safe, so that no filter inferred for one side keeps the two from sharing what lies below
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(at)] + [F.col(keys.entity).eqNullSafe(F.col("_e"))]
    place = F.coalesce("_new", "_pos")
    return ranked.join(moved, same, "left").select(*df.columns, ((F.col("_total") - place + 1) / F.col("_total")).alias("final"))


def last_top(final: DataFrame, keys: Keys = KEYS, denominator: int = 10, min_pool: int = 100, flag: str = "flag_limit_up") -> set:
    """The top set that hysteresis goes on from: that of the last date, empty if its pool is too small. One cross-section's
    top part comes to the driver."""
    last = final.agg(F.max(keys.date)).first()[0]
    pool = final.filter((F.col(keys.date) == F.lit(last)) & (F.col(flag) == 0))
    n = pool.count()
    if n < min_pool:
        return set()
    return {r[0] for r in pool.orderBy(F.col("final").desc(), keys.entity).limit(max(n // denominator, 1)).select(keys.entity).collect()}


def across_boundary(warm: DataFrame, new: DataFrame, alpha: float, exit_fraction: float, keys: Keys = KEYS, **options) -> DataFrame:
    """final for the new dates, going on from the warm-up's state: each entity's last smoothed score and the last top set
    are handed over, and the warm-up isn't run again. Equal to one run over both."""
    before = rank_ema(warm, alpha, keys)
    pools = {k: v for k, v in options.items() if k in ("denominator", "min_pool", "flag")}
    prior = last_top(hysteresis(before, exit_fraction, keys, **options), keys, **pools)
    return hysteresis(rank_ema(new, alpha, keys, last_state(before, keys)), exit_fraction, keys, prior=prior, **options)
