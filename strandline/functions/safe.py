"""Null-safe arithmetic, full-window rolling aggregates and tie-averaged ranks."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != INF), x)


def safe_div(a: Column, b: Column) -> Column:
    """a / b in double precision; NULL for a zero divisor and wherever the result isn't finite."""
    return finite(F.try_divide(a.cast("double"), b.cast("double")))


def neutral_ratio(a: Column, b: Column) -> Column:
    """safe_div, but 0.5 where the divisor is zero; a missing divisor stays missing."""
    return F.when(b == 0, F.lit(0.5)).otherwise(safe_div(a, b))


def clip(x: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """x within bounds; missing stays missing (greatest and least alone would return the bound)."""
    out = x
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    return F.when(x.isNotNull(), out)


def skip_max(*xs: Column) -> Column:
    return F.greatest(*xs)


def skip_min(*xs: Column) -> Column:
    return F.least(*xs)


def complete_max(*xs: Column) -> Column:
    """The largest; missing if any is missing."""
    known = xs[0].isNotNull()
    for x in xs[1:]:
        known = known & x.isNotNull()
    return F.when(known, F.greatest(*xs))


def log_positive(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def sign_or_zero(x: Column) -> Column:
    return F.coalesce(F.signum(x), F.lit(0.0))


def filled(x: Column, value: float) -> Column:
    """x, or value where it is missing or not finite."""
    return F.coalesce(finite(x), F.lit(value))


def year_of(date: Column) -> Column:
    """Year of an integer YYYYMMDD."""
    return F.floor(date / 10000).cast("int")


def full(x: Column, aggregate: Column, w: WindowSpec, n: int) -> Column:
    """An aggregate over a frame of n rows, if x is there in all of them."""
    return F.when(F.count(x).over(w) == n, aggregate.over(w))


def rolling(by: WindowSpec, n: int, lag: int = 0) -> WindowSpec:
    """The frame of n rows that ends lag rows before the present one."""
    return by.rowsBetween(-(n - 1) - lag, -lag)


def std_pop(x: Column) -> Column:
    return F.stddev_pop(x)


def correlation(x: Column, y: Column, over: WindowSpec | None = None, n: int | None = None) -> Column:
    """Pearson correlation of the rows that have both; NULL where a side is constant (corr() would raise). With over and
    n, over a full frame of n rows; without, an aggregate."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    if over is None:
        return finite(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
    out = finite(F.try_divide(F.covar_pop(a, b).over(over), F.stddev_pop(a).over(over) * F.stddev_pop(b).over(over)))
    return out if n is None else F.when(F.count(a).over(over) == n, out)


def tie_rank(x: Column, *groups: str) -> Column:
    """Rank from 1 within groups, ties sharing their mean rank; missing stays missing."""
    ordered = Window.partitionBy(*groups).orderBy(x.asc_nulls_last())
    tied = Window.partitionBy(*groups, x)
    return F.when(x.isNotNull(), F.rank().over(ordered) + (F.count(x).over(tied) - 1) / F.lit(2.0))


def rank_pct(x: Column, *groups: str) -> Column:
    """tie_rank over the number of values that are there."""
    return tie_rank(x, *groups) / F.count(x).over(Window.partitionBy(*groups))
