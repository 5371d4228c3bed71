"""Causal features of a panel: declared by name, planned by level, computed in one shuffle.

A feature is a formula over raw columns, over level-1 columns (lags and what follows from them row by row), or over
level-2 columns (rolling frames over those). All levels share the partitioning by entity and the order by date, so
Catalyst puts one Exchange and one Sort below all Window nodes. A frame counts only if every row in it has a value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import clip, complete_max, finite, log_positive, neutral_ratio, safe_div, sign_or_zero, skip_max, skip_min

from .panel import KEYS, Keys
from .recursion import ema_columns

#: The windows of each family.
RETURNS = (1, 2, 3, 5, 10, 20, 40, 60, 120)
VOLATILITY = (5, 10, 20, 60)
VOLUME = (5, 10, 20, 60)
POSITION = (5, 10, 20, 60, 120)
CROSSES = ((5, 20), (10, 20), (20, 60), (40, 120))
RSI, ATR, BOLLINGER, FLOW, TREND = (6, 12, 24), (14, 28), (20, 60), (5, 20, 60), (10, 20, 60)
VARIANCE_FLOOR = 1e-20

c = F.col


@dataclass(frozen=True)
class Feature:
    name: str
    family: str
    formula: str
    lookback: int
    make: Callable[[Frames], Column]


#: What a rolling aggregate of n rows is, from its state: a sum, an extreme, or the mean and central moments (m, m2, m3, m4).
_FINISH = {
    "avg": lambda s, n: s["m"],
    "stddev_samp": lambda s, n: F.sqrt(s["m2"] / (n - 1)),
    "var_pop": lambda s, n: s["m2"] / n,
    "skewness": lambda s, n: F.try_divide(n**0.5 * s["m3"], F.pow(s["m2"], F.lit(1.5))),
    "kurtosis": lambda s, n: F.try_divide(n * s["m4"], s["m2"] * s["m2"]) - 3,
}
_ORDER = {"avg": 1, "stddev_samp": 2, "var_pop": 2, "skewness": 4, "kurtosis": 4}


def _moments(a: Column, b: Column, p: int, q: int, order: int) -> Column:
    """The moments of two runs of p and q rows, together (Chan, Golub and LeVeque; Pebay for the higher ones)."""
    n, d = float(p + q), b["m"] - a["m"]
    out = {"m": a["m"] + d * (q / n)}
    if order >= 2:
        out["m2"] = a["m2"] + b["m2"] + d * d * (p * q / n)
    if order >= 3:
        out["m3"] = a["m3"] + b["m3"] + d * d * d * (p * q * (p - q) / n**2) + 3 * d * (p / n * b["m2"] - q / n * a["m2"])
        out["m4"] = a["m4"] + b["m4"] + d * d * d * d * (p * q * (p * p - p * q + q * q) / n**3) + 6 * d * d * ((p / n) ** 2 * b["m2"] + (q / n) ** 2 * a["m2"]) + 4 * d * (p / n * b["m3"] - q / n * a["m3"])
    return F.struct(*[x.alias(k) for k, x in out.items()])


def _comoments(a: Column, b: Column, p: int, q: int) -> Column:
    w, dx, dy = p * q / (p + q), b["x"] - a["x"], b["y"] - a["y"]
    return F.struct(
        (a["x"] + dx * (q / (p + q))).alias("x"), (a["y"] + dy * (q / (p + q))).alias("y"), (a["xx"] + b["xx"] + dx * dx * w).alias("xx"), (a["yy"] + b["yy"] + dy * dy * w).alias("yy"), (a["xy"] + b["xy"] + dx * dy * w).alias("xy"),
    )


class Frames:
    """Rolling aggregates and lags that formulas ask for. Each is recorded under its own name and computed once, however
    many features share it; what a formula gets is a reference.

    A frame of n rows is put together from runs of 1, 2, 4, ... rows: the run of 2k rows is that of k rows and that of the k
    rows before, which a lag brings. So a frame costs its logarithm and not its length, nothing is subtracted from running
    sums, and a value that is missing in a frame makes it missing. One Window node for each doubling, all on one sort."""

    def __init__(self, by) -> None:
        self.by, self.lags = by, {}
        self.asked: dict[str, tuple[str, str, int, int]] = {}  # name: aggregate, base, rows, lag
        self.bases: dict[str, Column] = {}

    def full(self, x: str, fn: Callable, n: int, lag: int = 0, of: Callable | None = None) -> Column:
        """fn over a frame of n rows, if x is there in all of them; of: what fn takes instead of x."""
        base = x if of is None else f"_{of.__name__}{x}"
        self.bases[base] = c(x) if of is None else of(x)
        name = f"_{fn.__name__}{base}_{n}_{lag}"
        self.asked[name] = (fn.__name__, base, n, lag)
        return c(name)

    def correlation(self, x: str, y: str, n: int) -> Column:
        base = f"{x}|{y}"
        both = c(x).isNotNull() & c(y).isNotNull()
        self.bases[base] = F.when(both, F.struct(c(x).alias("x"), c(y).alias("y"), *[F.lit(0.0).alias(k) for k in ("xx", "yy", "xy")]))
        self.asked[f"_corr{base}_{n}"] = ("corr", base, n, 0)
        return finite(F.try_divide(c(f"`_corr{base}_{n}`.xy"), F.sqrt(c(f"`_corr{base}_{n}`.xx") * c(f"`_corr{base}_{n}`.yy"))))

    def lag(self, x: str, n: int) -> Column:
        self.lags[f"_lag_{x}_{n}"] = F.lag(x, n).over(self.by)
        return c(f"_lag_{x}_{n}")

    def _order(self, base: str) -> int:
        return max((_ORDER[fn] for fn, b, _, _ in self.asked.values() if b == base and fn in _ORDER), default=0)

    def _kind(self, fn: str, base: str) -> str:
        """The state that an aggregate is read from: a mean comes from moments if these are needed anyway."""
        return fn if fn in ("sum", "max", "min", "corr") else "moments" if self._order(base) > 1 else "sum"

    def _start(self, kind: str, base: str) -> Column:
        x = self.bases[base]
        if kind != "moments":
            return x if kind == "corr" else x.cast("double")
        names = ("m", "m2", "m3", "m4")[: max(2, self._order(base))]
        return F.when(x.isNotNull(), F.struct(*[(x.cast("double") if k == "m" else F.lit(0.0)).alias(k) for k in names]))

    def _merge(self, kind: str, base: str, a: Column, b: Column, p: int, q: int) -> Column:
        if kind == "sum":
            return a + b
        if kind in ("max", "min"):
            return F.when(a.isNotNull() & b.isNotNull(), (F.greatest if kind == "max" else F.least)(a, b))
        return _comoments(a, b, p, q) if kind == "corr" else _moments(a, b, p, q, self._order(base))

    def add_to(self, df: DataFrame) -> DataFrame:
        """df with every frame and lag that was asked for."""
        most: dict[tuple[str, str], int] = {}
        for fn, base, n, _ in self.asked.values():
            key = (self._kind(fn, base), base)
            most[key] = max(most.get(key, 1), n)
        at = lambda kind, base, k: f"_{kind}|{base}|{k}"
        run = lambda kind, base, k: c(f"`{at(kind, base, k)}`")
        df = df.withColumns({at(kind, base, 1): self._start(kind, base) for kind, base in most})
        k = 1
        while any(2 * k <= n for n in most.values()):
            grown = [key for key, n in most.items() if 2 * k <= n]
            # each lag is a column before it's used, as every use of a window expression would be computed by itself
            df = df.withColumns({f"_back|{at(*key, k)}": F.lag(run(*key, k), k).over(self.by) for key in grown})
            df = df.withColumns({at(*key, 2 * k): self._merge(*key, run(*key, k), c(f"`_back|{at(*key, k)}`"), k, k) for key in grown})
            k *= 2

        def pieces(fn: str, n: int, lag: int) -> list[tuple[int, int]]:
            """Size of each run that makes up a frame, and how far back it ends; those of extremes may overlap."""
            size = 1 << (n.bit_length() - 1)
            if fn in ("max", "min"):
                return [(size, lag)] + [(size, lag + n - size)] * (n > size)
            out, done = [], 0
            while done < n:
                out.append((1 << ((n - done).bit_length() - 1), lag + done))
                done += out[-1][0]
            return out

        plan = {name: (self._kind(fn, base), base, fn, n, pieces(fn, n, lag)) for name, (fn, base, n, lag) in self.asked.items()}
        piece = lambda kind, base, size, by: f"_piece|{at(kind, base, size)}|{by}" if by else at(kind, base, size)
        needed = {(kind, base, size, by) for kind, base, _, _, parts in plan.values() for size, by in parts if by}
        df = df.withColumns({piece(*x): F.lag(run(*x[:3]), x[3]).over(self.by) for x in sorted(needed)} | self.lags)
        df = df.withColumns({name: c(f"`{piece(kind, base, *parts[0])}`") for name, (kind, base, _, _, parts) in plan.items()})
        for j in range(1, max((len(x[4]) for x in plan.values()), default=0)):
            some = {name: x for name, x in plan.items() if len(x[4]) > j}
            df = df.withColumns({name: self._merge(kind, base, c(f"`{name}`"), c(f"`{piece(kind, base, *parts[j])}`"), sum(size for size, _ in parts[:j]), parts[j][0]) for name, (kind, base, _, _, parts) in some.items()})
        done = {name: _FINISH[fn](c(f"`{name}`"), n) if kind == "moments" else c(f"`{name}`") / n for name, (kind, _, fn, n, _) in plan.items() if fn in _FINISH and (kind == "moments" or fn == "avg")}
        return df.withColumns(done)


def _level_one(df: DataFrame, w) -> DataFrame:
    """What rolling frames are taken over: lags and row-wise consequences of them."""
    lags = df.withColumns({"_c1": F.lag("close").over(w), "_h1": F.lag("high").over(w), "_l1": F.lag("low").over(w), "_v1": F.lag("vol").over(w), "_a1": F.lag("amount").over(w)})
    ret = safe_div(c("close"), c("_c1")) - 1
    typical = (c("high") + c("low") + c("close")) / 3
    out = lags.withColumns({"_ret": ret, "_dv": safe_div(c("vol"), c("_v1")) - 1, "_da": safe_div(c("amount"), c("_a1")) - 1, "_typical": typical, "_delta": c("close") - c("_c1")})
    out = out.withColumns({
        "_illiq": safe_div(F.abs("_ret"), c("amount")), "_down2": F.pow(clip(c("_ret"), upper=0), F.lit(2.0)), "_up2": F.pow(clip(c("_ret"), lower=0), F.lit(2.0)), "_gain": clip(c("_delta"), lower=0), "_loss": clip(-c("_delta"), lower=0),
        "_tr": complete_max(c("high") - c("low"), F.abs(c("high") - c("_c1")), F.abs(c("low") - c("_c1"))), "_signed": sign_or_zero(c("_delta")) * c("vol"), "_pv": c("close") * c("vol"),
        "_typical1": F.lag("_typical").over(w), "_ret1": F.lag("_ret").over(w),
    })
    flow = c("_typical") * c("vol")
    return out.withColumns({"_inflow": F.when(c("_typical") > c("_typical1"), flow).otherwise(0.0), "_outflow": F.when(c("_typical") < c("_typical1"), flow).otherwise(0.0)})


def _mean(x: str, n: int, lag: int = 0):
    return lambda w: w.full(x, F.avg, n, lag)


def _agg(fn, x: str, n: int, lag: int = 0):
    return lambda w: w.full(x, fn, n, lag)


def _ratio(a, b, minus: float = 1.0):
    def make(w):
        out = safe_div(a(w) if callable(a) else c(a), b(w) if callable(b) else c(b))
        return out - minus if minus else out

    return make


def _of(name: str) -> Callable:
    return lambda w: c(name)


def _moment(kind, x: str, n: int):
    return lambda w: F.when(w.full(x, F.var_pop, n) > VARIANCE_FLOOR, w.full(x, kind, n))


def base() -> list[Feature]:
    """147 columns, the recursive close_ema_ratio ones among them."""
    out: list[Feature] = []

    def add(family: str, name: str, formula: str, lookback: int, make: Callable) -> None:
        out.append(Feature(name, family, formula, lookback, make))

    add("bar", "intraday_return", "close / open - 1", 1, _ratio("close", "open"))
    add("bar", "overnight_gap", "open / previous close - 1", 2, _ratio("open", "_c1"))
    add("bar", "high_low_range", "(high - low) / close", 1, lambda w: safe_div(c("high") - c("low"), c("close")))
    add("bar", "upper_shadow", "(high - max(open, close)) / close", 1, lambda w: safe_div(c("high") - skip_max(c("open"), c("close")), c("close")))
    add("bar", "lower_shadow", "(min(open, close) - low) / close", 1, lambda w: safe_div(skip_min(c("open"), c("close")) - c("low"), c("close")))
    add("bar", "close_position_in_bar", "(close - low) / (high - low)", 1, lambda w: safe_div(c("close") - c("low"), c("high") - c("low")))
    for name, a, b in (("open_to_high", "high", "open"), ("open_to_low", "open", "low"), ("close_to_high", "high", "close"), ("close_to_low", "close", "low")):
        add("bar", name, f"{a} / {b} - 1", 1, _ratio(a, b))
    add("volume", "volume_change_1", "vol / previous vol - 1", 2, _of("_dv"))
    add("volume", "amount_change_1", "amount / previous amount - 1", 2, _of("_da"))
    add("volume", "amihud_illiq_1", "|ret| / amount", 2, _of("_illiq"))
    for n in RETURNS:
        add("return", f"ret_{n}", f"close / close {n} rows ago - 1", n + 1, lambda w, n=n: safe_div(c("close"), w.lag("close", n)) - 1)
        add("return", f"log_ret_{n}", f"ln close - ln close {n} rows ago", n + 1, lambda w, n=n: log_positive(c("close")) - log_positive(w.lag("close", n)))
        add("return", f"close_ma_ratio_{n}", f"close / mean({n}) - 1", n, _ratio("close", _mean("close", n)))
        add("return", f"close_ema_ratio_{n}", f"close / ema(span {n}) - 1", n, _ratio("close", f"_ema{n}"))
    for n in VOLATILITY:
        add("volatility", f"ret_mean_{n}", f"mean of ret({n})", n + 1, _mean("_ret", n))
        add("volatility", f"ret_std_{n}", f"standard deviation of ret({n})", n + 1, _agg(F.stddev_samp, "_ret", n))
        add("volatility", f"ret_mean_abs_{n}", f"mean of |ret|({n})", n + 1, lambda w, n=n: w.full("_ret", F.avg, n, of=F.abs))
        add("volatility", f"downside_rms_{n}", f"root mean square of negative ret({n})", n + 1, lambda w, n=n: F.sqrt(_mean("_down2", n)(w)))
        add("volatility", f"upside_rms_{n}", f"root mean square of positive ret({n})", n + 1, lambda w, n=n: F.sqrt(_mean("_up2", n)(w)))
        add("volatility", f"ret_skew_{n}", f"population skewness of ret({n})", n + 1, _moment(F.skewness, "_ret", n))
        add("volatility", f"ret_kurt_{n}", f"population excess kurtosis of ret({n})", n + 1, _moment(F.kurtosis, "_ret", n))
    for n in VOLUME:
        for x in ("vol", "amount"):
            add("volume", f"{x}_ma_ratio_{n}", f"{x} / mean({n})", n, _ratio(x, _mean(x, n), 0))
            add("volume", f"{x}_cv_{n}", f"standard deviation / mean of {x}({n})", n, _ratio(_agg(F.stddev_samp, x, n), _mean(x, n), 0))
        add("volume", f"amihud_mean_{n}", f"mean of amihud_illiq_1({n})", n + 1, _mean("_illiq", n))
        for x, d in (("vol", "_dv"), ("amount", "_da")):
            add("volume", f"corr_ret_{x}_change_{n}", f"correlation of ret and {x} change({n})", n + 1, lambda w, d=d, n=n: w.correlation("_ret", d, n))
    for n in POSITION:
        high, low = _agg(F.max, "high", n), _agg(F.min, "low", n)
        add("position", f"position_{n}", f"place of close in the range({n})", n, lambda w, h=high, l=low: safe_div(c("close") - l(w), h(w) - l(w)))
        add("position", f"distance_to_high_{n}", f"close / highest({n}) - 1", n, _ratio("close", high))
        add("position", f"distance_to_low_{n}", f"close / lowest({n}) - 1", n, _ratio("close", low))
        add("position", f"breakout_high_{n}", f"close / highest of the {n} rows before - 1", n + 1, _ratio("close", _agg(F.max, "high", n, 1)))
        add("position", f"breakout_low_{n}", f"close / lowest of the {n} rows before - 1", n + 1, _ratio("close", _agg(F.min, "low", n, 1)))
        add("position", f"range_width_{n}", f"range({n}) / close", n, lambda w, h=high, l=low: safe_div(h(w) - l(w), c("close")))
    for s, l in CROSSES:
        for x in ("close", "vol", "amount"):
            add("cross", f"{x}_ma_{s}_{l}", f"mean({s}) / mean({l}) of {x} - 1", l, _ratio(_mean(x, s), _mean(x, l)))
    return out


def advanced() -> list[Feature]:
    """32 technical columns."""
    out: list[Feature] = []

    def add(family: str, name: str, formula: str, lookback: int, make: Callable) -> None:
        out.append(Feature(name, family, formula, lookback, make))

    for n in RSI:
        add("momentum", f"rsi_{n}", f"mean gain / (mean gain + mean loss)({n})", n + 1, lambda w, n=n: neutral_ratio(_mean("_gain", n)(w), _mean("_gain", n)(w) + _mean("_loss", n)(w)))
    add("momentum", "macd_diff_12_26", "ema(12) / ema(26) - 1", 26, _of("_macd"))
    add("momentum", "macd_signal_9", "ema(9) of macd_diff_12_26", 34, _of("_signal"))
    add("momentum", "macd_hist_12_26_9", "macd_diff_12_26 - macd_signal_9", 34, lambda w: c("_macd") - c("_signal"))
    for n in ATR:
        add("volatility", f"atr_norm_{n}", f"mean true range({n}) / close", n + 1, _ratio(_mean("_tr", n), "close", 0))
    for n in BOLLINGER:
        mid, dev = _mean("close", n), _agg(F.stddev_samp, "close", n)
        add("volatility", f"bollinger_position_{n}", f"(close - (mean - 2 s)) / 4 s of close({n})", n, lambda w, m=mid, d=dev: safe_div(c("close") - (m(w) - 2 * d(w)), 4 * d(w)))
        add("volatility", f"bollinger_width_{n}", f"4 s / mean of close({n})", n, lambda w, m=mid, d=dev: safe_div(4 * d(w), m(w)))
    for n in FLOW:
        add("flow", f"obv_flow_ratio_{n}", f"signed volume / volume({n})", n, _ratio(_agg(F.sum, "_signed", n), _agg(F.sum, "vol", n), 0))
    for n in ATR:
        add("flow", f"mfi_{n}", f"money inflow / money flow({n})", n + 1, lambda w, n=n: neutral_ratio(_agg(F.sum, "_inflow", n)(w), _agg(F.sum, "_inflow", n)(w) + _agg(F.sum, "_outflow", n)(w)))
    for n in FLOW:
        add("flow", f"close_vwap_ratio_{n}", f"close / volume-weighted mean({n}) - 1", n, lambda w, n=n: safe_div(c("close"), safe_div(_agg(F.sum, "_pv", n)(w), _agg(F.sum, "vol", n)(w))) - 1)
    for n in TREND:
        add("trend", f"trend_efficiency_{n}", f"ret_{n} / sum of |ret|({n})", n + 1, lambda w, n=n: safe_div(safe_div(c("close"), w.lag("close", n)) - 1, w.full("_ret", F.sum, n, of=F.abs)))
    for n in (1, 5):
        add("reversal", f"reversal_{n}", f"-ret_{n}", n + 1, lambda w, n=n: -(safe_div(c("close"), w.lag("close", n)) - 1))
    add("reversal", "momentum_reversal_5_20", "ret_20 - ret_5", 21, lambda w: safe_div(c("close"), w.lag("close", 20)) - safe_div(c("close"), w.lag("close", 5)))
    for n in BOLLINGER:
        for x, p in (("vol", "volume"), ("amount", "amount")):
            add("breakout", f"{p}_breakout_{n}", f"{x} / highest of the {n} rows before - 1", n + 1, _ratio(x, _agg(F.max, x, n, 1)))
        add("breakout", f"volatility_breakout_{n}", f"|ret| / standard deviation of the {n} rets before", n + 2, lambda w, n=n: safe_div(F.abs("_ret"), w.full("_ret1", F.stddev_samp, n)))
    return out


def dictionary() -> list[dict]:
    """Name, family, formula and lookback of every feature."""
    return [{"name": f.name, "family": f.family, "formula": f.formula, "lookback": f.lookback} for f in (*base(), *advanced())]


def reachable(df: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """name, family, formula, lookback of every feature, and warm_rows: the panel's rows whose entity has as many rows up to
    there as the feature looks back, the most that can have a value."""
    told = df.sparkSession.createDataFrame([(x["name"], x["family"], x["formula"], x["lookback"]) for x in dictionary()], "name string, family string, formula string, lookback int")
    lengths = df.groupBy(keys.entity).agg(F.count(F.lit(1)).alias("_n")).groupBy("_n").agg(F.count(F.lit(1)).alias("_entities"))
    warm = F.sum(F.col("_entities") * F.greatest(F.col("_n") - F.greatest(F.col("lookback"), F.lit(1)) + 1, F.lit(0)))
    rows = lengths.crossJoin(F.broadcast(told))  # the dictionary has a row for each feature
    return rows.groupBy("name", "family", "formula", "lookback").agg(warm.cast("long").alias("warm_rows"))


def warm_up(names: list[str] | None = None) -> int:
    """Rows before the first full value of the features asked for."""
    return max(f.lookback for f in (*base(), *advanced()) if names is None or f.name in names)


def compute(df: DataFrame, names: list[str], keys: Keys = KEYS, keep: list[str] | None = None, as_float: bool = False) -> DataFrame:
    """The keys, the kept columns and the features asked for. Recursive ones are computed by a fold over each entity's
    series, and only if asked for; frames that no feature needs are pruned by Catalyst."""
    known = {f.name: f for f in (*base(), *advanced())}
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"no such features: {unknown}")
    w = keys.by_entity()
    spans = sorted({int(n.rsplit("_", 1)[1]) for n in names if n.startswith("close_ema_ratio_")})
    macd = any(n.startswith("macd_") for n in names)
    if spans or macd:
        df = ema_columns(df, "close", {f"_ema{n}": n for n in sorted({*spans, *((12, 26) if macd else ())})}, keys)
    if macd:
        df = df.withColumn("_macd", safe_div(c("_ema12"), c("_ema26")) - 1)
        df = ema_columns(df, "_macd", {"_signal": 9}, keys) if any(n in names for n in ("macd_signal_9", "macd_hist_12_26_9")) else df
    frames = Frames(w)
    made = {n: known[n].make(frames) for n in names}
    out = frames.add_to(_level_one(df, w))
    cast = (lambda x: x.cast("float")) if as_float else (lambda x: x)
    return out.select(*keys.both, *(keep or []), *[cast(x).alias(n) for n, x in made.items()])


def coverage(df: DataFrame, names: list[str]) -> DataFrame:
    """feature, rows, nulls, finite_ratio: one pass, turned to long form."""
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(n).alias(n) for n in names])
    rows = [F.struct(F.lit(n).alias("feature"), F.col("_rows").alias("rows"), (F.col("_rows") - F.col(n)).alias("nulls"), safe_div(F.col(n), F.col("_rows")).alias("finite_ratio")) for n in names]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def union_tail(tail: DataFrame, new: DataFrame) -> DataFrame:
    """Warm-up rows and new rows in one panel, told apart by is_new."""
    return reduce(DataFrame.unionByName, [tail.withColumn("is_new", F.lit(False)), new.withColumn("is_new", F.lit(True))])
