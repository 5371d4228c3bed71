"""Queries of the feature families, and their formulas as SQL."""

from __future__ import annotations


from strandline.operators import features as fx

from .panels import E_W, SQL_M, SQL_W, bars_m, bars_w, d, r, r6, rounded

_LEVELS = (
    f"p1 AS (SELECT *, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(vol) OVER w AS v1, lag(amount) OVER w AS a1, (high + low + close) / 3 AS typical FROM bars WINDOW w AS ({E_W})), "
    f"p2 AS (SELECT *, {d('close', 'c1')} - 1 AS ret, {d('vol', 'v1')} - 1 AS dv, {d('amount', 'a1')} - 1 AS da, close - c1 AS delta, lag(typical) OVER ({E_W}) AS typical1 FROM p1), "
    f"p3 AS (SELECT *, {d('abs(ret)', 'amount')} AS illiq, CASE WHEN ret IS NOT NULL THEN power(least(ret, 0), 2) END AS down2, CASE WHEN ret IS NOT NULL THEN power(greatest(ret, 0), 2) END AS up2, "
    "CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END AS gain, CASE WHEN delta IS NOT NULL THEN greatest(-delta, 0) END AS loss, "
    "CASE WHEN high IS NOT NULL AND low IS NOT NULL AND c1 IS NOT NULL THEN greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr, coalesce(sign(delta), 0) * vol AS signedvol, close * vol AS pv, "
    f"lag(ret) OVER ({E_W}) AS retl, CASE WHEN typical > typical1 THEN typical * vol ELSE 0.0 END AS inflow, CASE WHEN typical < typical1 THEN typical * vol ELSE 0.0 END AS outflow FROM p2)"
)


def roll(agg: str, x: str, n: int, lag: int = 0) -> str:
    frame = f"({E_W} ROWS BETWEEN {n - 1 + lag} PRECEDING AND {f'{lag} PRECEDING' if lag else 'CURRENT ROW'})"
    return f"(CASE WHEN count({x}) OVER {frame} = {n} THEN {agg} OVER {frame} END)"


def lagged(n: int) -> str:
    return f"lag(close, {n}) OVER ({E_W})"


def _corr(x: str, y: str, n: int) -> str:
    f = f"({E_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    a, b = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    sa, sb = f"stddev_pop({a}) OVER {f}", f"stddev_pop({b}) OVER {f}"
    return f"(CASE WHEN count({a}) OVER {f} = {n} AND {sa} > 0 AND {sb} > 0 THEN covar_pop({a}, {b}) OVER {f} / ({sa} * {sb}) END)"


def _moments(x: str, n: int) -> tuple[str, str]:
    m = lambda p: roll(f"avg(power({x}, {p}))", x, n)
    m1, m2, m3, m4 = (m(p) for p in (1, 2, 3, 4))
    v = f"({m2} - power({m1}, 2))"
    skew = f"(CASE WHEN {v} > 1e-20 THEN ({m3} - 3 * {m1} * {m2} + 2 * power({m1}, 3)) / power({v}, 1.5) END)"
    kurt = f"(CASE WHEN {v} > 1e-20 THEN ({m4} - 4 * {m1} * {m3} + 6 * power({m1}, 2) * {m2} - 3 * power({m1}, 4)) / power({v}, 2) - 3 END)"
    return skew, kurt


def _neutral(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.5 ELSE {d(a, b)} END)"


FAMILIES: dict[str, dict[str, str]] = {
    "ret_lags": {k: v for n in fx.RETURNS for k, v in ((f"ret_{n}", f"{d('close', lagged(n))} - 1"), (f"log_ret_{n}", f"CASE WHEN close > 0 AND {lagged(n)} > 0 THEN ln(close) - ln({lagged(n)}) END"))},
    "bar_shape": {
        "intraday_return": f"{d('close', 'open')} - 1", "overnight_gap": f"{d('open', 'c1')} - 1", "high_low_range": d("high - low", "close"), "upper_shadow": d("high - greatest(open, close)", "close"), "lower_shadow": d("least(open, close) - low", "close"),
        "close_position_in_bar": d("close - low", "high - low"), "open_to_high": f"{d('high', 'open')} - 1", "open_to_low": f"{d('open', 'low')} - 1", "close_to_high": f"{d('high', 'close')} - 1", "close_to_low": f"{d('close', 'low')} - 1",
    },
    "volume_change": {"volume_change_1": "dv", "amount_change_1": "da", "amihud_illiq_1": "illiq"},
    "rolling_ma_ratio": {f"close_ma_ratio_{n}": f"{d('close', roll('avg(close)', 'close', n))} - 1" for n in fx.RETURNS} | {f"{x}_ma_{s}_{l}": f"{d(roll(f'avg({x})', x, s), roll(f'avg({x})', x, l))} - 1" for s, l in fx.CROSSES for x in ("close", "vol", "amount")},
    "rolling_vol": {
        k: v for n in fx.VOLATILITY
        for k, v in ((f"ret_mean_{n}", roll("avg(ret)", "ret", n)), (f"ret_std_{n}", roll("stddev_samp(ret)", "ret", n)), (f"ret_mean_abs_{n}", roll("avg(abs(ret))", "ret", n)), (f"downside_rms_{n}", f"sqrt({roll('avg(down2)', 'down2', n)})"), (f"upside_rms_{n}", f"sqrt({roll('avg(up2)', 'up2', n)})"))
    },
    "rolling_volume": {
        k: v for n in fx.VOLUME
        for k, v in ((f"vol_ma_ratio_{n}", d("vol", roll("avg(vol)", "vol", n))), (f"amount_ma_ratio_{n}", d("amount", roll("avg(amount)", "amount", n))), (f"vol_cv_{n}", d(roll("stddev_samp(vol)", "vol", n), roll("avg(vol)", "vol", n))), (f"amount_cv_{n}", d(roll("stddev_samp(amount)", "amount", n), roll("avg(amount)", "amount", n))), (f"amihud_mean_{n}", roll("avg(illiq)", "illiq", n)))
    },
    "rolling_corr": {f"corr_ret_{x}_change_{n}": _corr("ret", c, n) for n in fx.VOLUME for x, c in (("vol", "dv"), ("amount", "da"))},
    "price_position": {
        k: v for n in fx.POSITION for hi, lo, ph, pl in ((roll("max(high)", "high", n), roll("min(low)", "low", n), roll("max(high)", "high", n, 1), roll("min(low)", "low", n, 1)),)
        for k, v in ((f"position_{n}", d(f"close - {lo}", f"{hi} - {lo}")), (f"distance_to_high_{n}", f"{d('close', hi)} - 1"), (f"distance_to_low_{n}", f"{d('close', lo)} - 1"), (f"breakout_high_{n}", f"{d('close', ph)} - 1"), (f"breakout_low_{n}", f"{d('close', pl)} - 1"), (f"range_width_{n}", d(f"{hi} - {lo}", "close")))
    },
    "rsi": {f"rsi_{n}": _neutral(roll("avg(gain)", "gain", n), f"{roll('avg(gain)', 'gain', n)} + {roll('avg(loss)', 'loss', n)}") for n in fx.RSI},
    "atr": {f"atr_norm_{n}": d(roll("avg(tr)", "tr", n), "close") for n in fx.ATR},
    "bollinger": {
        k: v for n in fx.BOLLINGER for m, s in ((roll("avg(close)", "close", n), roll("stddev_samp(close)", "close", n)),)
        for k, v in ((f"bollinger_position_{n}", d(f"close - ({m} - 2 * {s})", f"4 * {s}")), (f"bollinger_width_{n}", d(f"4 * {s}", m)))
    },
    "obv_flow": {f"obv_flow_ratio_{n}": d(roll("sum(signedvol)", "signedvol", n), roll("sum(vol)", "vol", n)) for n in fx.FLOW},
    "mfi": {f"mfi_{n}": _neutral(roll("sum(inflow)", "inflow", n), f"{roll('sum(inflow)', 'inflow', n)} + {roll('sum(outflow)', 'outflow', n)}") for n in fx.ATR},
    "vwap_ratio": {f"close_vwap_ratio_{n}": f"{d('close', d(roll('sum(pv)', 'pv', n), roll('sum(vol)', 'vol', n)))} - 1" for n in fx.FLOW},
    "trend_efficiency": {f"trend_efficiency_{n}": d(f"{d('close', lagged(n))} - 1", roll("sum(abs(ret))", "ret", n)) for n in fx.TREND},
    "reversal": {"reversal_1": f"-({d('close', lagged(1))} - 1)", "reversal_5": f"-({d('close', lagged(5))} - 1)", "momentum_reversal_5_20": f"{d('close', lagged(20))} - {d('close', lagged(5))}"},
    "breakout": {
        k: v for n in fx.BOLLINGER
        for k, v in ((f"volume_breakout_{n}", f"{d('vol', roll('max(vol)', 'vol', n, 1))} - 1"), (f"amount_breakout_{n}", f"{d('amount', roll('max(amount)', 'amount', n, 1))} - 1"), (f"volatility_breakout_{n}", d("abs(ret)", roll("stddev_samp(retl)", "retl", n))))
    },
    "rolling_skew_kurt": {k: v for n in fx.VOLATILITY for k, v in zip((f"ret_skew_{n}", f"ret_kurt_{n}"), _moments("ret", n), strict=True)},
}
#: Families on the dense panel, whose gaps the frames must notice.
DENSE = {"bar_shape", "volume_change", "atr", "rsi", "mfi", "reversal"}
DIGITS = {"rolling_skew_kurt": 3}


def _family(name: str):
    def run(spark, sf_dir):
        bars = (bars_m if name in DENSE else bars_w)(spark, sf_dir)
        return rounded(fx.compute(bars, list(FAMILIES[name])), DIGITS.get(name, 6))

    run.__name__ = name
    return run


QUERIES = {name: _family(name) for name in FAMILIES}
ORACLES = {
    name: f"WITH {SQL_M if name in DENSE else SQL_W}, {_LEVELS} SELECT entity, dt, {', '.join(f'{r(sql, DIGITS.get(name, 6))} AS {c}' for c, sql in columns.items())} FROM p3" for name, columns in FAMILIES.items()
}

EMA_SPANS = (5, 10, 20)


def ema_ratio(spark, sf_dir):
    return rounded(fx.compute(bars_m(spark, sf_dir), [f"close_ema_ratio_{n}" for n in EMA_SPANS]))


def macd(spark, sf_dir):
    return rounded(fx.compute(bars_m(spark, sf_dir), ["macd_diff_12_26", "macd_signal_9", "macd_hist_12_26_9"]))


def ema_sql(source: str, x: str, spans: tuple[int, ...], name: str) -> str:
    """A recursive table `name`: entity, i, and for each span n the weight, mean and number of values so far."""
    first, after = [], []
    for n in spans:
        a = 2.0 / (n + 1)
        first += [f"1.0::DOUBLE AS w{n}", f"CAST({x} AS DOUBLE) AS m{n}", f"CAST(CASE WHEN {x} IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n{n}"]
        old = f"r.w{n} * {1 - a!r}::DOUBLE"
        after += [
            f"CASE WHEN s.{x} IS NULL AND r.m{n} IS NOT NULL THEN {old} ELSE 1.0::DOUBLE END", f"CASE WHEN s.{x} IS NULL THEN r.m{n} WHEN r.m{n} IS NULL THEN CAST(s.{x} AS DOUBLE) ELSE ({old} * r.m{n} + {a!r}::DOUBLE * s.{x}) / ({old} + {a!r}::DOUBLE) END",
            f"CAST(r.n{n} + CASE WHEN s.{x} IS NULL THEN 0 ELSE 1 END AS INTEGER)",
        ]
    return f"{name} AS (SELECT entity, i, {', '.join(first)} FROM {source} WHERE i = 1 UNION ALL SELECT s.entity, s.i, {', '.join(after)} FROM {name} r JOIN {source} s ON s.entity = r.entity AND s.i = r.i + 1)"


_NUMBERED = f"nb AS (SELECT *, row_number() OVER ({E_W}) AS i FROM bars)"
_at = lambda t, n: f"(CASE WHEN {t}.n{n} >= {n} THEN {t}.m{n} END)"
QUERIES |= {"ema_ratio": ema_ratio, "macd": macd}
ORACLES["ema_ratio"] = (
    f"WITH RECURSIVE {SQL_M}, {_NUMBERED}, {ema_sql('nb', 'close', EMA_SPANS, 'e')} SELECT b.entity, b.dt, " + ", ".join(f"{r(d('b.close', _at('e', n)) + ' - 1')} AS close_ema_ratio_{n}" for n in EMA_SPANS) + " FROM nb b JOIN e ON e.entity = b.entity AND e.i = b.i"
)
ORACLES["macd"] = (
    f"WITH RECURSIVE {SQL_M}, {_NUMBERED}, {ema_sql('nb', 'close', (12, 26), 'e')}, mb AS (SELECT b.entity, b.dt, b.i, {d(_at('e', 12), _at('e', 26))} - 1 AS diff FROM nb b JOIN e ON e.entity = b.entity AND e.i = b.i), {ema_sql('mb', 'diff', (9,), 'g')} "
    f"SELECT m.entity, m.dt, {r('m.diff')} AS macd_diff_12_26, {r(_at('g', 9))} AS macd_signal_9, {r('m.diff - ' + _at('g', 9))} AS macd_hist_12_26_9 FROM mb m JOIN g ON g.entity = m.entity AND g.i = m.i"
)


def feature_coverage(spark, sf_dir):
    names = ["ret_1", "ret_20", "close_ma_ratio_60", "position_120", "ret_std_20"]
    df = fx.compute(bars_w(spark, sf_dir), names)
    return fx.coverage(df, names).select("feature", "rows", "nulls", r6("finite_ratio").alias("finite_ratio"))


_cov = {n: FAMILIES[f][n] for n, f in (("ret_1", "ret_lags"), ("ret_20", "ret_lags"), ("close_ma_ratio_60", "rolling_ma_ratio"), ("position_120", "price_position"), ("ret_std_20", "rolling_vol"))}
QUERIES["feature_coverage"] = feature_coverage
ORACLES["feature_coverage"] = f"WITH {SQL_W}, {_LEVELS}, f AS (SELECT {', '.join(f'{v} AS {k}' for k, v in _cov.items())} FROM p3) " + " UNION ALL ".join(f"SELECT '{k}' AS feature, count(*) AS rows, count(*) - count({k}) AS nulls, {r(d(f'count({k})', 'count(*)'))} AS finite_ratio FROM f" for k in _cov)


def feature_dictionary(spark, sf_dir):
    """Every feature, and how many rows of the weekly panel reach far enough back for it."""
    return fx.reachable(bars_w(spark, sf_dir))


QUERIES["feature_dictionary"] = feature_dictionary
_told = lambda x: x.replace("'", "''")
ORACLES["feature_dictionary"] = (
    f"WITH {SQL_W}, el AS (SELECT entity, count(*) AS n FROM bars GROUP BY entity), fd AS (SELECT * FROM (VALUES " + ", ".join(f"('{x['name']}', '{x['family']}', '{_told(x['formula'])}', {x['lookback']})" for x in fx.dictionary()) + ") t(name, family, formula, lookback)) "
    "SELECT name, family, formula, lookback, CAST(sum(greatest(n - greatest(lookback, 1) + 1, 0)) AS BIGINT) AS warm_rows FROM fd, el GROUP BY name, family, formula, lookback"
)
