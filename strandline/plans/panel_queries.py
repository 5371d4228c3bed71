"""Queries over whole panels: market, cross-sections, scores, screening, splits, models, audits."""

from __future__ import annotations

import datetime as dt
from pyspark.sql import functions as F

from strandline.functions import rank_pct, safe_div
from strandline.operators import audits, cross_section, delivery, evaluate, models, panel, recursion, runs, screening, splits, store
from strandline.operators import features as fx
from strandline.operators.blocks import ranks
from strandline.operators.panel import aligned_differences, joined_one_to_one, key_hash, with_returns
from strandline.sources.bars import tail

from .panels import E_W, LIMIT, SQL_D, SQL_M, SQL_RETURNS, SQL_SCORED, SQL_W, bars_d, bars_m, bars_w, corr, d, pct, r, r6, rounded, scored, tie

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_HASH = "CAST(sum(CAST('0x' || substr(md5('=' || entity || '|=' || dt), 1, 15) AS HUGEINT)) % 18446744073709551616 AS VARCHAR)"
NUMBERS = ("open", "high", "low", "close", "vol", "amount")


@query(f"WITH {SQL_W} SELECT entity, dt, {', '.join(f'{r(c, 4)} AS {c}' for c in NUMBERS)} FROM bars")
def bars_ohlcv(spark, sf_dir):
    return rounded(bars_w(spark, sf_dir), 4)


@query(f"WITH {SQL_M}, {SQL_RETURNS} SELECT entity, dt, {r('close')} AS close, {r('ret_1')} AS ret_1, {r('y_ret_1d')} AS y_ret_1d, flag_limit_up FROM panel")
def panel_densify(spark, sf_dir):
    return rounded(with_returns(bars_m(spark, sf_dir), limit=LIMIT).select("entity", "dt", "close", "ret_1", "y_ret_1d", "flag_limit_up"))


_share = lambda c: f"avg(CASE WHEN ret_1 IS NOT NULL THEN CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0 END END)"
_MARKET = (
    "count(*) AS market_count, count(ret_1) AS valid_return_count, avg(ret_1) AS market_mean_ret_1, median(ret_1) AS market_median_ret_1, stddev_samp(ret_1) AS market_std_ret_1, "
    f"{_share('ret_1 > 0')} AS market_up_ratio, {_share('ret_1 < 0')} AS market_down_ratio, avg(CAST(flag_limit_up AS DOUBLE)) AS market_limit_up_ratio, coalesce(sum(amount), 0) AS market_total_amount, median(amount) AS market_median_amount"
)
_M = ("market_mean_ret_1", "market_median_ret_1", "market_std_ret_1", "market_up_ratio", "market_down_ratio", "market_limit_up_ratio", "market_median_amount")


@query(f"WITH {SQL_M}, {SQL_RETURNS}, m AS (SELECT dt, {_MARKET} FROM panel GROUP BY dt) SELECT dt, market_count, valid_return_count, {', '.join(f'{r(c)} AS {c}' for c in _M)}, {r('market_total_amount', 2)} AS market_total_amount FROM m")
def market_daily(spark, sf_dir):
    m = cross_section.market(with_returns(bars_m(spark, sf_dir), limit=LIMIT))
    return m.select("dt", "market_count", "valid_return_count", *[r6(c).alias(c) for c in _M], r6("market_total_amount", 2).alias("market_total_amount"))


FEATURES = ["ret_1", "close_position_in_bar", "close_ma_ratio_5", "ret_std_5"]


def _cs(spark, sf_dir):
    return cross_section.standardise(fx.compute(bars_m(spark, sf_dir), FEATURES), FEATURES)


def _f_sql(names: list[str], panel: str = SQL_M) -> str:
    from .feature_queries import _LEVELS, FAMILIES

    known = {k: v for f in FAMILIES.values() for k, v in f.items()}
    return f"{panel}, {_LEVELS}, feats AS (SELECT entity, dt, close, {', '.join(f'{known[n]} AS {n}' for n in names)} FROM p3)"


def _long_sql(names: list[str]) -> str:
    return "long AS (" + " UNION ALL ".join(f"SELECT entity, dt, '{n}' AS feature, CAST({n} AS DOUBLE) AS x FROM feats" for n in names) + ")"


_G = "dt, feature"
_N = f"count(x) OVER (PARTITION BY {_G})"


@query(f"WITH {_f_sql(FEATURES)}, {_long_sql(FEATURES)} SELECT entity, dt, feature, {r(f'CASE WHEN {_N} >= 30 THEN {pct(chr(120), _G)} END')} AS rank FROM long")
def cs_rank(spark, sf_dir):
    return _cs(spark, sf_dir).select("entity", "dt", "feature", r6("rank").alias("rank"))


_Z = f"CASE WHEN {_N} >= 30 THEN CASE WHEN stddev_pop(x) OVER (PARTITION BY {_G}) = 0 THEN CASE WHEN x IS NOT NULL THEN 0.0::DOUBLE END ELSE (x - avg(x) OVER (PARTITION BY {_G})) / stddev_pop(x) OVER (PARTITION BY {_G}) END END"


@query(f"WITH {_f_sql(FEATURES)}, {_long_sql(FEATURES)} SELECT entity, dt, feature, {r(_Z)} AS zscore FROM long")
def cs_zscore(spark, sf_dir):
    return _cs(spark, sf_dir).select("entity", "dt", "feature", r6("zscore").alias("zscore"))


@query(
    f"WITH {_f_sql(FEATURES)}, {_long_sql(FEATURES)}, s AS (SELECT *, CASE WHEN {_N} >= 30 THEN {pct('x', _G)} END AS rk, {_Z} AS z FROM long), "
    "dd AS (SELECT dt, feature, count(x) AS n, count(*) AS rows, min(rk) AS lo, max(rk) AS hi, avg(z) AS m, stddev_pop(z) AS s, stddev_pop(x) AS dv FROM s GROUP BY dt, feature) "
    f"SELECT feature, {r('min(lo)')} AS rank_min, {r('max(hi)')} AS rank_max, {r('max(abs(m))')} AS max_abs_mean, {r('max(CASE WHEN NOT coalesce(dv = 0 AND n >= 30, false) THEN abs(s - 1) END)')} AS max_std_gap, CAST(sum(CASE WHEN n < 30 THEN 1 ELSE 0 END) AS BIGINT) AS small_groups, CAST(sum(CASE WHEN dv = 0 AND n >= 30 THEN 1 ELSE 0 END) AS BIGINT) AS flat_cells, {r('CAST(sum(n) AS DOUBLE) / sum(rows)')} AS finite_ratio FROM dd GROUP BY feature"
)
def cs_audit(spark, sf_dir):
    out = cross_section.audit(_cs(spark, sf_dir))
    return rounded(out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("small_groups", "flat_cells")}))


@query(f"WITH {SQL_M}, {SQL_RETURNS} SELECT entity, dt, CAST(least(greatest(ceil({pct('y_ret_1d', 'dt')} * 10) - 1, 0), 9) AS INTEGER) AS grade FROM panel WHERE y_ret_1d IS NOT NULL")
def relevance_grade(spark, sf_dir):
    p = with_returns(bars_m(spark, sf_dir)).filter("y_ret_1d is not null")
    return p.select("entity", "dt", cross_section.relevance(F.col("y_ret_1d"), "dt").alias("grade"))


@query(f"WITH {SQL_SCORED} SELECT entity, dt, {r('(count(*) OVER (PARTITION BY dt) - row_number() OVER (PARTITION BY dt ORDER BY pred DESC, entity) + 1) / CAST(count(*) OVER (PARTITION BY dt) AS DOUBLE)')} AS score FROM scored")
def ordinal_score(spark, sf_dir):
    return scored(spark, sf_dir).select("entity", "dt", r6(cross_section.ordinal(F.col("pred"))).alias("score"))


_V = ["ret_1", "close_ma_ratio_5"]


@query(
    f"WITH {_f_sql(_V)}, {SQL_RETURNS}, {_long_sql(_V)}, s AS (SELECT *, CASE WHEN {_N} >= 30 THEN {pct('x', _G)} END AS rk, {_Z} AS z FROM long), m AS (SELECT dt, {_MARKET} FROM panel GROUP BY dt) "
    f"SELECT f.entity, f.dt, {', '.join(f'{r(f"f.{n}")} AS {n}' for n in _V)}, {', '.join(f'{r(f"max(CASE WHEN s.feature = {chr(39)}{n}{chr(39)} THEN s.{k} END)")} AS {n}__{o}' for k, o in (('rk', 'rank'), ('z', 'zscore')) for n in _V)}, {r('p.y_ret_1d')} AS y_ret_1d, p.flag_limit_up, {r('m.market_mean_ret_1')} AS market_mean_ret_1, {r('m.market_std_ret_1')} AS market_std_ret_1 "
    f"FROM feats f JOIN s ON s.entity = f.entity AND s.dt = f.dt JOIN panel p ON p.entity = f.entity AND p.dt = f.dt LEFT JOIN m ON m.dt = f.dt GROUP BY f.entity, f.dt, {', '.join(f'f.{n}' for n in _V)}, p.y_ret_1d, p.flag_limit_up, m.market_mean_ret_1, m.market_std_ret_1"
)
def model_view_join(spark, sf_dir):
    bars = with_returns(bars_m(spark, sf_dir), limit=LIMIT)
    base = fx.compute(bars.drop("ret_1"), _V)
    cross = cross_section.wide(cross_section.standardise(base, _V), _V)
    market = cross_section.market(bars).select("dt", "market_mean_ret_1", "market_std_ret_1")
    return rounded(cross_section.model_view(base, cross, bars.select("entity", "dt", "y_ret_1d", "flag_limit_up"), market))


_DEFS = {"next_row": f"{d(f'lead(close) OVER ({E_W})', 'close')} - 1", "next_close": f"{d(f'first_value(close IGNORE NULLS) OVER ({E_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)', 'close')} - 1"}
_err, _cl = "(CASE WHEN y_ret_1d IS NOT NULL AND v IS NOT NULL THEN abs(y_ret_1d - v) END)", "(abs(y_ret_1d - v) <= 1e-9 + 1e-7 * abs(v))"
_cnt = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"


@query(
    f"WITH {SQL_M}, {SQL_RETURNS}, dv AS (" + " UNION ALL ".join(f"SELECT '{k}' AS definition, y_ret_1d, {v} AS v FROM panel" for k, v in _DEFS.items()) + ") "
    f"SELECT definition, {_cnt('y_ret_1d IS NOT NULL AND v IS NOT NULL')} AS comparable, {_cnt(_cl)} AS matching, {r(d(f'sum(CASE WHEN {_cl} THEN 1 ELSE 0 END)', 'sum(CASE WHEN y_ret_1d IS NOT NULL AND v IS NOT NULL THEN 1 ELSE 0 END)'))} AS match_rate, {r(f'avg({_err})')} AS mean_abs_error, {r(f'max({_err})')} AS max_abs_error, "
    f"{r(d('sum(CASE WHEN (y_ret_1d IS NULL) = (v IS NULL) THEN 1 ELSE 0 END)', 'count(*)'))} AS mask_agreement, {_cnt('y_ret_1d IS NULL AND v IS NOT NULL')} AS label_missing_only, {_cnt('y_ret_1d IS NOT NULL AND v IS NULL')} AS label_present_only FROM dv GROUP BY definition"
)
def label_audit(spark, sf_dir):
    return rounded(audits.alignment(with_returns(bars_m(spark, sf_dir))))


_OFF = lambda k: f"CASE WHEN label IS NULL OR {k} IS NULL THEN (label IS NULL) <> ({k} IS NULL) ELSE abs(label - {k}) > 1e-9 + 1e-7 * abs({k}) END"


@query(
    f"WITH {SQL_M}, {SQL_RETURNS}, v AS (SELECT entity, dt, close, CASE WHEN entity % 7 = 0 THEN y_ret_1d * 1.5::DOUBLE ELSE y_ret_1d END AS label, {', '.join(f'{x} AS {k}' for k, x in _DEFS.items())} FROM panel) "
    f"SELECT entity, dt, {', '.join(f'{r(k)} AS {k}' for k in ('close', 'label', *_DEFS))} FROM (SELECT * FROM v WHERE {' OR '.join(f'({_OFF(k)})' for k in _DEFS)} ORDER BY entity, dt LIMIT 20)"
)
def label_mismatches(spark, sf_dir):
    """The first rows at which damaged labels, or what is missing, disagree with a definition: a report of so many rows."""
    bars = with_returns(bars_m(spark, sf_dir))
    return rounded(audits.mismatches(bars.withColumn("y_ret_1d", F.when(F.col("entity") % 7 == 0, F.col("y_ret_1d") * 1.5).otherwise(F.col("y_ret_1d")))))


_AGREE = "CASE WHEN (y_ret_1d IS NULL) = (v IS NULL) THEN 1 ELSE 0 END"


@query(f"WITH {SQL_M}, {SQL_RETURNS}, b AS ({' UNION ALL '.join(f"SELECT '{k}' AS definition, sum(CASE WHEN {_cl} THEN 1 ELSE 0 END) AS matching, sum({_AGREE}) AS agree, count(*) AS n FROM (SELECT y_ret_1d, {v} AS v FROM panel)" for k, v in _DEFS.items())}) SELECT definition, CAST(matching AS BIGINT) AS matching, {r(d('agree', 'n'))} AS mask_agreement FROM b ORDER BY b.matching DESC, b.agree DESC, definition <> 'next_row' LIMIT 1")
def label_definition(spark, sf_dir):
    return rounded(audits.best_definition(audits.alignment(with_returns(bars_m(spark, sf_dir)))).select("definition", "matching", "mask_agreement"))


_ATR = ["atr_norm_14", "atr_norm_28"]


@query(f"WITH {_f_sql([*_V, *_ATR])} SELECT entity, dt, {', '.join(f'{r(n)} AS {n}' for n in _V)}, {', '.join(f'{r(f"coalesce({pct(n, "dt")}, 0.5)")} AS {n}__rank' for n in _ATR)} FROM feats")
def augmented_view(spark, sf_dir):
    bars = bars_m(spark, sf_dir)
    return rounded(cross_section.augmented(fx.compute(bars, _V), fx.compute(bars, _ATR), _ATR))


@query(f"WITH {_f_sql(_V)}, f AS (SELECT min(dt) AS dt FROM feats) " + " UNION ALL ".join(f"SELECT '{n}' AS column, count(*) AS rows, count({n}) AS finite FROM feats JOIN f USING (dt)" for n in (*_V, "close")))
def finite_probe(spark, sf_dir):
    return delivery.finite_probe(fx.compute(bars_m(spark, sf_dir), _V, keep=["close"]), [*_V, "close"])


@query(f"WITH {SQL_W} SELECT entity, dt, {r('close')} AS close FROM bars WHERE entity IN (SELECT DISTINCT entity FROM bars ORDER BY entity LIMIT 5)")
def first_entities(spark, sf_dir):
    return rounded(panel.first_entities(bars_w(spark, sf_dir), 5).select("entity", "dt", "close"))


_Q = {q: f"q{str(q).replace('0.', '')}" for q in audits.QUANTILES}


@query(
    f"WITH {SQL_M}, {SQL_RETURNS} SELECT count(*) AS rows, count(y_ret_1d) AS present, CAST(0 AS BIGINT) AS infinite, {r('avg(y_ret_1d)')} AS mean, {r('stddev_samp(y_ret_1d)')} AS std, {r('min(y_ret_1d)')} AS min, {r('max(y_ret_1d)')} AS max, {', '.join(f'{_cnt(f"abs(y_ret_1d) >= {t}")} AS abs_ge_{str(t).replace(chr(46), "_")}' for t in (0.1, 0.2, 0.5))}, "
    f"count(*) - count(y_ret_1d) AS missing, {r(d('count(*) - count(y_ret_1d)', 'count(*)'))} AS missing_rate, {', '.join(f'{r(f"quantile_cont(y_ret_1d, {q})")} AS {n}' for q, n in _Q.items())} FROM panel"
)
def label_distribution(spark, sf_dir):
    return rounded(audits.distribution(with_returns(bars_m(spark, sf_dir))))


_P = f"count(*) AS size, count(y_ret_1d) AS count, {r('avg(y_ret_1d)')} AS mean, {r('stddev_samp(y_ret_1d)')} AS std, {r('min(y_ret_1d)')} AS min, {r('max(y_ret_1d)')} AS max, count(*) - count(y_ret_1d) AS missing, {r(d('count(*) - count(y_ret_1d)', 'count(*)'))} AS missing_rate, " + ", ".join(f"{r(f'quantile_cont(y_ret_1d, {q})')} AS {n}" for q, n in ((0.01, "q01"), (0.5, "q50"), (0.99, "q99")))


@query(f"WITH {SQL_M}, {SQL_RETURNS} SELECT 'year' AS kind, CAST(year(dt) AS VARCHAR) AS period, {_P} FROM panel GROUP BY year(dt) UNION ALL SELECT 'date', CAST(dt AS VARCHAR), {_P} FROM panel GROUP BY dt")
def label_by_period(spark, sf_dir):
    return rounded(audits.by_period(with_returns(bars_m(spark, sf_dir))))


_ALL = "open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND (high < greatest(open, high, low, close) OR low > least(open, high, low, close))"


@query(
    f"WITH {SQL_M}, {SQL_RETURNS}, k AS (SELECT count(*) AS n FROM panel GROUP BY entity, dt), dn AS (SELECT count(*) AS n FROM panel GROUP BY dt) "
    f"SELECT count(*) AS rows, count(DISTINCT entity) AS entities, count(DISTINCT dt) AS dates, min(dt) AS first_date, max(dt) AS last_date, {_cnt(_ALL)} AS ohlc_violations, {_cnt('vol < 0')} AS negative_vol, {_cnt('amount < 0')} AS negative_amount, {_cnt('flag_limit_up NOT IN (0, 1)')} AS flag_limit_up_violations, {', '.join(f'{_cnt(f"{c} IS NULL")} AS missing_{c}' for c in NUMBERS)}, {', '.join(f'{_cnt(f"isinf({c})")} AS infinite_{c}' for c in NUMBERS)}, {_cnt('entity IS NULL OR dt IS NULL')} AS null_keys, {_HASH} AS key_hash, "
    f"(SELECT CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) FROM k) AS duplicate_rows, (SELECT min(n) FROM dn) AS date_rows_min, (SELECT {r('median(n)')} FROM dn) AS date_rows_median, (SELECT max(n) FROM dn) AS date_rows_max, "
    f"count(*) > 0 AND (SELECT coalesce(sum(CASE WHEN n > 1 THEN n END), 0) FROM k) = 0 AND {_cnt(_ALL)} = 0 AND {_cnt('vol < 0')} = 0 AND {_cnt('amount < 0')} = 0 AND {_cnt('flag_limit_up NOT IN (0, 1)')} = 0 AS passed FROM panel"
)
def quality_report(spark, sf_dir):
    return rounded(audits.quality(with_returns(bars_m(spark, sf_dir), limit=LIMIT)))


@query(f"WITH {SQL_W} SELECT entity, dt, {r('close')} AS close FROM bars WHERE dt IN (SELECT DISTINCT dt FROM bars ORDER BY dt DESC LIMIT 20)")
def train_tail(spark, sf_dir):
    return tail(bars_w(spark, sf_dir), 20, "dt").select("entity", "dt", r6("close").alias("close"))


_D = dt.date
FOLDS = [splits.Fold(str(y), (_D(1995, 1, 1), _D(y - 1, 12, 31)), (_D(y, 1, 1), _D(y, 12, 31))) for y in (1999, 2000, 2001)]
_ROLES = " UNION ALL ".join(
    f"SELECT '{f.name}' AS fold, dt, CASE WHEN dt BETWEEN DATE '{f.train[0]}' AND DATE '{f.train[1]}' THEN 'train' WHEN dt BETWEEN DATE '{f.validate[0]}' AND DATE '{f.validate[1]}' THEN 'validate' END AS role FROM days" for f in FOLDS
)
SQL_FOLDS = f"days AS (SELECT DISTINCT dt FROM bars), roles AS ({_ROLES}), folds AS (SELECT fold, dt, CASE WHEN role = 'train' AND row_number() OVER (PARTITION BY fold, role ORDER BY dt DESC) <= 1 THEN 'purged' ELSE role END AS role FROM roles WHERE role IS NOT NULL)"


@query(f"WITH {SQL_W}, {SQL_FOLDS} SELECT fold, dt, role FROM folds")
def cv_calendar(spark, sf_dir):
    return splits.calendar(bars_w(spark, sf_dir), FOLDS)


@query(
    f"WITH {SQL_W}, {SQL_RETURNS}, {SQL_FOLDS}, dn AS (SELECT dt, count(*) AS n, count(y_ret_1d) AS k FROM panel GROUP BY dt) "
    "SELECT fold, role, count(*) AS dates, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(k) AS BIGINT) AS labelled, CAST(sum(n) - sum(k) AS BIGINT) AS unlabelled, min(n) AS rows_min, max(n) AS rows_max FROM folds JOIN dn USING (dt) GROUP BY fold, role"
)
def fold_counts(spark, sf_dir):
    p = with_returns(bars_w(spark, sf_dir))
    return splits.fold_counts(p, splits.calendar(p, FOLDS))


@query(f"WITH {SQL_W}, {SQL_FOLDS} SELECT f.fold, f.dt, f.role FROM folds f JOIN (SELECT fold, make_date(CAST(min(year(dt)) - 2 AS INTEGER), 1, 1) AS lo FROM folds WHERE role = 'validate' GROUP BY fold) v USING (fold) WHERE role <> 'train' OR dt >= lo")
def trailing_window(spark, sf_dir):
    return splits.trailing(splits.calendar(bars_w(spark, sf_dir), FOLDS), 2).select("fold", "dt", "role")


# --- scores ---

_IC = f"ic AS (SELECT dt, count(*) AS n, {corr('p', 'y')} AS ic FROM (SELECT dt, {tie('pred', 'dt')} AS p, {tie('y_ret_1d', 'dt')} AS y FROM scored WHERE y_ret_1d IS NOT NULL) GROUP BY dt HAVING count(*) >= 30)"
_EX = (
    "pool AS (SELECT *, count(*) OVER (PARTITION BY dt) AS n, row_number() OVER (PARTITION BY dt ORDER BY pred DESC, entity) AS i FROM scored WHERE flag_limit_up = 0 AND y_ret_1d IS NOT NULL), "
    "ex AS (SELECT dt, avg(CASE WHEN i <= greatest(n // 10, 1) THEN y_ret_1d END) AS top_ret, avg(CASE WHEN i <= greatest(n // 10, 1) THEN y_ret_1d END) - avg(y_ret_1d) AS excess FROM pool WHERE n >= 100 GROUP BY dt)"
)
_TU = (
    "days AS (SELECT dt, row_number() OVER (ORDER BY dt) AS k FROM (SELECT DISTINCT dt FROM scored)), "
    "tops AS (SELECT entity, k FROM (SELECT entity, dt, count(*) OVER (PARTITION BY dt) AS n, row_number() OVER (PARTITION BY dt ORDER BY pred DESC, entity) AS i FROM scored WHERE flag_limit_up = 0) JOIN days USING (dt) WHERE n >= 100 AND i <= greatest(n // 10, 1)), "
    "sz AS (SELECT k, count(*) AS n FROM tops GROUP BY k), "
    "tu AS (SELECT days.dt, 1 - CAST(count(b.entity) AS DOUBLE) / (any_value(x.n) + any_value(y.n) - count(b.entity)) AS turnover FROM sz x JOIN sz y ON y.k = x.k - 1 JOIN tops a ON a.k = x.k LEFT JOIN tops b ON b.k = y.k AND b.entity = a.entity JOIN days ON days.k = x.k GROUP BY days.dt)"
)


@query(f"WITH {SQL_SCORED}, {_IC} SELECT dt, {r('ic')} AS ic FROM ic")
def daily_ic(spark, sf_dir):
    return rounded(evaluate.daily_ic(scored(spark, sf_dir)))


@query(f"WITH {SQL_SCORED}, {_EX} SELECT dt, {r('top_ret')} AS top_ret, {r('excess')} AS excess FROM ex")
def daily_excess(spark, sf_dir):
    return rounded(evaluate.daily_excess(scored(spark, sf_dir)))


@query(f"WITH {SQL_SCORED}, {_TU} SELECT dt, {r('turnover')} AS turnover FROM tu")
def daily_turnover(spark, sf_dir):
    return rounded(evaluate.daily_turnover(scored(spark, sf_dir)))


_SUM = (
    f"{_IC}, {_EX}, {_TU}, s1 AS (SELECT CASE WHEN count(ic) = count(*) THEN avg(ic) END AS ic_mean, CASE WHEN count(ic) = count(*) THEN stddev_samp(ic) END AS ic_std, {d('sum(CASE WHEN ic > 0 THEN 1 ELSE 0 END)', 'count(*)')} AS ic_positive_ratio FROM ic), "
    "s2 AS (SELECT avg(excess) * 252 AS annual_excess, avg(top_ret) * 252 AS top1_annual_ret FROM ex), s3 AS (SELECT avg(turnover) AS mean_turnover FROM tu)"
)


@query(
    f"WITH {SQL_SCORED}, {_SUM} SELECT {r('ic_mean')} AS ic_mean, {r('ic_std')} AS ic_std, {r('ic_positive_ratio')} AS ic_positive_ratio, {r('CASE WHEN ic_std > 0 THEN ic_mean / ic_std ELSE 0 END')} AS icir, {r('annual_excess')} AS annual_excess, {r('top1_annual_ret')} AS top1_annual_ret, {r('mean_turnover')} AS mean_turnover, {r('0.4 * ic_mean + 0.3 * annual_excess + 0.3 * (1 - mean_turnover)')} AS final_score FROM s1, s2, s3"
)
def score_summary(spark, sf_dir):
    return rounded(evaluate.summarise(scored(spark, sf_dir)))


@query(
    f"WITH {SQL_SCORED}, dg AS (SELECT dt, CAST(sum(CASE WHEN y_ret_1d IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS labelled, CAST(sum(CASE WHEN flag_limit_up = 0 AND y_ret_1d IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS portfolio_pool, CAST(sum(CASE WHEN flag_limit_up = 0 THEN 1 ELSE 0 END) AS BIGINT) AS turnover_pool FROM scored GROUP BY dt) "
    "SELECT dt, labelled, portfolio_pool, turnover_pool, labelled >= 30 AS ic_eligible, portfolio_pool >= 100 AS portfolio_eligible, turnover_pool >= 100 AS turnover_eligible, CAST(greatest(portfolio_pool // 10, 1) AS INTEGER) AS top_n, coalesce(turnover_pool >= 100 AND lag(turnover_pool) OVER (ORDER BY dt) >= 100, false) AS turnover_compared FROM dg"
)
def eval_diagnostics(spark, sf_dir):
    return evaluate.diagnostics(scored(spark, sf_dir))


@query(f"WITH {SQL_SCORED}, {_IC}, {_EX}, {_TU} SELECT a.dt, {r('ic')} AS ic, {r('top_ret')} AS top_ret, {r('excess')} AS excess, {r('turnover')} AS turnover FROM (SELECT DISTINCT dt FROM scored) a LEFT JOIN ic ON ic.dt = a.dt LEFT JOIN ex ON ex.dt = a.dt LEFT JOIN tu ON tu.dt = a.dt")
def oof_by_date(spark, sf_dir):
    return rounded(evaluate.by_date(scored(spark, sf_dir)))


@query(f"WITH {SQL_SCORED} SELECT {r('sqrt(avg(power(pred - y_ret_1d, 2)))')} AS rmse, {r('avg(abs(pred - y_ret_1d))')} AS mae, count(*) AS rows FROM scored WHERE y_ret_1d IS NOT NULL")
def oof_error(spark, sf_dir):
    return rounded(evaluate.errors(scored(spark, sf_dir)))


@query(f"WITH {SQL_SCORED} SELECT dt, count(pred) AS count, {r('min(pred)')} AS min, {r('max(pred)')} AS max, {r('avg(pred)')} AS mean, {r('stddev_samp(pred)')} AS std FROM scored GROUP BY dt")
def daily_predictions(spark, sf_dir):
    return rounded(evaluate.daily_predictions(scored(spark, sf_dir)))


# --- screening ---

SCREENED = ["close_position_in_bar", "high_low_range", "intraday_return", "volume_change_1"]
_SP = f"{_f_sql(SCREENED, SQL_D)}, {SQL_RETURNS}, lng AS (" + " UNION ALL ".join(f"SELECT f.entity, f.dt, '{n}' AS feature, CAST(f.{n} AS DOUBLE) AS x, p.y_ret_1d FROM feats f JOIN panel p ON p.entity = f.entity AND p.dt = f.dt" for n in SCREENED) + ")"
_DI = (
    f"rk AS (SELECT *, coalesce({pct('x', _G)}, 0.5) AS rank, {pct('y_ret_1d', _G)} AS y FROM lng), fd AS (SELECT dt, feature, count(x) AS available_rows, count(*) AS universe_rows, count(y_ret_1d) AS labeled_rows, {corr('rank', 'y')} AS ic0 FROM rk GROUP BY dt, feature), "
    f"fi AS (SELECT dt, feature, available_rows, universe_rows, labeled_rows, CASE WHEN labeled_rows >= 30 THEN ic0 END AS ic, {d('available_rows', 'universe_rows')} AS coverage FROM fd)"
)


def _screened(spark, sf_dir):
    bars = with_returns(bars_d(spark, sf_dir), limit=LIMIT)
    return fx.compute(bars.drop("ret_1"), SCREENED, keep=["y_ret_1d", "flag_limit_up"])


def _daily(spark, sf_dir):
    return screening.daily_rank_ic(_screened(spark, sf_dir), SCREENED)


@query(f"WITH {_SP}, {_DI} SELECT dt, feature, available_rows, universe_rows, labeled_rows, {r('ic')} AS ic, {r('coverage')} AS coverage FROM fi")
def feature_ic_daily(spark, sf_dir):
    return rounded(_daily(spark, sf_dir))


_SM = f"{r('avg(ic)')} AS ic_mean, {r('stddev_samp(ic)')} AS ic_std, {r(d('sum(CASE WHEN ic > 0 THEN 1 ELSE 0 END)', 'count(ic)'))} AS positive_ratio, count(ic) AS ic_days, {r(d('sum(available_rows)', 'sum(universe_rows)'))} AS coverage, {r('min(coverage)')} AS min_daily_coverage, {r('avg(coverage)')} AS mean_daily_coverage, {r('CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) ELSE 0 END')} AS icir"
PERIODS = {"screen": (_D(2024, 1, 1), _D(2024, 1, 20)), "holdout": (_D(2024, 1, 21), _D(2024, 1, 31)), "all": (_D(2024, 1, 1), _D(2024, 1, 31))}
_PERIODS = " UNION ALL ".join(f"SELECT *, '{k}' AS period FROM fi WHERE dt BETWEEN DATE '{a}' AND DATE '{b}'" for k, (a, b) in PERIODS.items())


@query(f"WITH {_SP}, {_DI}, pd AS ({_PERIODS}) SELECT period, feature, {_SM} FROM pd GROUP BY period, feature")
def feature_ic_summary(spark, sf_dir):
    return rounded(screening.summarise(screening.periods(_daily(spark, sf_dir), PERIODS), ["period"]))


_PAIRS = [(a, b) for i, a in enumerate(SCREENED) for b in SCREENED[i:]]


@query(
    f"WITH {_f_sql(SCREENED, SQL_D)}, rr AS (SELECT dt, {', '.join(f'coalesce({pct(n, "dt")}, 0.5) AS {n}' for n in SCREENED)} FROM feats), pp AS ("
    + " UNION ALL ".join(f"SELECT dt, '{a}' AS f1, '{b}' AS f2, count(*) AS n, {corr(a, b)} AS c FROM rr GROUP BY dt" for a, b in _PAIRS)
    + f") SELECT f1, f2, {r('avg(c)')} AS rank_corr, count(*) AS days FROM pp WHERE n >= 30 AND c IS NOT NULL GROUP BY f1, f2"
)
def rank_corr_matrix(spark, sf_dir):
    return rounded(screening.rank_correlations(_screened(spark, sf_dir), SCREENED))


def _wide_names() -> list[str]:
    from .feature_queries import FAMILIES

    return sorted(n for k in ("ret_lags", "bar_shape", "volume_change", "rolling_ma_ratio", "rolling_vol") for n in FAMILIES[k] if not n.endswith("120"))


def _wide(spark, sf_dir):
    """Every feature of five families."""
    return rounded(fx.compute(with_returns(bars_m(spark, sf_dir)).drop("ret_1"), _wide_names(), keep=["y_ret_1d"]))


def _wide_sql() -> str:
    names = _wide_names()
    told = f"{_f_sql(names)}, {SQL_RETURNS}, fr AS (SELECT entity, dt, {', '.join(f'{r(n)} AS {n}' for n in names)} FROM feats), "
    long = " UNION ALL ".join(f"SELECT entity, dt, '{n}' AS f, coalesce({pct(n, 'dt')}, 0.5) AS x FROM fr" for n in names)
    return f"{told} lr AS ({long})"


@query(f"WITH {_wide_sql()}, pp AS (SELECT a.dt, a.f AS f1, b.f AS f2, count(*) AS n, {corr('a.x', 'b.x')} AS c FROM lr a JOIN lr b ON a.entity = b.entity AND a.dt = b.dt AND a.f <= b.f GROUP BY a.dt, a.f, b.f) SELECT f1, f2, {r('avg(c)')} AS rank_corr, count(*) AS days FROM pp WHERE n >= 30 AND c IS NOT NULL GROUP BY f1, f2")
def rank_corr_wide(spark, sf_dir):
    """The matrix over all features of five families, in one plan."""
    return rounded(screening.rank_correlations(_wide(spark, sf_dir), _wide_names()))


@query(f"WITH {_wide_sql()}, yy AS (SELECT entity, dt, y_ret_1d FROM panel WHERE y_ret_1d IS NOT NULL) SELECT a.f AS f1, b.f AS f2, count(*) AS n, {r('sum(a.x * b.x)', 4)} AS products FROM lr a JOIN lr b ON a.entity = b.entity AND a.dt = b.dt AND a.f <= b.f JOIN yy ON yy.entity = a.entity AND yy.dt = a.dt GROUP BY a.f, b.f")
def gram_wide(spark, sf_dir):
    """The sums of products that a ridge on all features of five families needs."""
    names = _wide_names()
    view = ranks(_wide(spark, sf_dir), names, "entity", "dt", keep=("y_ret_1d",))
    view = view.select("y_ret_1d", *[F.get("ranks", F.lit(k)).alias(n) for k, n in enumerate(names)])
    pairs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate((a, b) for i, a in enumerate(names) for b in names[i:])], "k int, f1 string, f2 string")
    sums = models.gram(view, names).select("n", F.posexplode("sxx").alias("k", "products"))
    return rounded(sums.join(F.broadcast(pairs), "k").select("f1", "f2", "n", "products"), 4)


@query(
    f"WITH {_SP}, {_DI}, m AS (SELECT dt, avg(ret_1) AS mm, stddev_samp(ret_1) AS ms FROM panel GROUP BY dt), c AS (SELECT quantile_cont(ms, 0.25) AS lv, quantile_cont(ms, 0.75) AS hv, quantile_cont(mm, 0.25) AS lm, quantile_cont(mm, 0.75) AS hm FROM m WHERE dt BETWEEN DATE '2024-01-01' AND DATE '2024-01-20'), "
    "rg AS (SELECT dt, 'low_volatility' AS regime FROM m, c WHERE ms <= lv UNION ALL SELECT dt, 'high_volatility' FROM m, c WHERE ms >= hv UNION ALL SELECT dt, 'falling' FROM m, c WHERE mm <= lm UNION ALL SELECT dt, 'rising' FROM m, c WHERE mm >= hm), "
    f"pd AS ({_PERIODS}) SELECT regime, period, feature, {_SM} FROM pd JOIN rg USING (dt) GROUP BY regime, period, feature"
)
def regime_metrics(spark, sf_dir):
    market = cross_section.market(with_returns(bars_d(spark, sf_dir), limit=LIMIT))
    return rounded(screening.regimes(_daily(spark, sf_dir), market, PERIODS["screen"], PERIODS))


_DIR = {"close_position_in_bar": -1, "high_low_range": 1, "intraday_return": -1, "volume_change_1": 1}
_FAM = {"close_position_in_bar": "bar", "high_low_range": "bar", "intraday_return": "bar", "volume_change_1": "volume"}
_CAND = {"all": sorted(_DIR), "only:bar": [n for n in sorted(_DIR) if _FAM[n] == "bar"], "only:volume": ["volume_change_1"], "drop:bar": ["volume_change_1"], "drop:volume": [n for n in sorted(_DIR) if _FAM[n] == "bar"]}
_dir = lambda n: f"(1 - coalesce({pct('f.' + n, 'f.dt')}, 0.5))" if _DIR[n] < 0 else f"coalesce({pct('f.' + n, 'f.dt')}, 0.5)"


@query(
    f"WITH {_f_sql(SCREENED, SQL_D)}, {SQL_RETURNS}, dr AS (SELECT f.entity, f.dt, p.y_ret_1d, p.flag_limit_up, {', '.join(f'{_dir(n)} AS {n}' for n in SCREENED)} FROM feats f JOIN panel p ON p.entity = f.entity AND p.dt = f.dt), cd AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS candidate, entity, dt, y_ret_1d, flag_limit_up, ({' + '.join(v)}) / {len(v)} AS pred FROM dr" for k, v in _CAND.items())
    + f"), rk AS (SELECT candidate, dt, {tie('round(pred, 9)', 'candidate, dt')} AS p, {tie('y_ret_1d', 'candidate, dt')} AS y FROM cd WHERE y_ret_1d IS NOT NULL), ic AS (SELECT candidate, dt, {corr('p', 'y')} AS ic FROM rk GROUP BY candidate, dt HAVING count(*) >= 30) SELECT candidate, {r('avg(ic)', 5)} AS ic_mean, count(*) AS days FROM ic GROUP BY candidate"
)
def family_ablation(spark, sf_dir):
    made = screening.ablation(_screened(spark, sf_dir), _DIR, _FAM).withColumn("pred", F.round("pred", 9))
    return rounded(evaluate.daily_ic(made, groups=["candidate"]).groupBy("candidate").agg(F.avg("ic").alias("ic_mean"), F.count(F.lit(1)).alias("days")), 5)


RULES = {"coverage": 0.6, "ic": 0.01, "icir": 0.1, "positive": 0.52, "years": 1}
CAPS = {"most": 3, "per_family": 2, "highest": 0.8}
_fam = lambda x: "CASE " + " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in _FAM.items()) + " END"
_RULES = (
    "sm AS (SELECT feature, avg(ic) AS m, CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) ELSE 0 END AS icir, "
    f"{d('sum(CASE WHEN ic > 0 THEN 1 ELSE 0 END)', 'count(ic)')} AS pos, {d('sum(available_rows)', 'sum(universe_rows)')} AS cov FROM fi GROUP BY feature), "
    "yr AS (SELECT feature, year(dt) AS y, avg(ic) AS m FROM fi GROUP BY 1, 2), ag AS (SELECT feature, sum(CASE WHEN sign(yr.m) = sign(sm.m) THEN 1 ELSE 0 END) AS years FROM yr JOIN sm USING (feature) GROUP BY feature), "
    f"el AS (SELECT feature, m, list_filter([CASE WHEN NOT coalesce(cov >= {RULES['coverage']}, false) THEN 'coverage' END, CASE WHEN NOT coalesce(abs(m) >= {RULES['ic']}, false) THEN 'ic' END, CASE WHEN NOT coalesce(abs(icir) >= {RULES['icir']}, false) THEN 'icir' END, "
    f"CASE WHEN NOT coalesce(CASE WHEN m < 0 THEN 1 - pos ELSE pos END >= {RULES['positive']}, false) THEN 'positive_ratio' END, CASE WHEN NOT coalesce(years >= {RULES['years']}, false) THEN 'years' END], lambda x: x IS NOT NULL) AS reasons FROM sm JOIN ag USING (feature))"
)
_CORR = (
    f"rr AS (SELECT dt, {', '.join(f'coalesce({pct(n, "dt")}, 0.5) AS {n}' for n in SCREENED)} FROM feats), pp AS ("
    + " UNION ALL ".join(f"SELECT dt, '{a}|{b}' AS k, count(*) AS n, {corr(a, b)} AS c FROM rr GROUP BY dt" for a, b in _PAIRS)
    + "), cr AS (SELECT k, avg(c) AS c FROM pp WHERE n >= 30 AND c IS NOT NULL GROUP BY k)"
)


@query(
    f"WITH RECURSIVE {_SP}, {_DI}, {_RULES}, {_CORR}, near AS (SELECT coalesce(list(k), []) AS ks FROM cr WHERE abs(c) > {CAPS['highest']}), od AS (SELECT *, row_number() OVER (ORDER BY abs(coalesce(m, 0)) DESC, feature) AS i FROM el), "
    "st AS (SELECT CAST(0 AS BIGINT) AS i, [NULL][1:0]::VARCHAR[] AS chosen, NULL::VARCHAR AS feature, [NULL][1:0]::VARCHAR[] AS reasons, NULL::VARCHAR AS close UNION ALL "
    "SELECT i, CASE WHEN len(reasons) = 0 THEN list_append(chosen, feature) ELSE chosen END, feature, reasons, close FROM ("
    "SELECT o.i, st.chosen, o.feature, CASE WHEN len(o.reasons) > 0 THEN NULL ELSE list_filter(st.chosen, lambda f: list_contains(near.ks, least(f, o.feature) || '|' || greatest(f, o.feature)))[1] END AS close, CASE WHEN len(o.reasons) > 0 THEN o.reasons ELSE "
    f"list_filter([CASE WHEN len(st.chosen) >= {CAPS['most']} THEN 'total' END, CASE WHEN len(list_filter(st.chosen, lambda f: {_fam('f')} = {_fam('o.feature')})) >= {CAPS['per_family']} THEN 'family' END, "
    "CASE WHEN len(list_filter(st.chosen, lambda f: list_contains(near.ks, least(f, o.feature) || '|' || greatest(f, o.feature)))) > 0 THEN 'correlation' END], lambda x: x IS NOT NULL) END AS reasons FROM st JOIN od o ON o.i = st.i + 1, near)) "
    "SELECT feature, len(reasons) = 0 AS selected, array_to_string(reasons, ',') AS reasons, close AS correlated_with FROM st WHERE i > 0"
)
def feature_selection(spark, sf_dir):
    """Greedy choice; the few rows it needs come to the driver."""
    daily = _daily(spark, sf_dir)
    yearly = screening.summarise(daily.withColumn("year", F.year("dt")), ["year"])
    rows = [x.asDict() for x in screening.eligible(screening.summarise(daily), yearly, **RULES).collect()]
    near = {(x.f1, x.f2): x.rank_corr for x in screening.rank_correlations(_screened(spark, sf_dir), SCREENED).collect()}
    near = {(min(k), max(k)): v for k, v in near.items()}
    out = screening.select(rows, near, _FAM, **CAPS, required=False)
    return spark.createDataFrame([(x["feature"], x["selected"], ",".join(x["reasons"]), x["correlated_with"]) for x in out], "feature string, selected boolean, reasons string, correlated_with string")


# --- recursion, blends, grids ---


def _second(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("pred", F.round(F.coalesce(safe_div(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5)), 6))


_SECOND = f"second AS (SELECT entity, dt, round(coalesce({d('close - low', 'high - low')}, 0.5), 6) AS pred FROM scored)"


@query(f"WITH {SQL_SCORED}, {_SECOND}, a AS (SELECT entity, dt, {pct('pred', 'dt')} AS x FROM scored), b AS (SELECT entity, dt, {pct('pred', 'dt')} AS x FROM second) SELECT a.entity, a.dt, {r('0.65 * a.x + 0.35 * b.x')} AS pred FROM a JOIN b ON a.entity = b.entity AND a.dt = b.dt")
def rank_blend(spark, sf_dir):
    return rounded(evaluate.blend([scored(spark, sf_dir), _second(spark, sf_dir)], [0.65, 0.35]))


@query(
    f"WITH RECURSIVE {SQL_SCORED}, rk AS (SELECT entity, dt, {pct('pred', 'dt')} AS rank, row_number() OVER ({E_W}) AS i FROM scored), e AS (SELECT entity, i, rank AS m FROM rk WHERE i = 1 UNION ALL SELECT s.entity, s.i, 0.5 * s.rank + 0.5 * e.m FROM e JOIN rk s ON s.entity = e.entity AND s.i = e.i + 1) "
    f"SELECT rk.entity, rk.dt, {r('rk.rank')} AS rank, {r('e.m')} AS smoothed FROM rk JOIN e ON e.entity = rk.entity AND e.i = rk.i"
)
def rank_ema(spark, sf_dir):
    return rounded(recursion.rank_ema(scored(spark, sf_dir), 0.5).select("entity", "dt", "rank", "smoothed"))


def _smooth_sql(alphas: tuple[float, ...]) -> str:
    """SQL: sm, smoothed scores by alpha, of the recursion over an entity's rows."""
    return (
        f"rk AS (SELECT entity, dt, flag_limit_up, y_ret_1d, {pct('pred', 'dt')} AS rank, row_number() OVER ({E_W}) AS i FROM scored), al AS (SELECT unnest([{', '.join(map(str, alphas))}]::DOUBLE[]) AS alpha), "
        "em AS (SELECT alpha, entity, i, rank AS m FROM rk, al WHERE i = 1 UNION ALL SELECT em.alpha, s.entity, s.i, em.alpha * s.rank + (1 - em.alpha) * em.m FROM em JOIN rk s ON s.entity = em.entity AND s.i = em.i + 1), "
        "sm AS (SELECT em.alpha, rk.entity, rk.dt, rk.flag_limit_up, rk.y_ret_1d, round(em.m, 9) AS smoothed FROM rk JOIN em ON em.entity = rk.entity AND em.i = rk.i)"
    )


def _hysteresis_sql(exits: tuple[float, ...]) -> str:
    """SQL: fin, the final scores of sm for each alpha and exit fraction; a recursion over dates carries the top set."""
    o = "PARTITION BY alpha, dt"
    return (
        f"od AS (SELECT *, row_number() OVER ({o} ORDER BY smoothed DESC, entity) AS pos, count(*) OVER ({o}) AS total, dense_rank() OVER (PARTITION BY alpha ORDER BY dt) AS i FROM sm), ex_ AS (SELECT unnest([{', '.join(map(str, exits))}]::DOUBLE[]) AS exit), "
        "dy AS (SELECT alpha, i, coalesce(list(entity ORDER BY pos) FILTER (flag_limit_up = 0), []) AS names FROM od GROUP BY alpha, i), "
        "hy AS (SELECT DISTINCT alpha, exit, CAST(0 AS BIGINT) AS i, [0][1:0]::BIGINT[] AS kept FROM sm, ex_ UNION ALL "
        "SELECT alpha, exit, i, CASE WHEN len(names) < 100 THEN [0][1:0]::BIGINT[] ELSE list_concat(stay, list_filter(names, lambda e: NOT list_contains(stay, e))[1:top - len(stay)]) END FROM ("
        "SELECT *, list_filter(names[1:greatest(top, CAST(floor(len(names) * exit) AS BIGINT))], lambda e: list_contains(kept, e))[1:top] AS stay FROM ("
        "SELECT h.alpha, h.exit, d.i, h.kept, d.names, greatest(len(d.names) // 10, 1) AS top FROM hy h JOIN dy d ON d.alpha = h.alpha AND d.i = h.i + 1))), "
        "ps AS (SELECT alpha, i, entity, (total - pos + 1) / CAST(total AS DOUBLE) AS ord, row_number() OVER (PARTITION BY alpha, i ORDER BY pos) AS slot FROM od WHERE flag_limit_up = 0), "
        "wn AS (SELECT p.alpha, h.exit, p.i, p.entity, row_number() OVER (PARTITION BY p.alpha, h.exit, p.i ORDER BY coalesce(nullif(list_position(h.kept, p.entity), 0), 1000000000), p.slot) AS w FROM ps p JOIN hy h ON h.alpha = p.alpha AND h.i = p.i), "
        "sc AS (SELECT wn.alpha, wn.exit, wn.i, wn.entity, ps.ord FROM wn JOIN ps ON ps.alpha = wn.alpha AND ps.i = wn.i AND ps.slot = wn.w), "
        "fin AS (SELECT od.alpha, ex_.exit, od.entity, od.dt, od.smoothed, od.flag_limit_up, od.y_ret_1d, coalesce(sc.ord, (od.total - od.pos + 1) / CAST(od.total AS DOUBLE)) AS final FROM od CROSS JOIN ex_ LEFT JOIN sc ON sc.alpha = od.alpha AND sc.exit = ex_.exit AND sc.i = od.i AND sc.entity = od.entity)"
    )


@query(f"WITH RECURSIVE {SQL_SCORED}, {_smooth_sql((0.5,))}, {_hysteresis_sql((0.15,))} SELECT entity, dt, {r('smoothed')} AS smoothed, flag_limit_up, {r('final')} AS final FROM fin")
def hysteresis(spark, sf_dir):
    smooth = recursion.rank_ema(scored(spark, sf_dir), 0.5).withColumn("smoothed", F.round("smoothed", 9))
    return rounded(recursion.hysteresis(smooth.select("entity", "dt", "smoothed", "flag_limit_up"), 0.15))


def _score_sql(table: str, score: str, by: str) -> str:
    """SQL: the eight metrics of a table of candidates, by its columns that name one."""
    g, on = f"{by}, dt", lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in by.split(", "))
    return (
        f"gi AS (SELECT {g}, {corr('p', 'y')} AS ic FROM (SELECT {g}, {tie(score, g)} AS p, {tie('y_ret_1d', g)} AS y FROM {table} WHERE y_ret_1d IS NOT NULL) GROUP BY {g} HAVING count(*) >= 30), "
        f"gp AS (SELECT *, count(*) OVER (PARTITION BY {g}) AS n, row_number() OVER (PARTITION BY {g} ORDER BY {score} DESC, entity) AS k FROM {table} WHERE flag_limit_up = 0 AND y_ret_1d IS NOT NULL), "
        f"ge AS (SELECT {g}, avg(CASE WHEN k <= greatest(n // 10, 1) THEN y_ret_1d END) AS top_ret, avg(CASE WHEN k <= greatest(n // 10, 1) THEN y_ret_1d END) - avg(y_ret_1d) AS excess FROM gp WHERE n >= 100 GROUP BY {g}), "
        f"gd AS (SELECT dt, row_number() OVER (ORDER BY dt) AS day FROM (SELECT DISTINCT dt FROM {table})), "
        f"gt AS (SELECT t.*, day FROM (SELECT {g}, entity, count(*) OVER (PARTITION BY {g}) AS n, row_number() OVER (PARTITION BY {g} ORDER BY {score} DESC, entity) AS k FROM {table} WHERE flag_limit_up = 0) t JOIN gd USING (dt) WHERE n >= 100 AND k <= greatest(n // 10, 1)), "
        f"gs AS (SELECT {by}, day, count(*) AS n FROM gt GROUP BY {by}, day), "
        f"gu AS (SELECT {', '.join(f'x.{c}' for c in by.split(', '))}, x.day, 1 - CAST(count(b.entity) AS DOUBLE) / (any_value(x.n) + any_value(y.n) - count(b.entity)) AS turnover FROM gs x JOIN gs y ON {on('x', 'y')} AND y.day = x.day - 1 JOIN gt a ON {on('a', 'x')} AND a.day = x.day LEFT JOIN gt b ON {on('b', 'a')} AND b.day = y.day AND b.entity = a.entity GROUP BY ALL), "
        f"m1 AS (SELECT {by}, CASE WHEN count(ic) = count(*) THEN avg(ic) END AS ic_mean, CASE WHEN count(ic) = count(*) THEN stddev_samp(ic) END AS ic_std, {d('sum(CASE WHEN ic > 0 THEN 1 ELSE 0 END)', 'count(*)')} AS ic_positive_ratio FROM gi GROUP BY {by}), "
        f"m2 AS (SELECT {by}, avg(excess) * 252 AS annual_excess, avg(top_ret) * 252 AS top1_annual_ret FROM ge GROUP BY {by}), m3 AS (SELECT {by}, avg(turnover) AS mean_turnover FROM gu GROUP BY {by}), "
        f"mt AS (SELECT {by}, ic_mean, ic_std, ic_positive_ratio, CASE WHEN ic_std > 0 THEN ic_mean / ic_std ELSE 0 END AS icir, annual_excess, top1_annual_ret, mean_turnover, 0.4 * ic_mean + 0.3 * annual_excess + 0.3 * (1 - mean_turnover) AS final_score FROM m1 FULL JOIN m2 USING ({by}) FULL JOIN m3 USING ({by}))"
    )


METRICS = ("ic_mean", "ic_std", "ic_positive_ratio", "icir", "annual_excess", "top1_annual_ret", "mean_turnover", "final_score")
ALPHAS, EXITS = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5), (0.1, 0.125, 0.15)


@query(f"WITH RECURSIVE {SQL_SCORED}, {_smooth_sql(ALPHAS)}, {_hysteresis_sql(EXITS)}, {_score_sql('fin', 'final', 'alpha, exit')} SELECT alpha, exit, {', '.join(f'{r(m, 5)} AS {m}' for m in METRICS)} FROM mt")
def turnover_grid(spark, sf_dir):
    """Every smoothing is computed once and shared by its exit fractions; one plan ranks, holds and scores all of them."""
    smooth = recursion.rank_ema(scored(spark, sf_dir), list(ALPHAS)).select("alpha", "entity", "dt", F.round("smoothed", 9).alias("smoothed"), "flag_limit_up", "y_ret_1d")
    grid = smooth.withColumn("exit", F.explode(F.array(*[F.lit(x) for x in EXITS])))
    held = recursion.hysteresis(grid, "exit", groups=["alpha", "exit"])
    scores = evaluate.summarise(held.withColumnRenamed("final", "pred"), groups=["alpha", "exit"])
    return scores.select("alpha", "exit", *[r6(m, 5).alias(m) for m in METRICS])


SIMPLEX = evaluate.simplex(3, 0.2)


def _third(spark, sf_dir):
    return scored(spark, sf_dir).withColumn("pred", F.round(F.coalesce(F.col("vol"), F.lit(0.0)), 6))


def _points(grid: list[tuple[float, ...]]) -> str:
    return f"g AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join((str(i), *(f'{w}::DOUBLE' for w in v))) + ')' for i, v in enumerate(grid))}) t(candidate, {', '.join(f'w{k}' for k in range(len(grid[0])))}))"


_RANKED = f"rr AS (SELECT a.entity, a.dt, a.y_ret_1d, a.flag_limit_up, {pct('a.pred', 'a.dt')} AS r0, {pct('b.pred', 'a.dt')} AS r1, {pct('coalesce(a.vol, 0)', 'a.dt')} AS r2 FROM scored a JOIN second b ON a.entity = b.entity AND a.dt = b.dt)"


def _grid_sql(grid: list[tuple[float, ...]]) -> str:
    mix = " + ".join(f"r{k} * w{k}" for k in range(len(grid[0])))
    return f"WITH {SQL_SCORED}, {_SECOND}, {_RANKED}, {_points(grid)}, cd AS (SELECT candidate, entity, dt, y_ret_1d, flag_limit_up, round({mix}, 9) AS pred FROM rr, g), {_score_sql('cd', 'pred', 'candidate')} SELECT CAST(candidate AS INTEGER) AS candidate, {', '.join(f'{r(m, 5)} AS {m}' for m in METRICS)} FROM mt"


def _grid_scores(made, labels):
    rows = joined_labels(made.withColumn("pred", F.round("pred", 9)), labels)
    scores = evaluate.summarise(rows, groups=["candidate"])
    return scores.select("candidate", *[r6(m, 5).alias(m) for m in METRICS])


@query(_grid_sql(SIMPLEX))
def simplex_grid(spark, sf_dir):
    """All eight metrics of each blend of three models."""
    made = evaluate.blend_grid([scored(spark, sf_dir), _second(spark, sf_dir), _third(spark, sf_dir)], SIMPLEX)
    return _grid_scores(made, scored(spark, sf_dir))


@query(_grid_sql([((20 - k) / 20, k / 20) for k in range(21)]))
def two_model_grid(spark, sf_dir):
    """21 blends of two models; the ends are the models alone."""
    return _grid_scores(evaluate.two_model_grid(scored(spark, sf_dir), _second(spark, sf_dir)), scored(spark, sf_dir))


_MD = "md AS (SELECT dt, stddev_samp(ret_1) AS v, avg(ret_1) AS m FROM panel GROUP BY dt)"


_SOURCES = "src AS (SELECT 'first' AS source, entity, dt, pred, y_ret_1d, flag_limit_up FROM scored UNION ALL SELECT 'second', s.entity, s.dt, x.pred, s.y_ret_1d, s.flag_limit_up FROM scored s JOIN second x ON x.entity = s.entity AND x.dt = s.dt)"
_SIDES = {"all": "true", "low_volatility": "v <= lv", "high_volatility": "v >= hv", "bearish_market": "m <= lm", "bullish_market": "m >= hm"}


@query(
    f"WITH {SQL_SCORED}, {_SECOND}, {_SOURCES}, {_score_sql('src', 'pred', 'source')}, {_MD}, "
    "th AS (SELECT quantile_cont(v, 0.25) AS lv, quantile_cont(v, 0.75) AS hv, quantile_cont(m, 0.25) AS lm, quantile_cont(m, 0.75) AS hm FROM md WHERE dt BETWEEN DATE '2024-01-01' AND DATE '2024-01-20'), "
    "al AS (SELECT a.source, a.dt, gi.ic, ge.excess, gu.turnover, md.v, md.m FROM (SELECT DISTINCT source, dt FROM src) a JOIN gd ON gd.dt = a.dt LEFT JOIN gi ON gi.source = a.source AND gi.dt = a.dt LEFT JOIN ge ON ge.source = a.source AND ge.dt = a.dt LEFT JOIN gu ON gu.source = a.source AND gu.day = gd.day LEFT JOIN md ON md.dt = a.dt), "
    f"rg AS ({' UNION ALL '.join(f"SELECT '{k}' AS regime, al.* FROM al, th WHERE {w}" for k, w in _SIDES.items())}) "
    f"SELECT source, regime, count(*) AS days, {r('avg(ic)')} AS ic_mean, {r('avg(excess) * 252')} AS annual_excess, {r('avg(turnover)')} AS mean_turnover, {r('0.4 * avg(ic) + 0.3 * avg(excess) * 252 + 0.3 * (1 - avg(turnover))')} AS score_proxy FROM rg GROUP BY source, regime"
)
def oof_regimes(spark, sf_dir):
    """Two sources on all dates and in four regimes, whose thresholds are quartiles over the screening period."""
    market = cross_section.market(with_returns(bars_d(spark, sf_dir), limit=LIMIT))
    first = scored(spark, sf_dir)
    second = joined_labels(_second(spark, sf_dir).select("entity", "dt", "pred"), first)
    cols = ["entity", "dt", "pred", "y_ret_1d", "flag_limit_up"]
    both = first.select(F.lit("first").alias("source"), *cols).unionByName(second.select(F.lit("second").alias("source"), *cols))
    return rounded(evaluate.regimes(both, market, evaluate.regime_thresholds(market, *PERIODS["screen"]), groups=["source"]))


def joined_labels(made, labels):
    return made.join(labels.select("entity", "dt", "y_ret_1d", "flag_limit_up"), ["entity", "dt"])


# --- models ---

X = ["close_position_in_bar", "position_5"]


def _view(spark, sf_dir):
    bars = with_returns(bars_w(spark, sf_dir), limit=LIMIT)
    return fx.compute(bars.drop("ret_1"), X, keep=["y_ret_1d", "flag_limit_up"])


_VIEW = f"{_f_sql(X, SQL_W)}, {SQL_RETURNS}, vw AS (SELECT f.entity, f.dt, p.y_ret_1d, p.flag_limit_up, coalesce(f.{X[0]}, 0) AS x1, coalesce(f.{X[1]}, 0) AS x2 FROM feats f JOIN panel p ON p.entity = f.entity AND p.dt = f.dt)"


@query(f"WITH {_VIEW} SELECT count(*) AS n, {r('sum(y_ret_1d)', 4)} AS sy, {', '.join(f'{r(f"sum({e})", 4)} AS {n}' for n, e in (('s1', 'x1'), ('s2', 'x2'), ('s11', 'x1 * x1'), ('s12', 'x1 * x2'), ('s22', 'x2 * x2'), ('s1y', 'x1 * y_ret_1d'), ('s2y', 'x2 * y_ret_1d')))} FROM vw WHERE y_ret_1d IS NOT NULL")
def ridge_gram(spark, sf_dir):
    g = models.gram(_view(spark, sf_dir), X)
    at = lambda c, k: F.get(c, F.lit(k))
    return rounded(g.select("n", "sy", at("sx", 0).alias("s1"), at("sx", 1).alias("s2"), at("sxx", 0).alias("s11"), at("sxx", 1).alias("s12"), at("sxx", 2).alias("s22"), at("sxy", 0).alias("s1y"), at("sxy", 1).alias("s2y")), 4)


_FIT = (
    "g AS (SELECT fold, count(*) AS n, sum(y_ret_1d) AS sy, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * x1) - sum(x1) * sum(x1) / count(*) + 100 AS a, sum(x1 * x2) - sum(x1) * sum(x2) / count(*) AS b, sum(x2 * x2) - sum(x2) * sum(x2) / count(*) + 100 AS c, "
    "sum(x1 * y_ret_1d) - sum(x1) * sum(y_ret_1d) / count(*) AS u, sum(x2 * y_ret_1d) - sum(x2) * sum(y_ret_1d) / count(*) AS v FROM vw JOIN folds USING (dt) WHERE role = 'train' AND y_ret_1d IS NOT NULL GROUP BY fold), "
    "fit AS (SELECT fold, n, sy, s1, s2, (c * u - b * v) / (a * c - b * b) AS w1, (a * v - b * u) / (a * c - b * b) AS w2 FROM g)"
)


@query(f"WITH {_VIEW}, {SQL_FOLDS}, {_FIT} SELECT fold, entity, dt, {r('CAST((sy - s1 * w1 - s2 * w2) / n + w1 * x1 + w2 * x2 AS FLOAT)', 4)} AS pred FROM vw JOIN folds USING (dt) JOIN fit USING (fold) WHERE role = 'validate'")
def ridge_oof(spark, sf_dir):
    view = _view(spark, sf_dir)
    return rounded(models.ridge_folds(view, splits.calendar(view, FOLDS), X).select("fold", "entity", "dt", "pred"), 4)


_TREE_BINS, _PATHS = 8, ("", "L", "R", "LL", "LR", "RL", "RR")


def _tree_sql() -> str:
    """SQL: a tree of depth 2 on squared error; each level finds every node's best split over features, cuts and sides."""
    cuts = " UNION ALL ".join(f"SELECT '{f}' AS f, unnest([{', '.join(f'round(quantile_cont({f}, {k / _TREE_BINS}), 6)' for k in range(1, _TREE_BINS))}]) AS cut FROM tv WHERE y IS NOT NULL" for f in X)
    out = [f"tv AS (SELECT {r('p.y_ret_1d')} AS y, {', '.join(f'{r(f"f.{x}")} AS {x}' for x in X)} FROM feats f JOIN panel p ON p.entity = f.entity AND p.dt = f.dt)", f"ed AS (SELECT DISTINCT f, cut FROM ({cuts}) WHERE cut IS NOT NULL)", "rw0 AS (SELECT 0 AS node, (SELECT avg(y) FROM tv) - y AS g, * FROM tv WHERE y IS NOT NULL)"]
    for level in (0, 1):
        long = " UNION ALL ".join(f"SELECT node, g, '{f}' AS f, {f} AS x FROM rw{level}" for f in X)
        out += [
            f"cd{level} AS (SELECT node, l.f, cut, side, sum(g) AS gt, count(*) AS nt, coalesce(sum(CASE WHEN coalesce(x <= cut, side) THEN g END), 0) AS gl, count(CASE WHEN coalesce(x <= cut, side) THEN 1 END) AS nl FROM ({long}) l JOIN ed ON ed.f = l.f, (SELECT unnest([true, false]) AS side) GROUP BY node, l.f, cut, side)",
            f"bs{level} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round((gl * gl / (nl + 1) + (gt - gl) * (gt - gl) / (nt - nl + 1) - gt * gt / (nt + 1)) / nt, 9) DESC, f, side DESC, cut) AS k FROM cd{level} WHERE nl >= 20 AND nt - nl >= 20) WHERE k = 1 AND gl * gl / (nl + 1) + (gt - gl) * (gt - gl) / (nt - nl + 1) - gt * gt / (nt + 1) > 1e-12)",
            f"rw{level + 1} AS (SELECT 2 * w.node + CASE WHEN coalesce(CASE b.f {' '.join(f"WHEN '{f}' THEN {f}" for f in X)} END <= cut, side) THEN 1 ELSE 2 END AS node, g, y, {', '.join(X)} FROM rw{level} w JOIN bs{level} b ON b.node = w.node)",
        ]
    path = f"CASE node {' '.join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_PATHS))} END"
    leaf = " UNION ALL ".join(f"SELECT node, g FROM rw{k}" for k in (0, 1, 2))
    return f"{_f_sql(X, SQL_W)}, {SQL_RETURNS}, {', '.join(out)}, sp AS (SELECT * FROM bs0 UNION ALL SELECT * FROM bs1) SELECT {path} AS path, f AS feature, {r('cut')} AS cut, side AS missing_left, CAST(NULL AS DOUBLE) AS value FROM sp UNION ALL SELECT {path}, NULL, NULL, NULL, {r('-sum(g) / (count(*) + 1)')} FROM ({leaf}) WHERE node NOT IN (SELECT node FROM sp) GROUP BY node"


@query(f"WITH {_tree_sql()}")
def boosted_tree(spark, sf_dir):
    """A first tree of depth 2 on coded bins: its splits and leaves."""
    rows = rounded(_view(spark, sf_dir).select("y_ret_1d", *X)).filter("y_ret_1d is not null")
    marks = [k / _TREE_BINS for k in range(1, _TREE_BINS)]
    row = rows.agg(F.avg("y_ret_1d").alias("base"), *[F.transform(F.percentile(f, marks), lambda v: F.round(v, 6)).alias(f) for f in X]).first()
    edges = {f: sorted(set(row[f] or [])) for f in X}
    tree = models.boost(rows, X, rounds=1, depth=2, edges=edges).trees[0]
    out, todo = [], [("", tree)]
    while todo:
        path, n = todo.pop()
        out.append((path, n.feature, n.cut if n.feature else None, n.missing_left if n.feature else None, None if n.feature else n.value))
        todo += [(path + "L", n.left), (path + "R", n.right)] if n.feature else []
    return rounded(spark.createDataFrame(out, "path string, feature string, cut double, missing_left boolean, value double"))


X6 = [*X, "ret_std_5", "close_ma_ratio_5", "volume_change_1", "position_20"]


def _view6(spark, sf_dir):
    bars = with_returns(bars_w(spark, sf_dir), limit=LIMIT)
    return fx.compute(bars.drop("ret_1"), X6, keep=["y_ret_1d", "flag_limit_up"])


@query()
def boosted_oof(spark, sf_dir):
    """Ten trees of fifteen leaves on six features, fitted before 2000, scored after."""
    view = _view6(spark, sf_dir)
    model = models.boost(view.filter(F.col("dt") < _D(2000, 1, 1)), X6, rounds=10, depth=None, leaves=15, bins=63, bagging=0.8, feature_fraction=0.8)
    return rounded(view.filter(F.col("dt") >= _D(2000, 1, 1)).select("entity", "dt", model.score().alias("pred")))


@query()
def ranker_ndcg(spark, sf_dir):
    """The ranker's daily NDCG after 2000: eight trees of eight leaves on six features."""
    view = _view6(spark, sf_dir)
    model = models.ranker(view.filter(F.col("dt") < _D(2000, 1, 1)), X6, rounds=8, depth=None, leaves=8, bins=63)
    return rounded(models.ndcg(view.filter(F.col("dt") >= _D(2000, 1, 1)).withColumn("pred", model.score())))


_PAIR = "CASE WHEN a.spread THEN abs(a.grade - b.grade) * abs(a.disc - b.disc) / a.ideal / (0.01 + abs(a.s - b.s)) ELSE abs(a.grade - b.grade) * abs(a.disc - b.disc) / a.ideal END"


@query(
    f"WITH {SQL_SCORED}, rs AS (SELECT *, round({pct('pred', 'dt')}, 6) AS s FROM scored), gr AS (SELECT entity, dt, s, CAST(least(greatest(ceil({pct('y_ret_1d', 'dt')} * 10) - 1, 0), 9) AS INTEGER) AS grade FROM rs WHERE y_ret_1d IS NOT NULL), "
    "pl AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY s DESC, entity) AS pos, row_number() OVER (PARTITION BY dt ORDER BY grade DESC) AS best, max(s) OVER (PARTITION BY dt) > min(s) OVER (PARTITION BY dt) AS spread FROM gr), "
    "di AS (SELECT *, 1 / log2(pos + 1) AS disc, sum(CASE WHEN best <= 500 THEN grade / log2(best + 1) END) OVER (PARTITION BY dt) AS ideal FROM pl), "
    f"lp AS (SELECT a.dt, a.entity AS ea, b.entity AS eb, sign(a.grade - b.grade) AS way, {_PAIR} AS change, 1 / (1 + exp(sign(a.grade - b.grade) * (a.s - b.s))) AS p FROM di a JOIN di b ON a.dt = b.dt AND a.pos < b.pos AND a.pos <= 500 AND a.grade <> b.grade WHERE a.ideal > 0), "
    "sd AS (SELECT dt, ea AS entity, -way * change * p AS g, change * p * (1 - p) AS h FROM lp UNION ALL SELECT dt, eb, way * change * p, change * p * (1 - p) FROM lp), "
    "tt AS (SELECT dt, log2(1 + 2 * sum(change * p)) / (2 * sum(change * p)) AS scale FROM lp GROUP BY dt), sm AS (SELECT dt, entity, sum(g) AS g, sum(h) AS h FROM sd GROUP BY dt, entity) "
    f"SELECT gr.entity, gr.dt, gr.grade, {r('coalesce(sm.g * scale, 0)')} AS gradient, {r('greatest(coalesce(sm.h * scale, 0), 1e-9)')} AS hessian FROM gr LEFT JOIN sm ON sm.entity = gr.entity AND sm.dt = gr.dt LEFT JOIN tt ON tt.dt = gr.dt"
)
def ranker_gradients(spark, sf_dir):
    """What a round of the ranker is fitted to: the gradients of all dates at given scores, with linear gains."""
    base = scored(spark, sf_dir).withColumn("_score", rank_pct(F.col("pred"), "dt")).filter("y_ret_1d is not null")
    base = base.select("entity", "dt", "y_ret_1d", F.round("_score", 6).alias("_score"), cross_section.relevance(F.col("y_ret_1d"), "dt").alias("_grade"))
    graded = models.lambda_gradients_by_blocks()(base)
    return rounded(graded.select("entity", "dt", F.col("_grade").alias("grade"), F.col("_g").alias("gradient"), F.col("_h").alias("hessian")))


@query(f"WITH {SQL_M}, {SQL_RETURNS} SELECT CAST(least(greatest(ceil(q * 10) - 1, 0), 9) AS INTEGER) AS grade, count(*) AS rows FROM (SELECT {pct('y_ret_1d', 'dt')} AS q FROM panel WHERE y_ret_1d IS NOT NULL) GROUP BY 1")
def relevance_histogram(spark, sf_dir):
    return models.grades(with_returns(bars_m(spark, sf_dir)))


@query(f"WITH {SQL_SCORED}, {_SECOND}, j AS (SELECT a.entity, a.dt, {pct('a.pred', 'a.dt')} AS r0, {pct('b.pred', 'a.dt')} AS r1, {pct('coalesce(a.vol, 0)', 'a.dt')} AS r2 FROM scored a JOIN second b ON a.entity = b.entity AND a.dt = b.dt), k AS (SELECT entity, dt, r2, round(0.65 * r0 + 0.35 * r1, 9) AS s FROM j) SELECT entity, dt, {r(f'0.6 * {pct("s", "dt")} + 0.4 * r2')} AS pred FROM k")
def nested_blend(spark, sf_dir):
    a, b = scored(spark, sf_dir), _second(spark, sf_dir).select("entity", "dt", F.col("pred").alias("p1"))
    rows = joined_one_to_one(a.select("entity", "dt", F.col("pred").alias("p0"), F.coalesce("vol", F.lit(0.0)).alias("p2")), b, ["entity", "dt"])
    return rounded(models.nested_blend(rows, ["p0", "p1", "p2"], (0.65, 0.35), (0.6, 0.4)).select("entity", "dt", "pred"))


WINDOWS = {"one": 1, "two": 2, "all": None}
_WINDOWED = (
    "lo AS (SELECT fold, min(year(dt)) AS y FROM folds WHERE role = 'validate' GROUP BY fold), "
    f"wf AS (SELECT w.name, f.fold, f.dt, f.role FROM folds f JOIN lo ON lo.fold = f.fold, (VALUES {', '.join(f"('{k}', {99 if y is None else y})" for k, y in WINDOWS.items())}) w(name, years) WHERE f.role <> 'train' OR f.dt >= make_date(CAST(lo.y - w.years AS INTEGER), 1, 1)), "
    "wg AS (SELECT name, fold, count(*) AS n, sum(y_ret_1d) AS sy, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * x1) - sum(x1) * sum(x1) / count(*) + 100 AS a, sum(x1 * x2) - sum(x1) * sum(x2) / count(*) AS b, sum(x2 * x2) - sum(x2) * sum(x2) / count(*) + 100 AS c, "
    "sum(x1 * y_ret_1d) - sum(x1) * sum(y_ret_1d) / count(*) AS u, sum(x2 * y_ret_1d) - sum(x2) * sum(y_ret_1d) / count(*) AS v FROM vw JOIN wf USING (dt) WHERE role = 'train' AND y_ret_1d IS NOT NULL GROUP BY name, fold), "
    "wt AS (SELECT name, fold, n, sy, s1, s2, (c * u - b * v) / (a * c - b * b) AS w1, (a * v - b * u) / (a * c - b * b) AS w2 FROM wg), "
    "wp AS (SELECT wt.name, wt.fold, vw.entity, vw.dt, vw.y_ret_1d, (sy - s1 * w1 - s2 * w2) / n + w1 * x1 + w2 * x2 AS pred FROM vw JOIN wf USING (dt) JOIN wt ON wt.name = wf.name AND wt.fold = wf.fold WHERE role = 'validate')"
)
_WI = f"wi AS (SELECT name, fold, dt, {corr('p', 'y')} AS ic FROM (SELECT name, fold, dt, {tie('pred', 'name, fold, dt')} AS p, {tie('y_ret_1d', 'name, fold, dt')} AS y FROM wp WHERE y_ret_1d IS NOT NULL) GROUP BY name, fold, dt HAVING count(*) >= 30)"


@query(f"WITH {_VIEW}, {SQL_FOLDS}, {_WINDOWED}, {_WI}, er AS (SELECT name, fold, sqrt(avg((pred - y_ret_1d) * (pred - y_ret_1d))) AS rmse, count(*) AS n FROM wp WHERE y_ret_1d IS NOT NULL GROUP BY name, fold) SELECT er.name AS training, er.fold, {r('avg(ic)', 5)} AS ic_mean, {r('stddev_samp(ic)', 5)} AS ic_std, count(ic) AS ic_days, {r('any_value(rmse)', 4)} AS rmse, any_value(er.n) AS rows FROM er LEFT JOIN wi ON wi.name = er.name AND wi.fold = er.fold GROUP BY er.name, er.fold")
def stability_matrix(spark, sf_dir):
    """Three training windows by three folds: fitted by one aggregate, predicted by one join, scored in one plan."""
    view = _view(spark, sf_dir)
    dates = runs.windowed(splits.calendar(view, FOLDS), WINDOWS)
    out = runs.ridge_out_of_fold(view, dates, X, ["training", "fold"])
    ic = evaluate.daily_ic(out, groups=["training", "fold"]).groupBy("training", "fold").agg(F.avg("ic").alias("ic_mean"), F.stddev_samp("ic").alias("ic_std"), F.count("ic").alias("ic_days"))
    rows = evaluate.errors(out, groups=["training", "fold"]).join(ic, ["training", "fold"], "left")
    return rows.select("training", "fold", r6("ic_mean", 5).alias("ic_mean"), r6("ic_std", 5).alias("ic_std"), F.coalesce("ic_days", F.lit(0)).alias("ic_days"), r6("rmse", 4).alias("rmse"), "rows")


LOCKED = {"slow": {"kind": "ridge", "features": X}, "plain": {"kind": "ridge", "features": X[1:]}, "unused": {"kind": "boosted", "features": X}}
LOCKED_WEIGHTS = {"slow": 0.6, "plain": 0.4, "unused": 0.0}


@query(f"WITH {_VIEW}, g AS (SELECT count(*) AS n, sum(y_ret_1d) AS sy, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * x1) - sum(x1) * sum(x1) / count(*) + 100 AS a, sum(x1 * x2) - sum(x1) * sum(x2) / count(*) AS b, sum(x2 * x2) - sum(x2) * sum(x2) / count(*) + 100 AS c, "
    "sum(x1 * y_ret_1d) - sum(x1) * sum(y_ret_1d) / count(*) AS u, sum(x2 * y_ret_1d) - sum(x2) * sum(y_ret_1d) / count(*) AS v FROM vw WHERE y_ret_1d IS NOT NULL), fit AS (SELECT n, sy, s1, s2, (c * u - b * v) / (a * c - b * b) AS w1, (a * v - b * u) / (a * c - b * b) AS w2, v / c AS w3 FROM g), "
    f"sc AS (SELECT entity, dt, flag_limit_up, round((sy - s1 * w1 - s2 * w2) / n + w1 * x1 + w2 * x2, 6) AS s, round((sy - s2 * w3) / n + w3 * x2, 6) AS t FROM vw, fit) SELECT entity, dt, flag_limit_up, {r(f'0.6 * {pct("s", "dt")} + 0.4 * {pct("t", "dt")}')} AS pred FROM sc")
def full_refit(spark, sf_dir):
    """Components with a weight refitted on the full history, written to a model's plain values, read back and blended."""
    view = _view(spark, sf_dir)
    fitted = {k: delivery.model_of(delivery.model_state(m)) for k, m in delivery.refit(view, LOCKED, LOCKED_WEIGHTS).items()}
    scored_ = [view.select("entity", "dt", F.round(m.score(), 6).alias("pred")) for m in fitted.values()]
    blended = evaluate.blend(scored_, [LOCKED_WEIGHTS[k] for k in fitted])
    return rounded(view.select("entity", "dt", "flag_limit_up").join(blended, ["entity", "dt"]))


# --- audits and provenance ---


@query(f"WITH {SQL_W}, k AS (SELECT year(dt) AS y, entity, dt, count(*) AS n FROM bars GROUP BY 1, 2, 3) SELECT CAST(y AS INTEGER) AS year, CAST(sum(n) AS BIGINT) AS rows, count(DISTINCT entity) AS entities, CAST(sum(CAST('0x' || substr(md5('=' || entity || '|=' || dt), 1, 15) AS HUGEINT)) % 18446744073709551616 AS VARCHAR) AS key_hash, CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS repeated, min(dt) AS first_date, max(dt) AS last_date FROM k GROUP BY y")
def year_store_manifest(spark, sf_dir):
    return store.manifest(bars_w(spark, sf_dir))


@query(f"WITH {SQL_W}, a AS (SELECT entity, dt, close FROM bars), b AS (SELECT entity, dt, CASE WHEN entity % 10 = 0 THEN close + 1 ELSE close END AS close FROM bars WHERE entity % 7 <> 0) SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.dt, b.dt) AS dt FROM a FULL JOIN b ON a.entity = b.entity AND a.dt = b.dt WHERE a.entity IS NULL OR b.entity IS NULL OR a.close IS DISTINCT FROM b.close")
def key_reconcile(spark, sf_dir):
    """Keys at which a damaged copy of the panel differs from it."""
    a = bars_w(spark, sf_dir).select("entity", "dt", "close")
    b = a.filter("entity % 7 <> 0").withColumn("close", F.when(F.col("entity") % 10 == 0, F.col("close") + 1).otherwise(F.col("close")))
    return aligned_differences(a, b, ["entity", "dt"], ["close"])


@query(f"WITH {SQL_W} SELECT count(*) AS rows, {_HASH} AS key_hash FROM bars")
def panel_key_hash(spark, sf_dir):
    return bars_w(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), key_hash("entity", "dt").alias("key_hash"))


_SUB = "sub AS (SELECT lpad(CAST(entity AS VARCHAR), 6, '0') || '.SZ' AS ts_code, CAST(strftime(dt, '%Y%m%d') AS INTEGER) AS trade_date, pred FROM scored)"


@query(f"WITH {SQL_SCORED}, {_SUB} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS bad_entity, CAST(0 AS BIGINT) AS bad_date, CAST(0 AS BIGINT) AS not_finite, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS extra_keys, (SELECT count(*) FROM sub WHERE substr(ts_code, 6, 1) = '3') AS absent_keys FROM sub WHERE substr(ts_code, 6, 1) <> '3'")
def submission_check(spark, sf_dir):
    """A submission from which some codes are absent."""
    sub = scored(spark, sf_dir).select(F.concat(F.lpad(F.col("entity").cast("string"), 6, "0"), F.lit(".SZ")).alias("ts_code"), F.date_format("dt", "yyyyMMdd").cast("int").alias("trade_date"), "pred")
    return audits.submission_report(sub.filter(F.substring("ts_code", 6, 1) != "3"), sub)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS experiment_id, o_orderstatus AS record_type, CAST(o_custkey % 3 AS VARCHAR) AS fold, CAST(o_totalprice AS VARCHAR) AS value FROM orders")
def registry_append(spark, sf_dir):
    """An append of rows some of which are registered already."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("experiment_id"), F.col("o_orderstatus").alias("record_type"), (F.col("o_custkey") % 3).cast("string").alias("fold"), F.col("o_totalprice").cast("string").alias("value"), F.col("o_orderkey").alias("_k"))
    return store.append(o.filter("_k % 5 < 3").drop("_k"), o.filter("_k % 5 > 1").drop("_k"))


@query(
    f"WITH {SQL_W} " + " UNION ALL ".join(f"SELECT '{c}' AS column, {r(f'max(abs({c} - CAST(CAST({c} AS FLOAT) AS DOUBLE)))', 4)} AS max_abs_error, {r(f'max(CASE WHEN {c} <> 0 THEN abs({c} - CAST(CAST({c} AS FLOAT) AS DOUBLE)) / abs({c}) END)', 9)} AS max_rel_error FROM bars" for c in ("open", "close", "amount"))
)
def float_precision(spark, sf_dir):
    out = audits.precision(bars_w(spark, sf_dir), ["open", "close", "amount"])
    return out.select("column", r6("max_abs_error", 4).alias("max_abs_error"), r6("max_rel_error", 9).alias("max_rel_error"))


@query(f"WITH {SQL_W}, v AS (SELECT {d('close * vol', 'amount')} AS x FROM bars) SELECT {', '.join(f'{r(f"quantile_cont(x, {q})")} AS {n}' for q, n in ((0.05, 'q05'), (0.25, 'q25'), (0.5, 'q50'), (0.75, 'q75'), (0.95, 'q95')))} FROM v")
def vwap_scale(spark, sf_dir):
    return rounded(audits.vwap_scale(bars_w(spark, sf_dir)))


@query(f"WITH {SQL_W}, o AS (SELECT entity, dt, lag(entity) OVER (ORDER BY dt, entity) AS pe, lag(dt) OVER (ORDER BY dt, entity) AS pd FROM bars) SELECT count(*) AS unsorted FROM o WHERE entity < pe OR (entity = pe AND dt < pd)")
def sortedness(spark, sf_dir):
    """Rows out of (entity, date) order in a panel that is stored by date."""
    p = bars_w(spark, sf_dir)
    return audits.unsorted_rows(p.withColumn("_order", F.struct("dt", "entity")))


