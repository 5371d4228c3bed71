"""The panels that queries run on, derived from the driver's tables; each as a DataFrame and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import safe_div
from strandline.operators.panel import densify, with_returns

LIMIT = 15.0
#: Moves exact halves, which the two engines round differently, off the half.
NUDGE = 3.3e-10
FIRST_SCORED = "2024-01-02"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round((F.col(x) if isinstance(x, str) else x) + NUDGE, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[r6(F.col(c).cast("double"), digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _bars(rows: DataFrame, order: list[str]) -> DataFrame:
    key = F.struct(*order)
    return rows.groupBy("entity", "dt").agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("q").alias("vol"), F.sum("a").alias("amount"))


_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "a"]


def _lines(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("entity"), F.to_date(F.date_trunc(unit, "l_shipdate")).alias("dt"), safe_div(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("a"), "l_shipdate", "l_orderkey", "l_linenumber")


def bars_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier by week, observed weeks only."""
    return _bars(_lines(spark, sf_dir, "week"), _ORDER)


def bars_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier by month, dense."""
    return densify(_bars(_lines(spark, sf_dir, "month"), _ORDER))


def bars_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User by day, dense."""
    ev = read(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.to_date("ts").alias("dt"), F.col("value").alias("price"), F.lit(1.0).alias("q"), F.col("value").alias("a"), "ts")
    return densify(_bars(ev, ["ts"]))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bars_d with returns, the flag and a deterministic prediction, from the second day."""
    p = with_returns(bars_d(spark, sf_dir), limit=LIMIT)
    return p.filter(F.col("dt") >= F.lit(FIRST_SCORED).cast("date")).withColumn("pred", F.coalesce(-F.round("ret_1", 6), F.lit(0.0)))


# --- the same for DuckDB ---

_AGG = "first(price ORDER BY {o}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {o}) AS close, sum(q) AS vol, sum(a) AS amount"
_DENSE = "SELECT c.entity, c.dt, o.open, o.high, o.low, o.close, o.vol, o.amount FROM (SELECT e.entity, d.dt FROM (SELECT DISTINCT entity FROM obs) e CROSS JOIN (SELECT DISTINCT dt FROM obs) d) c LEFT JOIN obs o ON o.entity = c.entity AND o.dt = c.dt"


def _sql_lines(unit: str) -> str:
    o = "l_shipdate, l_orderkey, l_linenumber, a"
    return (
        f"lines AS (SELECT l_suppkey AS entity, CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS dt, CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS price, l_quantity AS q, l_extendedprice AS a, l_shipdate, l_orderkey, l_linenumber FROM lineitem), "
        f"obs AS (SELECT entity, dt, {_AGG.format(o=o)} FROM lines GROUP BY entity, dt)"
    )


SQL_W = f"{_sql_lines('week')}, bars AS (SELECT * FROM obs)"
SQL_M = f"{_sql_lines('month')}, bars AS ({_DENSE})"
SQL_D = (
    "lines AS (SELECT user_id AS entity, CAST(ts AS DATE) AS dt, value AS price, 1.0::DOUBLE AS q, value AS a, ts FROM events), "
    f"obs AS (SELECT entity, dt, {_AGG.format(o='ts')} FROM lines GROUP BY entity, dt), bars AS ({_DENSE})"
)


def d(a: str, b: str) -> str:
    """a / b, NULL for a zero divisor."""
    return f"(CASE WHEN ({b}) <> 0 THEN CAST(({a}) AS DOUBLE) / ({b}) END)"


def r(x: str, digits: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE) + {NUDGE}, {digits}) + 0.0::DOUBLE)"


E_W = "PARTITION BY entity ORDER BY dt"
SQL_RETURNS = (
    f"pr AS (SELECT *, {d('close', f'lag(close) OVER ({E_W})')} - 1 AS ret_1, {d(f'lead(close) OVER ({E_W})', 'close')} - 1 AS y_ret_1d FROM bars), "
    f"panel AS (SELECT *, CAST(coalesce(ret_1 >= {LIMIT}, false) AS INTEGER) AS flag_limit_up FROM pr)"
)
SQL_SCORED = f"{SQL_D}, {SQL_RETURNS}, scored AS (SELECT *, coalesce(-round(ret_1, 6), 0.0::DOUBLE) AS pred FROM panel WHERE dt >= DATE '{FIRST_SCORED}')"


def tie(x: str, part: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {part} ORDER BY {x} ASC NULLS LAST) + (count({x}) OVER (PARTITION BY {part}, {x}) - 1) / 2.0::DOUBLE END)"


def pct(x: str, part: str) -> str:
    return f"({tie(x, part)} / count({x}) OVER (PARTITION BY {part}))"


def corr(x: str, y: str) -> str:
    """Aggregate correlation of rows that have both, NULL where a side is constant."""
    return f"(CASE WHEN stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) > 0 AND stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END) > 0 THEN covar_pop({x}, {y}) / (stddev_pop(CASE WHEN {y} IS NOT NULL THEN {x} END) * stddev_pop(CASE WHEN {x} IS NOT NULL THEN {y} END)) END)"
