"""Reading panels of daily bars: typed CSV, Parquet caches that know what they were made from, projected scans, tails."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.panel import ContractError, normalise, require_columns

from .files import atomic_json

#: The columns of the raw bars.
BARS = (
    ("ts_code", T.StringType()), ("trade_date", T.IntegerType()), ("open", T.FloatType()), ("high", T.FloatType()), ("low", T.FloatType()), ("close", T.FloatType()), ("vol", T.FloatType()), ("amount", T.FloatType()),
    ("flag_limit_up", T.ByteType()), ("flag_limit_down", T.ByteType()),
)
LABEL = ("y_ret_1d", T.FloatType())
CACHE_VERSION = 1


def schema(labelled: bool, double: bool = False) -> T.StructType:
    fields = [*BARS, LABEL] if labelled else list(BARS)
    return T.StructType([T.StructField(n, T.DoubleType() if double and isinstance(t, T.FloatType) else t) for n, t in fields])


def header(spark: SparkSession, path: str) -> list[str]:
    line = spark.read.text(path).first()
    return line[0].split(",") if line else []


def scan_csv(spark: SparkSession, path: str, labelled: bool, columns: list[str] | None = None, double: bool = False) -> DataFrame:
    """A typed CSV with a header, projected; a required column that is absent is an error. Splits are Spark's own."""
    want = schema(labelled, double)
    have = header(spark, path)
    absent = [c for c in (columns or want.fieldNames()) if c not in have]
    if absent:
        raise ContractError(f"{path} lacks {', '.join(absent)}")
    by_name = {f.name: f for f in want}
    actual = T.StructType([by_name.get(c, T.StructField(c, T.StringType())) for c in have])
    df = spark.read.schema(actual).option("header", True).option("enforceSchema", True).csv(path)
    return normalise(df.select(*(columns or want.fieldNames())))


def identity(path: str) -> dict:
    s = os.stat(path)
    return {"version": CACHE_VERSION, "path": os.path.abspath(path), "size": s.st_size, "mtime_ns": s.st_mtime_ns}


def is_fresh(cache: str, path: str) -> bool:
    """Whether a cache was made from the file as it is now."""
    side = f"{cache}.json"
    if not (os.path.exists(side) and os.path.exists(cache)):
        return False
    with open(side) as f:
        return json.load(f).get("source") == identity(path)


def load(spark: SparkSession, path: str, labelled: bool, cache: str | None = None, refresh: bool = False) -> DataFrame:
    """The cache if it is fresh, else the CSV; with a cache folder, the cache is written anew."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no {'train' if labelled else 'test'} bars at {path}")
    if cache and not refresh and is_fresh(cache, path):
        return spark.read.parquet(cache)
    df = scan_csv(spark, path, labelled)
    if not cache:
        return df
    before = identity(path)
    df.write.mode("overwrite").option("compression", "zstd").parquet(cache)
    out = spark.read.parquet(cache)
    atomic_json(f"{cache}.json", {"source": before, "rows": out.count(), "columns": out.columns, "types": dict(out.dtypes)})
    return out


_OPS = {"==": lambda c, v: c == v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, "in": lambda c, v: c.isin(list(v))}


def scan(df: DataFrame, columns: list[str], filters: list[tuple] = ()) -> DataFrame:
    """Columns (without repeats) under conjunctive filters (column, operator, value). Both reach a Parquet scan; a filter
    on trade_date also prunes a partitioning by year, which Catalyst can't infer."""
    names = list(dict.fromkeys(columns))
    if not names:
        raise ContractError("no columns asked for")
    require_columns(df, [*names, *[f[0] for f in filters]])
    for name, op, value in filters:
        if op not in _OPS:
            raise ContractError(f"filter {op} isn't supported")
        df = df.filter(_OPS[op](F.col(name), value))
        if name == "trade_date" and "year" in df.columns and op in ("==", ">=", "<="):
            df = df.filter(_OPS[op](F.col("year"), value // 10000))
    return df.select(*names)


def last_dates(df: DataFrame, n: int, date: str = "trade_date", exact: bool = False) -> DataFrame:
    """The last n distinct dates; exact: fewer are an error."""
    if n < 1:
        raise ContractError("at least one date must be asked for")
    out = df.select(date).distinct().orderBy(F.col(date).desc()).limit(n)
    if exact and (found := out.count()) != n:
        raise ContractError(f"{found} dates, {n} asked for")
    return out


def tail(df: DataFrame, n: int = 250, date: str = "trade_date") -> DataFrame:
    """The rows of the last n dates. Only their first date comes to the driver, so the scan filters by a literal."""
    first = last_dates(df, n, date).agg(F.min(date)).first()[0]
    return df.filter(F.col(date) >= F.lit(first)) if first is not None else df.limit(0)


def labelled_dates(df: DataFrame, label: str = "y_ret_1d", date: str = "trade_date") -> DataFrame:
    return df.filter(F.col(label).isNotNull()).select(date).distinct().orderBy(date)


def years(spark: SparkSession, store: str, columns: list[str], dates: DataFrame, entity: str = "ts_code", date: str = "trade_date") -> DataFrame:
    """Rows of a yearly store on given dates: pruned to their years, checked for repeats and emptiness."""
    wanted = [r[0] for r in dates.select(F.floor(F.col(date) / 10000).cast("int")).distinct().collect()]
    df = spark.read.parquet(store).filter(F.col("year").isin(wanted)).join(dates.select(date), date, "left_semi").select(*columns)
    if df.isEmpty():
        raise ContractError("no rows on these dates")
    if not df.groupBy(entity, date).count().filter("count > 1").isEmpty():
        raise ContractError("rows repeat their key")
    return df
