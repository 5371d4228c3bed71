"""Data quality: distributions, label alignment, rules on bars, precision, contracts of a submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import finite, safe_div

from .panel import KEYS, ContractError, Keys, duplicates, key_hash
from .quantiles import exact_quantiles

#: The quantiles that label reports give.
QUANTILES = (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
BARS_PRICES = ("open", "high", "low", "close")


def _share(cond: Column) -> Column:
    return F.sum(F.coalesce(cond, F.lit(False)).cast("long"))


def distribution(df: DataFrame, x: str = "y_ret_1d", quantiles: tuple[float, ...] = QUANTILES, large: tuple[float, ...] = (0.1, 0.2, 0.5)) -> DataFrame:
    v = finite(F.col(x).cast("double"))
    infinite = _share(F.abs(F.col(x)) == float("inf"))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count(v).alias("present"), infinite.alias("infinite"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), *[_share(F.abs(v) >= t).alias(f"abs_ge_{str(t).replace('.', '_')}") for t in large])
    out = row.withColumns({"missing": F.col("rows") - F.col("present"), "missing_rate": safe_div(F.col("rows") - F.col("present"), F.col("rows"))})
    out = out.withColumn("_one", F.lit(1)).join(exact_quantiles(df, v, list(quantiles), into="_q").withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    return out.withColumns({f"q{str(q).replace('0.', '')}": F.get("_q", F.lit(k)) for k, q in enumerate(quantiles)}).drop("_q")


def by_period(df: DataFrame, x: str = "y_ret_1d", date: str = "dt") -> DataFrame:
    """kind (year or date), period and the figures of both groupings: one GROUPING SETS plan, and one selection of the
    quantiles of both."""
    src = df.select(F.year(date).cast("string").alias("_y"), F.col(date).cast("string").alias("_d"), F.col(x).cast("double").alias("_x"))
    out = src.groupingSets([["_y"], ["_d"]], "_y", "_d").agg(
        F.count(F.lit(1)).alias("size"), F.count("_x").alias("count"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max"), F.grouping("_d").alias("_set"),
    )
    kind = F.when(F.col("_set") == 1, "year").otherwise("date")  # a null date is a date still
    out = out.select(kind.alias("kind"), F.coalesce("_d", "_y").alias("period"), "size", "count", "mean", "std", "min", "max", (F.col("size") - F.col("count")).alias("missing"), safe_div(F.col("size") - F.col("count"), F.col("size")).alias("missing_rate"))
    both = src.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("period")) for k, c in (("year", "_y"), ("date", "_d"))])).alias("p"), "_x").select("p.*", "_x")
    marks = exact_quantiles(both, F.col("_x"), [0.01, 0.5, 0.99], ["kind", "period"], "_q").alias("m")
    joined = out.alias("o").join(marks, (F.col("o.kind") == F.col("m.kind")) & F.col("o.period").eqNullSafe(F.col("m.period")), "left")
    return joined.select("o.*", *[F.get("m._q", F.lit(k)).alias(n) for k, n in enumerate(("q01", "q50", "q99"))])


def alignment(df: DataFrame, keys: Keys = KEYS, label: str = "y_ret_1d", future: DataFrame | None = None, atol: float = 1e-9, rtol: float = 1e-7) -> DataFrame:
    """Which definition the label follows: return to the next row, or to the next row with a close. One row for each:
    comparable, matching, match_rate, errors, agreement on what is missing. future: later prices, beyond the labels."""
    own = df.select(*keys.both, F.col("close").cast("double").alias("close"), F.col(label).cast("double").alias("_label"), F.lit(True).alias("_own"))
    if future is not None:
        own = own.unionByName(future.select(*keys.both, F.col("close").cast("double").alias("close"), F.lit(None).cast("double").alias("_label"), F.lit(False).alias("_own")))
    w = keys.by_entity()
    seen = own.select("_own", "_label", (safe_div(F.lead("close").over(w), F.col("close")) - 1).alias("next_row"), (safe_div(F.first("close", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.col("close")) - 1).alias("next_close")).filter("_own")
    long = seen.select("_label", F.explode(F.array(*[F.struct(F.lit(k).alias("definition"), F.col(k).alias("v")) for k in ("next_row", "next_close")])).alias("x")).select("_label", "x.*")
    both = F.col("_label").isNotNull() & F.col("v").isNotNull()
    error = F.when(both, F.abs(F.col("_label") - F.col("v")))
    close = error <= atol + rtol * F.abs(F.col("v"))
    return long.groupBy("definition").agg(
        _share(both).alias("comparable"), _share(close).alias("matching"), safe_div(_share(close), _share(both)).alias("match_rate"), F.avg(error).alias("mean_abs_error"), F.max(error).alias("max_abs_error"),
        safe_div(_share(F.col("_label").isNull() == F.col("v").isNull()), F.count(F.lit(1))).alias("mask_agreement"), _share(F.col("_label").isNull() & F.col("v").isNotNull()).alias("label_missing_only"), _share(F.col("_label").isNotNull() & F.col("v").isNull()).alias("label_present_only"),
    )


def best_definition(audit: DataFrame) -> DataFrame:
    """The row of alignment() that the label follows: most matching rows, then most rows that agree on what is missing; the
    next row if these tie too."""
    return audit.orderBy(F.col("matching").desc(), F.col("mask_agreement").desc_nulls_last(), (F.col("definition") != "next_row").cast("int")).limit(1)


def mismatches(df: DataFrame, n: int = 20, keys: Keys = KEYS, label: str = "y_ret_1d", atol: float = 1e-9, rtol: float = 1e-7) -> DataFrame:
    """The first n rows, by key, at which the label or what is missing disagrees with either definition: keys, close, label,
    what each definition gives."""
    w = keys.by_entity()
    later = {"next_row": F.lead("close").over(w), "next_close": F.first("close", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))}
    rows = df.select(*keys.both, F.col("close").cast("double").alias("close"), F.col(label).cast("double").alias("label"), *[(safe_div(x, F.col("close")) - 1).alias(k) for k, x in later.items()])
    off = lambda k: F.when(F.col("label").isNull() | F.col(k).isNull(), F.col("label").isNull() != F.col(k).isNull()).otherwise(F.abs(F.col("label") - F.col(k)) > atol + rtol * F.abs(F.col(k)))
    return rows.filter(off("next_row") | off("next_close")).orderBy(*keys.both).limit(n)


def quality(df: DataFrame, keys: Keys = KEYS, flags: tuple[str, ...] = ("flag_limit_up",)) -> DataFrame:
    """One row of counts over the bars: size, keys and their hash, missing and infinite values, violations; all but missing
    values count for passed. Order and types have checks of their own (unsorted_rows, schema_differences). The key's duplicates and the size of the
    dates are aggregates of their own, joined as rows of one."""
    prices = [F.col(p) for p in BARS_PRICES]
    all_there = prices[0].isNotNull()
    for p in prices[1:]:
        all_there = all_there & p.isNotNull()
    bad_bar = all_there & ((F.col("high") < F.greatest(*prices)) | (F.col("low") > F.least(*prices)))
    main = df.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(keys.entity).alias("entities"), F.countDistinct(keys.date).alias("dates"), F.min(keys.date).alias("first_date"), F.max(keys.date).alias("last_date"), _share(bad_bar).alias("ohlc_violations"),
        _share(F.col("vol") < 0).alias("negative_vol"), _share(F.col("amount") < 0).alias("negative_amount"), *[_share(~F.col(f).isin(0, 1)).alias(f"{f}_violations") for f in flags], *[_share(F.col(c).isNull()).alias(f"missing_{c}") for c in (*BARS_PRICES, "vol", "amount")],
        *[_share(F.abs(F.col(c).cast("double")) == float("inf")).alias(f"infinite_{c}") for c in (*BARS_PRICES, "vol", "amount")], _share(F.col(keys.entity).isNull() | F.col(keys.date).isNull()).alias("null_keys"), key_hash(*keys.both).alias("key_hash"),
    )
    dup = df.groupBy(*keys.both).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"))
    dates = df.groupBy(keys.date).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("date_rows_min"), F.percentile("n", 0.5).alias("date_rows_median"), F.max("n").alias("date_rows_max"))
    out = main.crossJoin(F.broadcast(dup)).crossJoin(F.broadcast(dates))  # one row each
    ok = (F.col("rows") > 0) & (F.col("duplicate_rows") == 0) & (F.col("ohlc_violations") == 0) & (F.col("negative_vol") == 0) & (F.col("negative_amount") == 0) & (F.col("null_keys") == 0)
    for x in (*BARS_PRICES, "vol", "amount"):
        ok = ok & (F.col(f"infinite_{x}") == 0)
    for f in flags:
        ok = ok & (F.col(f"{f}_violations") == 0)
    return out.withColumn("passed", ok)


def unsorted_rows(df: DataFrame, keys: Keys = KEYS, order: str = "_order") -> DataFrame:
    """How many rows come before a smaller key in the order given. The order is cut into ranges; each range is checked by
    itself, and only its first and last keys meet those of its neighbours."""
    key = F.struct(*keys.both)
    parts = df.select(key.alias("k"), F.col(order).alias("o")).repartitionByRange("o").withColumn("p", F.spark_partition_id())
    parts = parts.withColumn("prev", F.lag("k").over(Window.partitionBy("p").orderBy("o")))
    ranges = parts.groupBy("p").agg(F.sum(F.coalesce(F.col("k") < F.col("prev"), F.lit(False)).cast("long")).alias("inside"), F.min_by("k", "o").alias("first"), F.max_by("k", "o").alias("last"))
    edge = F.coalesce(F.col("first") < F.lag("last").over(Window.orderBy("p")), F.lit(False)).cast("long")  # a row for each range
    return ranges.select("inside", edge.alias("edge")).agg(F.coalesce(F.sum(F.col("inside") + F.col("edge")), F.lit(0)).alias("unsorted"))


def precision(df: DataFrame, columns: list[str], rows: int | None = None) -> DataFrame:
    """column, largest absolute and relative error of single precision; zeros don't count for the relative one."""
    src = df.limit(rows) if rows else df
    back = lambda c: F.abs(F.col(c).cast("double") - F.col(c).cast("float").cast("double"))
    row = src.agg(*[F.struct(F.max(back(c)).alias("max_abs_error"), F.max(safe_div(back(c), F.abs(F.col(c).cast("double")))).alias("max_rel_error")).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.max_abs_error"), F.col(f"{c}.max_rel_error")) for c in columns])).alias("r")).select("r.*")


def consistency(a: DataFrame, b: DataFrame, keys: Keys = KEYS) -> dict[str, bool]:
    """Whether two copies agree: rows, columns, keys, missing counts, bounds."""
    numbers = [c for c, t in a.dtypes if t in ("double", "float", "int", "bigint", "tinyint", "smallint")]

    def figures(df: DataFrame):
        return df.agg(F.count(F.lit(1)).alias("rows"), key_hash(*keys.both).alias("hash"), F.struct(*[_share(F.col(c).isNull()).alias(c) for c in df.columns]).alias("missing"), F.struct(*[F.struct(F.min(c), F.max(c)).alias(c) for c in numbers if c in df.columns]).alias("bounds")).first()

    if a.columns != b.columns:
        return {"columns": False}
    x, y = figures(a), figures(b)
    return {"columns": True} | {k: x[k] == y[k] for k in ("rows", "hash", "missing", "bounds")}


def vwap_scale(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Quantiles of close * vol / amount."""
    ratio, marks = safe_div(F.col("close") * F.col("vol"), F.col("amount")), [0.05, 0.25, 0.5, 0.75, 0.95]
    if rows:  # no more values than asked for
        q = df.limit(rows).agg(F.percentile(ratio, marks).alias("q"))
    else:
        q = df.agg(F.lit(1).alias("_one")).join(exact_quantiles(df, ratio, marks, into="q").withColumn("_one", F.lit(1)), "_one", "left")
    return q.select(*[F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("q05", "q25", "q50", "q75", "q95"))])


def submission_report(df: DataFrame, expected: DataFrame, entity: str = "ts_code", date: str = "trade_date", score: str = "pred") -> DataFrame:
    """One row of counts, all zero for a sound submission: missing, repeated, malformed, not finite, keys that only one
    side has."""
    keys = [entity, date]
    v = F.col(score).try_cast("double") if hasattr(F.col(score), "try_cast") else F.expr(f"try_cast({score} as double)")
    d = F.expr(f"try_cast({date} as double)")
    main = df.agg(
        F.count(F.lit(1)).alias("rows"), _share(F.col(entity).isNull() | F.col(date).isNull() | F.col(score).isNull()).alias("missing"), _share(~F.col(entity).rlike(r"^[0-9]{6}\.[A-Z]{2}$")).alias("bad_entity"),
        _share(d.isNull() | (d % 1 != 0) | ~F.col(date).cast("string").rlike(r"^[0-9]{8}$")).alias("bad_date"), _share(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("not_finite"),
    )
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated"))
    a, b = df.select(*keys).distinct(), expected.select(*keys).distinct()
    extra, absent = (x.join(y, keys, "left_anti").agg(F.count(F.lit(1)).alias(n)) for x, y, n in ((a, b, "extra_keys"), (b, a, "absent_keys")))
    out = main
    for one in (dup, extra, absent):
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out


def require_submission(df: DataFrame, expected: DataFrame, columns: tuple[str, ...] = ("ts_code", "trade_date", "pred")) -> None:
    if tuple(df.columns) != columns:
        raise ContractError(f"columns are {df.columns}, not {list(columns)}")
    row = submission_report(df, expected, *columns).first().asDict()
    bad = {k: v for k, v in row.items() if k != "rows" and v}
    if bad or row["rows"] != expected.count():
        raise ContractError(f"submission fails: {bad or 'row count'}")


def schema_differences(df: DataFrame, names: list[str], types: dict[str, str]) -> list[str]:
    """What keeps a frame from a model's input: absent columns, wrong order, wrong types."""
    have = dict(df.dtypes)
    out = [f"absent: {n}" for n in names if n not in have]
    if not out and [c for c in df.columns if c in names] != names:
        out.append("order")
    return out + [f"type of {n}: {have[n]}" for n in names if n in have and n in types and have[n] != types[n]]


def require_warm_up(lookback: int, days: int) -> None:
    if lookback > days:
        raise ContractError(f"{days} warm-up dates are fewer than the {lookback} that features look back")


def require_unrepeated(df: DataFrame, keys: Keys = KEYS) -> None:
    if n := duplicates(df, keys.both):
        raise ContractError(f"{n} repeated rows")
