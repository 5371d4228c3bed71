"""The panel: entity by date, keys unique, rows of a date that has no bar kept with missing values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import finite, safe_div

BAR = ("open", "high", "low", "close", "vol", "amount")


class ContractError(ValueError):
    """A table isn't what an operator was promised."""


@dataclass(frozen=True)
class Keys:
    entity: str = "entity"
    date: str = "dt"

    @property
    def both(self) -> list[str]:
        return [self.entity, self.date]

    def by_entity(self):
        return Window.partitionBy(self.entity).orderBy(self.date)


KEYS = Keys()


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    absent = [c for c in names if c not in df.columns]
    if absent:
        raise ContractError(f"missing columns: {', '.join(absent)}")
    return df


def duplicates(df: DataFrame, keys: list[str]) -> int:
    """Rows whose key occurs more than once, all of them counted."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.sum("n")).first()[0]
    return int(n or 0)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if n := duplicates(df, keys):
        raise ContractError(f"{n} rows share their key {keys}")
    return df


def normalise(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL, for good."""
    return df.select(*[finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def densify(df: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """Every entity on every date of the table; absent bars are rows of NULLs. The dates are a calendar, small by nature,
    but only Spark's own size check may broadcast it."""
    cells = df.select(keys.entity).distinct().crossJoin(df.select(keys.date).distinct())
    return cells.join(df, keys.both, "left")


def with_returns(df: DataFrame, keys: Keys = KEYS, limit: float | None = None) -> DataFrame:
    """Adds ret_1, the label y_ret_1d (return to the very next row, missing closes not skipped) and, with a limit, the
    flag of rows that rose by it or more."""
    w = keys.by_entity()
    out = df.withColumn("ret_1", safe_div(F.col("close"), F.lag("close").over(w)) - 1)
    out = out.withColumn("y_ret_1d", safe_div(F.lead("close").over(w), F.col("close")) - 1)
    return out if limit is None else out.withColumn("flag_limit_up", F.coalesce(F.col("ret_1") >= limit, F.lit(False)).cast("int"))


def key_hash(*keys: str) -> Column:
    """Aggregate: an order-free hash of a multiset of keys, additive over partitions and the same in every engine: the
    sum of 60 bits of each key's MD5, modulo 2^64. Null is told apart from any text."""
    told = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("?")) for k in keys])
    one = F.conv(F.substring(F.md5(told), 1, 15), 16, 10).cast("decimal(38,0)")
    return (F.sum(one) % F.lit(str(2**64)).cast("decimal(38,0)")).cast("string")


def joined_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which neither side may lose or multiply a row. The check is one aggregate over the keys of both sides;
    as it asks for no other column, what these are computed from isn't run for it."""
    side = lambda df, a, b: df.select(*keys, F.lit(a).alias("_a"), F.lit(b).alias("_b"))
    per_key = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(*keys).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    count = lambda where: F.coalesce(F.sum(F.when(F.expr(where), 1)), F.lit(0))
    row = per_key.agg(count("a > 1 or b > 1").alias("repeated"), count("b = 0").alias("left_only"), count("a = 0").alias("right_only")).first().asDict()
    if any(row.values()):
        raise ContractError(f"one-to-one join on {keys} fails: {row}")
    return left.join(right, keys)


def marked_join(left: DataFrame, right: DataFrame, keys: list[str], mark: str = "matched") -> DataFrame:
    """Left join with a column that tells whether a row found its match; right must not repeat a key."""
    require_unique(right, keys)
    return left.join(right.withColumn(mark, F.lit(True)), keys, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def first_entities(df: DataFrame, n: int, keys: Keys = KEYS) -> DataFrame:
    """The rows of the n smallest entities: a small panel of whole histories."""
    return df.join(df.select(keys.entity).distinct().orderBy(keys.entity).limit(n), keys.entity, "left_semi")


#: Parts of a year in the tree of hashes.
BUCKETS = 64


def _branch(df: DataFrame, date: str | None, entity: str) -> DataFrame:
    """Adds the branch of each row: the year of its date, and a bucket of its entity."""
    kind = dict(df.dtypes).get(date)
    year = F.year(date) if kind in ("date", "timestamp") else F.floor(F.col(date) / 10_000).cast("int") if kind in ("int", "bigint") else F.lit(0)
    return df.withColumns({"_year": F.coalesce(year, F.lit(-1)), "_bucket": F.pmod(F.xxhash64(entity), F.lit(BUCKETS)).cast("int")})


def differing_branches(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """_year, _bucket of the branches in which two frames differ. Each side adds up hashes of its rows by branch, which tasks
    do before anything is exchanged: a row for each year and bucket."""
    date, entity = (keys[1], keys[0]) if len(keys) > 1 else (None, keys[0])

    def sums(df: DataFrame, n: str) -> DataFrame:
        told = _branch(df.select(*keys, *columns), date, entity)
        one = F.xxhash64(*keys, F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns]) if columns else F.lit(0))
        return told.groupBy("_year", "_bucket").agg(F.count(F.lit(1)).alias(f"n{n}"), F.sum(one.cast("decimal(38,0)")).alias(f"h{n}"))

    both = sums(left, "l").join(sums(right, "r"), ["_year", "_bucket"], "full")
    return both.filter(~(F.col("nl").eqNullSafe(F.col("nr")) & F.col("hl").eqNullSafe(F.col("hr")))).select("_year", "_bucket")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> bool:
    """Whether two frames have the same keys, as often: hashes by branch decide."""
    return differing_branches(left, right, keys, []).isEmpty()


def aligned_differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys (entity, date) at which two frames differ, or that only one has.

    A tree of hashes: only the rows of branches (year, bucket of entities) whose hashes differ are exchanged and compared;
    their list is at most a row for each branch, so it is broadcast. Rows that are alike stay where they are."""
    date, entity = (keys[1], keys[0]) if len(keys) > 1 else (None, keys[0])
    off = F.broadcast(differing_branches(left, right, keys, columns))
    kept = lambda df: _branch(df.select(*keys, *columns), date, entity).join(off, ["_year", "_bucket"], "left_semi")
    l, r = kept(left).select(*keys, F.struct(*columns).alias("_l")), kept(right).select(*keys, F.struct(*columns).alias("_r"))
    return l.join(r, keys, "full").filter(~F.col("_l").eqNullSafe(F.col("_r"))).select(*keys)
