"""Walk-forward calendars."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import ContractError


@dataclass(frozen=True)
class Fold:
    name: str
    train: tuple
    validate: tuple


def check(folds: list[Fold], purge: int, horizon: int) -> None:
    if purge < horizon:
        raise ContractError(f"purge of {purge} dates is shorter than the label's horizon of {horizon}")
    if len({f.name for f in folds}) != len(folds):
        raise ContractError("two folds share a name")
    for f in folds:
        if not f.train[0] <= f.train[1] < f.validate[0] <= f.validate[1]:
            raise ContractError(f"fold {f.name} overlaps")
    for a, b in zip(folds, folds[1:], strict=False):
        if b.train[0] != a.train[0] or b.train[1] <= a.train[1] or b.validate[0] <= a.validate[1]:
            raise ContractError(f"folds {a.name} and {b.name} don't expand")


def calendar(df: DataFrame, folds: list[Fold], purge: int = 1, horizon: int = 1, date: str = "dt") -> DataFrame:
    """fold, date, role (train, purged, validate). The last `purge` dates of a train range are purged. Lazy; empty folds
    show up in fold_counts."""
    check(folds, purge, horizon)
    points = [F.struct(F.lit(f.name).alias("fold"), F.when(F.col(date).between(*f.train), "train").when(F.col(date).between(*f.validate), "validate").alias("role")) for f in folds]
    rows = df.select(date).distinct().select(date, F.explode(F.array(*points)).alias("p")).select("p.fold", date, "p.role").filter("role is not null")
    last = F.row_number().over(Window.partitionBy("fold", "role").orderBy(F.col(date).desc()))
    return rows.withColumn("role", F.when((F.col("role") == "train") & (last <= purge), "purged").otherwise(F.col("role")))


def rows_of(df: DataFrame, fold_dates: DataFrame, role: str, date: str = "dt", labelled: bool = False) -> DataFrame:
    """fold and the panel's rows in a role."""
    out = df.join(fold_dates.filter(F.col("role") == role).select("fold", date), date)
    return out.filter("y_ret_1d is not null") if labelled else out


def fold_counts(df: DataFrame, fold_dates: DataFrame, date: str = "dt") -> DataFrame:
    """By fold and role: dates, rows, labelled, unlabelled, fewest and most rows of a date."""
    daily = df.groupBy(date).agg(F.count(F.lit(1)).alias("n"), F.count("y_ret_1d").alias("labelled"))
    return fold_dates.join(daily, date).groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("dates"), F.sum("n").alias("rows"), F.sum("labelled").alias("labelled"), (F.sum("n") - F.sum("labelled")).alias("unlabelled"), F.min("n").alias("rows_min"), F.max("n").alias("rows_max"),
    )


def trailing(fold_dates: DataFrame, years: int, date: str = "dt") -> DataFrame:
    """The train dates from the first day of the year `years` before the fold's first validation date."""
    first = fold_dates.filter("role = 'validate'").groupBy("fold").agg(F.make_date(F.year(F.min(date)) - years, F.lit(1), F.lit(1)).alias("_from"))
    return fold_dates.join(first, "fold").filter((F.col("role") != "train") | (F.col(date) >= F.col("_from"))).drop("_from")


def fingerprint(fold_dates: DataFrame, date: str = "dt") -> DataFrame:
    """fold, sha256 of its sorted (role, date)."""
    told = F.concat_ws(":", "role", F.col(date).cast("string"))
    return fold_dates.groupBy("fold").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(told)), ","), 256).alias("sha256"))


def disjoint(a: DataFrame, b: DataFrame, date: str = "dt") -> bool:
    return a.select(date).join(b.select(date), date, "left_semi").isEmpty()
