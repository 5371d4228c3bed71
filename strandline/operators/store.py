"""Stores: Parquet by year with a verified manifest, out-of-fold tables, submissions, an append-only registry."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import finite
from strandline.sources.files import atomic_json, promote
from strandline.sources.snapshots import Conflict, Files, Snapshots

from .audits import require_submission
from .experiments import Experiments, Stage
from .panel import KEYS, ContractError, Keys, key_hash


def manifest(df: DataFrame, keys: Keys = KEYS) -> DataFrame:
    """year, rows, entities, key_hash (of the distinct keys), repeated rows, and the dates' bounds: two aggregates, the first
    by key."""
    per_key = df.select(F.year(keys.date).alias("year"), *keys.both).groupBy("year", *keys.both).agg(F.count(F.lit(1)).alias("n"))
    figures = [F.sum("n").alias("rows"), F.countDistinct(keys.entity).alias("entities"), key_hash(*keys.both).alias("key_hash")]
    return per_key.groupBy("year").agg(*figures, F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated"), F.min(keys.date).alias("first_date"), F.max(keys.date).alias("last_date"))


def write_years(df: DataFrame, place: str, keys: Keys = KEYS, columns: list[str] | None = None, start=None, overwrite: bool = False) -> dict:
    """Writes df to place/year=YYYY, rows before start left out (they only warm up windows), reads it back and compares
    rows, keys and repeats before it takes the place of what was there."""
    if os.path.exists(place) and not overwrite:
        raise FileExistsError(place)
    names = columns or [c for c in df.columns if c not in keys.both]
    out = df.select(*keys.both, *names)
    if start is not None:
        out = out.filter(F.col(keys.date) >= F.lit(start))
    made = f"{place}.making"
    shutil.rmtree(made, ignore_errors=True)
    figures = lambda d: d.agg(F.count(F.lit(1)).alias("rows"), key_hash(*keys.both).alias("key_hash")).first().asDict()
    try:
        dated = out.withColumn("year", F.year(keys.date))
        dated.repartition("year", F.pmod(F.xxhash64(keys.entity), F.lit(16))).sortWithinPartitions(keys.entity, keys.date).write.partitionBy("year").option("compression", "zstd").parquet(made)
        back = df.sparkSession.read.parquet(made)
        want, have = figures(out), figures(back)
        if want != have:
            raise ContractError(f"store has {have}, not {want}")
        by_year = [r.asDict() for r in manifest(back, keys).orderBy("year").collect()]
        if any(r["repeated"] for r in by_year):
            raise ContractError("store has repeated keys")
        gaps = back.agg(*[F.sum(finite(F.col(c).cast("double")).isNull().cast("long")).alias(c) for c in names]).first().asDict()
        told = have | {"columns": [*keys.both, *names], "years": by_year, "missing": gaps}
        atomic_json(f"{made}/_manifest.json", told)
        promote(made, place, overwrite)
        return told
    except BaseException:
        shutil.rmtree(made, ignore_errors=True)
        raise


def save_out_of_fold(df: DataFrame, place: str, keys: Keys = KEYS, overwrite: bool = False) -> dict:
    """Predictions at single precision; keys must not repeat, predictions must be finite."""
    out = df.withColumn("pred", F.col("pred").cast("float"))
    row = out.groupBy(*keys.both).agg(F.count(F.lit(1)).alias("n"), F.sum(finite(F.col("pred")).isNull().cast("int")).alias("bad")).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"), F.sum("bad").alias("bad")).first().asDict()
    if row["repeated"] or row["bad"]:
        raise ContractError(f"predictions fail: {row}")
    out.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").parquet(place)
    return {"rows": row["rows"], "key_hash": out.agg(key_hash(*keys.both)).first()[0]}


def restore_order(keys_in_order: DataFrame, predictions: DataFrame, keys: list[str], order: str = "_order") -> DataFrame:
    """Predictions in the order of the raw rows; each raw row must have one."""
    out = keys_in_order.join(predictions, keys, "left")
    if not out.filter(F.col("pred").isNull()).isEmpty() or out.count() != keys_in_order.count():
        raise ContractError("raw rows and predictions don't match one to one")
    return out.orderBy(order)


def write_submission(df: DataFrame, expected: DataFrame, path: str, order: str | None = None) -> None:
    """One CSV file of ts_code, trade_date, pred; checked before, read back after, put in place last.

    Rows are sorted in ranges, a part for each; the parts' bytes, one after another, are the file. So no task has all rows,
    and the driver passes bytes through a buffer."""
    names = ["ts_code", "trade_date", "pred"]
    require_submission(df.select(*names), expected)
    files, made = Files(df.sparkSession, path), f"{path}.making-{uuid.uuid4().hex}"
    try:
        df.orderBy(*([order] if order else names[:2])).select(*names).write.option("header", False).option("lineSep", "\n").csv(made)
        back = df.sparkSession.read.schema("ts_code string, trade_date int, pred float").csv(made)
        same = back.join(df.select("ts_code", "trade_date", F.col("pred").cast("float").alias("_pred")), names[:2])
        if same.count() != df.count() or not same.filter("not pred <=> _pred").isEmpty():
            raise ContractError("the file doesn't give the predictions back")
        parts = [n for n in files.names(made) if n.startswith("part-")]  # in order of the ranges
        files.concat([f"{made}/{n}" for n in parts], path, ",".join(names) + "\n")
    finally:
        files.delete(made)


REGISTRY_KEY = ["experiment_id", "record_type", "fold"]


def fresh_rows(registry: DataFrame, rows: DataFrame, unhashed: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """The rows that the registry lacks. A row that is there already with the same content is left out; a key that is there with
    other content, or twice among the new rows, is an error. `unhashed` columns don't count as content."""
    names = registry.columns
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names if c not in unhashed]), 256)
    new = rows.select(*names).withColumn("_digest", digest)
    old = registry.select(*REGISTRY_KEY, digest.alias("_old"))
    clash = new.join(old, REGISTRY_KEY).filter("_digest <> _old")
    twice = new.groupBy(*REGISTRY_KEY).agg(F.countDistinct("_digest").alias("n")).filter("n > 1")
    if not clash.isEmpty() or not twice.isEmpty():
        raise ContractError("a registered key comes with other content")
    return new.dropDuplicates(REGISTRY_KEY).join(old, REGISTRY_KEY, "left_anti").select(*names)


def append(registry: DataFrame, rows: DataFrame, unhashed: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """Registry and new rows."""
    return registry.unionByName(fresh_rows(registry, rows, unhashed))


class Registry:
    """A registry that is kept: a log of appends, each a snapshot with a number. An append looks at the last snapshot, and
    if another one came between, looks again: a row that is there by now is left out, other content under its key is an
    error. Any version can be replayed; compact() puts the rows of all appends into one folder."""

    def __init__(self, spark: SparkSession, place: str, unhashed: tuple[str, ...] = ("created_at",)) -> None:
        self.table, self.unhashed = Snapshots(spark, place, REGISTRY_KEY), unhashed

    def rows(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def append(self, rows: DataFrame, tries: int = 20) -> int | None:
        """The number of the append; None if all rows were there already."""
        for _ in range(tries):
            parent = self.table.entry()
            if parent is None:
                fresh = fresh_rows(rows.limit(0), rows, self.unhashed)
            else:
                fresh = fresh_rows(self.table.read(parent["version"]), rows.select(*[c for c, _ in parent["schema"]]), self.unhashed)
            if fresh.isEmpty():
                return None
            try:
                return self.table.write(fresh, "append", parent=parent)
            except Conflict:
                continue
        raise Conflict(f"no append after {tries} tries")

    def compact(self) -> int:
        return self.table.compact()


def write_year_snapshot(df: DataFrame, place: str, keys: Keys = KEYS, columns: list[str] | None = None, start=None, kind: str = "append") -> dict:
    """Features by year as a snapshot of a table (sources/snapshots.py), on any file system; rows before start are left out.
    The entry: schema, and for each append rows, hash of keys, missing and infinite values by column."""
    names = columns or [c for c in df.columns if c not in keys.both]
    out = df.select(*keys.both, *names)
    out = out if start is None else out.filter(F.col(keys.date) >= F.lit(start))
    out = out.withColumn("year", F.year(keys.date))
    dealt = out.repartition("year", F.pmod(F.xxhash64(keys.entity), F.lit(16))).sortWithinPartitions(keys.entity, keys.date)
    table = Snapshots(df.sparkSession, place, keys.both)
    return table.entry(table.write(dealt, kind, ["year"]))


def run_once(spark: SparkSession, place: str, signature: dict, make) -> DataFrame:
    """The table at place that was made under this signature; make() is written there if there is none."""
    once = Experiments(spark, place, [Stage("table", lambda *_: make(), parameters=signature, code="")])
    once.run()
    return once.result("table")
