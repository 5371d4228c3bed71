"""Snapshots, the registry's log, experiments, one file from many tasks: races, failures, resumption."""

from __future__ import annotations

import datetime as dt
import os
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import experiments as ex
from strandline.operators import store
from strandline.operators.panel import ContractError
from strandline.sources.snapshots import Conflict, Files, Snapshots

COLS = "entity string, dt date, x double"


def day(k):
    return dt.date(2019, 12, 25) + dt.timedelta(days=k)


def rows(spark, ks, x=1.0):
    return spark.createDataFrame([("e%d" % (k % 3), day(k), x) for k in ks], COLS)


def test_appends_time_travel_and_rollback(spark, tmp_path):
    t = Snapshots(spark, str(tmp_path / "t"), ["entity", "dt"])
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.write(rows(spark, range(5))) == 1 and t.write(rows(spark, range(5, 9))) == 2
    assert (t.read().count(), t.read(1).count()) == (9, 5)
    assert t.write(rows(spark, [7], 2.0), "replace") == 3 and t.read().count() == 1
    assert t.rollback(2) == 4 and t.read().count() == 9 and t.entry()["kind"] == "rollback to 2"
    assert t.compact() == 5 and len(t.entry()["folders"]) == 1 and t.read().count() == 9
    assert len(t.vacuum()) == 3 and t.read().count() == 9


def test_what_a_snapshot_refuses(spark, tmp_path):
    """Other columns or types, keys that repeat or are there: nothing of the writer is left."""
    t = Snapshots(spark, str(tmp_path / "t"), ["entity", "dt"])
    t.write(rows(spark, range(4)))
    before = t.files.names(f"{t.place}/data")
    for bad in (rows(spark, [9]).withColumn("x", F.col("x").cast("float")), rows(spark, [9]).withColumn("y", F.lit(1)), rows(spark, [9, 9]), rows(spark, [3, 9])):
        with pytest.raises(ContractError):
            t.write(bad)
    assert t.files.names(f"{t.place}/data") == before and t.versions() == [1]


def test_entry_counts(spark, tmp_path):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(9), float("inf")), ("b", day(9), None), ("c", day(30), float("nan"))], COLS)
    told = store.write_year_snapshot(df, str(tmp_path / "y"), start=day(1))
    (folder,) = told["folders"]
    assert folder["rows"] == told["rows"] == 3 and folder["infinite"] == {"x": 1} and folder["missing"]["x"] == 2 and folder["repeated"] == 0
    assert sorted(n for n in os.listdir(tmp_path / "y" / "data" / folder["folder"]) if n.startswith("year")) == ["year=2020"]
    with pytest.raises(ContractError):
        store.write_year_snapshot(df.withColumn("x", F.col("x").cast("float")), str(tmp_path / "y"))
    assert store.write_year_snapshot(df, str(tmp_path / "y"), kind="replace")["rows"] == 4


def test_two_writers_race(spark, tmp_path):
    """Both begin from one snapshot: one is published, the other raises and leaves nothing."""
    t = Snapshots(spark, str(tmp_path / "t"), ["entity", "dt"])
    t.write(rows(spark, range(3)))
    parent, out = t.entry(), []

    def go(k):
        try:
            out.append(t.write(rows(spark, [100 + k]), parent=parent))
        except Conflict:
            out.append(None)

    threads = [threading.Thread(target=go, args=(k,)) for k in range(5)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert sorted(out, key=str) == [2, None, None, None, None] and t.read().count() == 4 and len(t.files.names(f"{t.place}/data")) == 2


def test_exclusive_create(spark, tmp_path):
    f = Files(spark, str(tmp_path))
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if f.create(f"{tmp_path}/a/x.json", str(k)) else None) for k in range(16)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert len(won) == 1 and f.read(f"{tmp_path}/a/x.json") == str(won[0]) and f.names(f"{tmp_path}/a") == ["x.json"]


REG = "experiment_id string, record_type string, fold string, value string, created_at string"


def test_registry_log(spark, tmp_path):
    log = store.Registry(spark, str(tmp_path / "r"))
    put = lambda *r: log.append(spark.createDataFrame([(*x, "now") for x in r], REG))
    assert put(("e1", "fold", "1", "a"), ("e1", "fold", "2", "b")) == 1
    assert put(("e1", "fold", "1", "a")) is None and put(("e1", "fold", "2", "b"), ("e2", "fold", "1", "c")) == 2
    with pytest.raises(ContractError):
        put(("e2", "fold", "1", "other"))
    assert (log.rows(1).count(), log.rows().count()) == (2, 3)
    assert log.compact() == 3 and log.rows().count() == 3 and log.rows(2).count() == 3
    errors, threads = [], []

    def go(k):
        try:
            put(("e9", "fold", str(k), "v"), ("e9", "shared", "0", "same"))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=go, args=(k,)) for k in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not errors and log.rows().count() == 8 and log.rows().filter("record_type = 'shared'").count() == 1


def test_experiment_matrix_resumes(spark, tmp_path):
    """Three windows by three folds; a stage fails, as if killed: the next run makes what is missing and nothing else."""
    calls, broken = [], {"on": True}

    def fit(spark, inputs, p):
        calls.append((p["window"], p["fold"]))
        if broken["on"] and (p["window"], p["fold"]) == (2, 1):
            raise RuntimeError("killed")
        return inputs["view"].filter(F.col("id") % 3 == p["fold"]).withColumn("window", F.lit(p["window"]))

    def build(scale):
        view = ex.Stage("view", lambda s, i, p: s.range(p["n"]), parameters={"n": 30 * scale}, code="v1")
        points = ex.matrix("fit", fit, {"window": [1, 2, 3], "fold": [0, 1, 2]}, ["view"])
        summary = ex.Stage("summary", lambda s, i, p: i["fit:1:0"].unionByName(i["fit:3:2"]).groupBy("window").count(), inputs=[x.name for x in points], code="s1")
        return ex.Experiments(spark, str(tmp_path / "m"), [view, *points, summary])

    with pytest.raises(RuntimeError):
        build(1).run()
    done = len(calls) - 1
    left = build(1).files.names(f"{tmp_path}/m/data")
    assert len(left) == 1 + done
    broken["on"] = False
    made = build(1).run()
    assert len(made) == 9 - done + 1 and len(calls) == 9 + 1 and build(1).run() == []
    assert {r["window"]: r["count"] for r in build(1).result("summary").collect()} == {1: 10, 3: 10}
    other = build(2)
    assert not other.done("view") and len(other.run(["fit:1:0"])) == 2 and build(1).done("summary")


def test_stage_graph_contracts(spark, tmp_path):
    s = lambda n, *i, **p: ex.Stage(n, lambda *_: None, list(i), p, code="x")
    for bad in ([s("a", "b"), s("b", "a")], [s("a", "none")], [s("a"), s("a")]):
        with pytest.raises(ContractError):
            ex.Experiments(spark, str(tmp_path), bad)
    key = lambda stages, name="b", **k: ex.Experiments(spark, str(tmp_path), stages, **k).key(name)
    base = key([s("a", k=1), s("b", "a")])
    assert base == key([s("b", "a"), s("a", k=1)]) and base != key([s("a", k=2), s("b", "a")]) and base != key([s("a", k=1), s("b", "a")], sources={"bars": "7"})


def test_one_file_from_many_tasks(spark, tmp_path):
    """Byte for byte the sorted file; no task has all rows."""
    rng = np.random.default_rng(2)
    n = 200_000
    pdf = pd.DataFrame({"ts_code": [f"{k % 5000:06d}.SZ" for k in range(n)], "trade_date": 20200101 + np.arange(n) // 5000, "pred": rng.random(n).astype(np.float32)})
    df = spark.createDataFrame(pdf).withColumns({"trade_date": F.col("trade_date").cast("int"), "pred": F.col("pred").cast("float")}).repartition(9)
    out = str(tmp_path / "s.csv")
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert df.orderBy("ts_code", "trade_date").rdd.getNumPartitions() > 1
        store.write_submission(df, df, out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    one = str(tmp_path / "one")
    df.orderBy("ts_code", "trade_date").coalesce(1).write.option("header", True).option("lineSep", "\n").csv(one)
    (part,) = [f for f in os.listdir(one) if f.startswith("part-")]
    with open(out, "rb") as a, open(os.path.join(one, part), "rb") as b:
        assert a.read() == b.read()
    assert sorted(os.listdir(tmp_path)) == [".s.csv.crc", "one", "s.csv"] or sorted(os.listdir(tmp_path)) == ["one", "s.csv"]
