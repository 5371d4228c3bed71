"""Whole runs: out-of-fold predictions over windows and folds, their variants and scores, the choice of a candidate, the
final refit, and features for dates that follow the history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import filled

from . import delivery, evaluate, models, recursion, splits, store
from .experiments import Experiments, Stage, matrix
from .panel import KEYS, ContractError, Keys


def windowed(fold_dates: DataFrame, windows: dict[str, int | None], date: str = "dt") -> DataFrame:
    """training (a window's name), fold, date, role: the calendar of each training window, which begins so many years before
    a fold's first validation date, or where the history does if it is None."""
    years = F.create_map(*[x for k, y in windows.items() for x in (F.lit(k), F.lit(y).cast("int"))])
    first = F.min(F.when(F.col("role") == "validate", F.year(date))).over(Window.partitionBy("fold"))
    rows = fold_dates.withColumns({"_first": first, "training": F.explode(F.array(*[F.lit(k) for k in windows]))})
    back = F.element_at(years, F.col("training"))
    kept = (F.col("role") != "train") | back.isNull() | (F.col(date) >= F.make_date(F.col("_first") - back, F.lit(1), F.lit(1)))
    return rows.filter(kept).select("training", "fold", date, "role")


def ridge_out_of_fold(df: DataFrame, dates: DataFrame, features: list[str], by: list[str], penalty: float = 100.0, keys: Keys = KEYS) -> DataFrame:
    """by, keys, label, flag, pred: each validation row scored by the ridge fitted on its group's train rows. One aggregate
    fits all groups; the fits, a row for each, are joined to the rows they score."""
    role = lambda r: dates.filter(F.col("role") == r).select(*by, keys.date)
    sums = models.gram(df.join(role("train"), keys.date), features, groups=by).collect()
    fits = [(*[r[b] for b in by], list(f.weights), f.intercept) for r in sums for f in [models.ridge(r, features, penalty)]]
    kinds = dict(dates.dtypes)
    told = df.sparkSession.createDataFrame(fits, ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", _w array<double>, _c double")
    x = F.array(*[filled(F.col(f).cast("double"), 0.0) for f in features])
    pred = F.aggregate(F.zip_with("_w", x, lambda w, v: w * v), F.col("_c"), lambda s, v: s + v)
    return df.join(role("validate"), keys.date).join(F.broadcast(told), by).select(*by, *keys.both, "y_ret_1d", "flag_limit_up", pred.alias("pred"))


def variants(out: DataFrame, by: list[str], alpha: float, exit_fraction: float, keys: Keys = KEYS, **options) -> DataFrame:
    """variant (raw, turnover), by, keys, label, flag, pred: the predictions as they are, and smoothed and held."""
    names = [*by, *keys.both, "y_ret_1d", "flag_limit_up"]
    smooth = recursion.rank_ema(out, alpha, keys, groups=by).select(*names, "smoothed")
    held = recursion.hysteresis(smooth, exit_fraction, keys, groups=by, **options)
    return out.select(F.lit("raw").alias("variant"), *names, "pred").unionByName(held.select(F.lit("turnover").alias("variant"), *names, F.col("final").alias("pred")))


def comparison(scores: DataFrame, by: list[str], metrics: list[str], incumbent: dict | None = None) -> DataFrame:
    """By candidate: each metric's mean over folds, deviation (divisor n) and worst of the final score, and the difference of
    its mean from the incumbent's."""
    out = scores.groupBy(*by).agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics], F.stddev_pop("final_score").alias("final_score_std"), F.min("final_score").alias("final_score_worst"))
    known = F.lit(None if incumbent is None else incumbent["final_score"]).cast("double")
    return out.withColumn("final_score_delta", F.col("final_score_mean") - known)


def rerun(spark: SparkSession, place: str, view: DataFrame, fold_dates: DataFrame, windows: dict[str, int | None], fit: Callable[[DataFrame], models.Linear | models.Boosted], version: str, alpha: float, exit_fraction: float, keys: Keys = KEYS, least: tuple[int, int, int] | None = None, **options) -> Experiments:
    """The matrix of training windows by folds as an experiment that resumes: a stage for each point fits on its train rows
    and keeps its out-of-fold predictions, one joins them with both variants, one scores them by fold. fit: from labelled
    rows to a model; version: what tells the view and fit apart from earlier ones. run() makes what isn't there."""
    names = [r[0] for r in fold_dates.select("fold").distinct().orderBy("fold").collect()]
    calendars = windowed(fold_dates, windows, keys.date)

    def point(spark: SparkSession, inputs: dict, p: dict) -> DataFrame:
        own = calendars.filter((F.col("training") == p["training"]) & (F.col("fold") == p["fold"])).drop("training")
        model = fit(splits.rows_of(view, own, "train", keys.date, labelled=True))
        rows = splits.rows_of(view, own, "validate", keys.date)
        return rows.select(F.lit(p["training"]).alias("training"), "fold", *keys.both, "y_ret_1d", "flag_limit_up", model.score().cast("float").alias("pred"))

    points = matrix("oof", point, {"training": list(windows), "fold": names}, years={k: v for k, v in windows.items()}, version=version)
    for s in points:
        s.code = "oof"
        s.parameters["years"] = windows[s.parameters["training"]]

    def both(spark: SparkSession, inputs: dict, p: dict) -> DataFrame:
        rows = None
        for one in inputs.values():
            rows = one if rows is None else rows.unionByName(one)
        return variants(rows, ["training", "fold"], alpha, exit_fraction, keys, **options)

    def scored(spark: SparkSession, inputs: dict, p: dict) -> DataFrame:
        more = {} if least is None else {"least": tuple(least)}
        return evaluate.summarise(inputs["variants"], keys, ["training", "variant", "fold"], **more)

    settings = {"alpha": alpha, "exit_fraction": exit_fraction} | options
    rest = [Stage("variants", both, [s.name for s in points], settings, "variants"), Stage("scores", scored, ["variants"], {"least": list(least or ())}, "scores")]
    return Experiments(spark, place, [*points, *rest])


def finalize(summary: DataFrame, criteria: list[tuple[str, bool]], candidate: str, weights: Callable[[object], dict[str, float]], df: DataFrame, components: dict[str, dict], folder: str | None = None, select_only: bool = False) -> dict:
    """The best candidate by ordered criteria and, unless select_only, its components refitted on the full history and saved:
    selected (its row), weights, and models with the digests that lock them. Nothing is fitted that has no weight."""
    row = evaluate.winner(summary, criteria).first()
    if row is None:
        raise ContractError("no candidate")
    out = {"selected": row.asDict(), "weights": weights(row[candidate])}
    if select_only:
        return out
    if folder is None:
        raise ValueError("a folder is needed for the models")
    fitted = delivery.refit(df, components, out["weights"])
    return out | {"models": fitted, "digests": {name: delivery.save_model(m, f"{folder}/{name}.json") for name, m in fitted.items()}}


def following_features(history: DataFrame, new: DataFrame, make: Callable[[DataFrame], DataFrame], lookback: int, keys: Keys = KEYS, label: str = "y_ret_1d") -> DataFrame:
    """make(bars) for the dates of `new` only, with so many dates of the history before them to warm its windows up. The new
    bars must begin after the history ends, have no label, and not repeat a key; the history must reach far enough back."""
    if label in new.columns:
        raise ContractError(f"the new rows have the label {label}")
    last = history.agg(F.max(keys.date)).first()[0]
    first, rows, distinct = new.agg(F.min(keys.date), F.count(F.lit(1)), F.countDistinct(*keys.both)).first()
    if first is None or last is None or first <= last:
        raise ContractError(f"the new rows begin at {first}, the history ends at {last}")
    if rows != distinct:
        raise ContractError("the new rows repeat a key")
    dates = history.select(keys.date).distinct().orderBy(F.col(keys.date).desc()).limit(lookback)
    if dates.count() < lookback:
        raise ContractError(f"the history has fewer than {lookback} dates")
    names = [c for c in history.columns if c in new.columns]
    warm = history.join(dates, keys.date, "left_semi").select(*names)
    return make(warm.unionByName(new.select(*names))).filter(F.col(keys.date) >= F.lit(first))


def register(registry: store.Registry, experiment: str, scores: DataFrame, fold: str = "fold", told: str = "") -> int | None:
    """A row in the registry for each fold's scores, and one for their mean."""
    metrics = [c for c, t in scores.dtypes if t in ("double", "float")]
    rows = scores.select(F.col(fold).cast("string").alias("fold"), F.lit("fold").alias("record_type"), *metrics)
    mean = scores.agg(*[F.avg(m).alias(m) for m in metrics]).select(F.lit("all").alias("fold"), F.lit("mean").alias("record_type"), *metrics)
    value = F.to_json(F.struct(*[F.round(m, 12).alias(m) for m in metrics]))
    return registry.append(rows.unionByName(mean).select(F.lit(experiment).alias("experiment_id"), "record_type", "fold", value.alias("value"), F.lit(told).alias("created_at")))
