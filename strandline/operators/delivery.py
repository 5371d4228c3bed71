"""From a finished experiment to predictions: saved models, refits on the full history, locked inference, and the records of
what was delivered. Everything here but the scoring is small and belongs to the driver."""

from __future__ import annotations

import json
import logging
import os
import random
import subprocess

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.files import atomic_json, sha256

from . import evaluate, models, recursion
from .panel import KEYS, ContractError, Keys

Model = models.Linear | models.Boosted


def model_state(model: Model) -> dict:
    """A model as plain values; doubles survive JSON exactly."""
    if isinstance(model, models.Linear):
        return {"kind": "linear", "features": list(model.features), "weights": list(model.weights), "intercept": model.intercept}

    def node(n: models.Node) -> dict:
        if n.feature is None:
            return {"value": n.value}
        return {"value": n.value, "feature": n.feature, "cut": n.cut, "missing_left": n.missing_left, "left": node(n.left), "right": node(n.right)}

    return {"kind": "boosted", "base": model.base, "rate": model.rate, "trees": [node(t) for t in model.trees]}


def model_of(state: dict) -> Model:
    if state["kind"] == "linear":
        return models.Linear(tuple(state["features"]), tuple(state["weights"]), state["intercept"])
    if state["kind"] != "boosted":
        raise ContractError(f"no such kind of model: {state['kind']}")

    def node(s: dict) -> models.Node:
        if "feature" not in s:
            return models.Node(s["value"])
        return models.Node(s["value"], s["feature"], s["cut"], s["missing_left"], node(s["left"]), node(s["right"]))

    return models.Boosted(state["base"], state["rate"], [node(t) for t in state["trees"]])


def save_model(model: Model, path: str, **told) -> str:
    """Writes a model with what is told of it; returns the file's SHA-256, by which locked inference knows it again."""
    atomic_json(path, {"model": model_state(model), "about": told})
    return sha256(path)


def load_model(path: str, digest: str | None = None) -> Model:
    if digest is not None and sha256(path) != digest:
        raise ContractError(f"{path} isn't the model that was locked")
    with open(path, encoding="utf-8") as f:
        return model_of(json.load(f)["model"])


def refit(df: DataFrame, components: dict[str, dict], weights: dict[str, float]) -> dict[str, Model]:
    """Fits the components with a positive weight anew on all labelled rows. A component says its kind (ridge, boosted or
    ranker), its features and options, and may say the first date that it is fitted from (`since`)."""
    out: dict[str, Model] = {}
    for name, told in components.items():
        if weights.get(name, 0.0) <= 0:
            continue
        rows = df.filter("y_ret_1d is not null")
        rows = rows if told.get("since") is None else rows.filter(F.col(told.get("date", "dt")) >= F.lit(told["since"]))
        options = told.get("options", {})
        if told["kind"] == "ridge":
            out[name] = models.ridge(models.gram(rows, told["features"]).first(), told["features"], **options)
        else:
            out[name] = {"boosted": models.boost, "ranker": models.ranker}[told["kind"]](rows, told["features"], **options)
    return out


def infer(df: DataFrame, fitted: dict[str, Model], weights: dict[str, float], keys: Keys = KEYS, keep: tuple[str, ...] = ("flag_limit_up",)) -> DataFrame:
    """keys, the kept columns and pred: the weighted mean of the models' percentile ranks by date. Every model with a
    positive weight must be there."""
    used = {n: w for n, w in weights.items() if w > 0}
    if absent := sorted(set(used) - set(fitted)):
        raise ContractError(f"no model for {absent}")
    scored = df.select(*keys.both, *keep, *[fitted[n].score().alias(f"_s_{n}") for n in used])
    blended = evaluate.blend([scored.select(*keys.both, F.col(f"_s_{n}").alias("pred")) for n in used], list(used.values()), keys)
    return scored.select(*keys.both, *keep).join(blended, keys.both)


def locked_inference(warm: DataFrame, new: DataFrame, fitted: dict[str, Model], weights: dict[str, float], alpha: float, exit_fraction: float, keys: Keys = KEYS, **options) -> DataFrame:
    """Final scores of the new dates: the blend, smoothed and held as in training, going on from the warm-up's state."""
    return recursion.across_boundary(infer(warm, fitted, weights, keys), infer(new, fitted, weights, keys), alpha, exit_fraction, keys, **options)


def finite_probe(df: DataFrame, columns: list[str], keys: Keys = KEYS) -> DataFrame:
    """column, rows and finite values on the first date: whether the warm-up reached far enough back."""
    first = df.agg(F.min(keys.date).alias("_first"))
    rows = df.join(F.broadcast(first), df[keys.date] == first["_first"])  # one row
    good = lambda x: F.sum((F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & (F.abs(F.col(x).cast("double")) != float("inf"))).cast("long"))
    wide = rows.agg(F.count(F.lit(1)).alias("_rows"), *[F.coalesce(good(x), F.lit(0)).alias(x) for x in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.col("_rows").alias("rows"), F.col(x).alias("finite")) for x in columns])).alias("r")).select("r.*")


def score_digest() -> str:
    """SHA-256 of the code that defines the score."""
    return sha256(evaluate.__file__)


def require_contract(told: dict) -> None:
    """Raises unless the constants that the score is defined by are those told: weights, days, gates, the top's share; and,
    if `digest` is told, unless the code that defines it has that digest."""
    told = dict(told)
    if (digest := told.pop("digest", None)) is not None and digest != score_digest():
        raise ContractError(f"the score's code isn't what was agreed: {score_digest()}, not {digest}")
    own = {"ic_weight": evaluate.IC_WEIGHT, "excess_weight": evaluate.EXCESS_WEIGHT, "turnover_weight": evaluate.TURNOVER_WEIGHT, "days": evaluate.DAYS, "ic_min": evaluate.IC_MIN, "pool_min": evaluate.POOL_MIN, "turnover_min": evaluate.TURNOVER_MIN, "top": evaluate.TOP}
    if bad := {k: (v, own.get(k)) for k, v in told.items() if own.get(k) != v}:
        raise ContractError(f"the score isn't what was agreed: {bad}")


def evidence(paths: dict[str, str], required: dict[str, list[str]] | None = None) -> dict:
    """JSON files by name; CSV files are lists of rows. A file that lacks a required key or column is an error."""
    import csv

    out = {}
    for name, path in paths.items():
        with open(path, encoding="utf-8", newline="") as f:
            out[name] = json.load(f) if path.endswith(".json") else list(csv.DictReader(f))
        have = out[name] if isinstance(out[name], dict) else (out[name][0] if out[name] else {})
        if absent := [k for k in (required or {}).get(name, []) if k not in have]:
            raise ContractError(f"{path} lacks {absent}")
    return out


def delivery_manifest(paths: list[str], place: str, **told) -> dict:
    """Writes size and SHA-256 of every file delivered; a file that is missing or empty is an error."""
    files = {}
    for p in paths:
        if not os.path.isfile(p) or not os.path.getsize(p):
            raise ContractError(f"{p} is missing or empty")
        files[os.path.basename(p)] = {"bytes": os.path.getsize(p), "sha256": sha256(p)}
    out = {"files": files} | told
    atomic_json(place, out)
    return out


def git_state(folder: str) -> dict:
    """commit and whether the work tree differs from it; both None where there is no repository."""
    run = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=False)
    head = run("rev-parse", "HEAD")
    if head.returncode:
        return {"commit": None, "dirty": None}
    return {"commit": head.stdout.strip(), "dirty": bool(run("status", "--porcelain").stdout.strip())}


class unchanged:
    """Context in which files must keep their content."""

    def __init__(self, *paths: str) -> None:
        self.paths = paths

    def __enter__(self) -> unchanged:
        self.before = {p: sha256(p) for p in self.paths}
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and (bad := [p for p, s in self.before.items() if sha256(p) != s]):
            raise ContractError(f"files were changed: {bad}")


def seeded(seed: int) -> np.random.Generator:
    """Seeds Python's and numpy's generators, and returns one of its own."""
    random.seed(seed)
    np.random.seed(seed)
    return np.random.default_rng(seed)


def logger(name: str, path: str | None = None) -> logging.Logger:
    """A logger with one handler for the console and, with a path, one for a file, however often it's asked for."""
    out = logging.getLogger(name)
    out.setLevel(logging.INFO)
    kinds = [logging.StreamHandler()] + ([logging.FileHandler(path, encoding="utf-8")] if path else [])
    for h in kinds:
        if not any(type(h) is type(x) and getattr(h, "baseFilename", None) == getattr(x, "baseFilename", None) for x in out.handlers):
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
            out.addHandler(h)
        else:
            h.close()
    return out
