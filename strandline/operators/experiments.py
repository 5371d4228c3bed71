"""Experiments as a graph of stages, each keyed by what it is made from.

A stage's key is the digest of its name, its code, its parameters and the keys of the stages it reads. A result is written
to a folder of its own and published by creating its entry under the key, once: an entry is there only when the result is
whole, and of two that make the same stage one publishes. So a run that was killed goes on where it stopped, and a changed
parameter makes anew only the stages that it reaches.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from strandline.sources.snapshots import Files

from .panel import ContractError


@dataclass
class Stage:
    """make(spark, inputs, parameters) returns the stage's rows; inputs are the rows of the stages it is made from. code: what
    stands for make in the key, its source if not told."""

    name: str
    make: Callable[[SparkSession, dict[str, DataFrame], dict], DataFrame]
    inputs: list[str] = field(default_factory=list)
    parameters: dict = field(default_factory=dict)
    code: str | None = None


class Experiments:
    def __init__(self, spark: SparkSession, place: str, stages: list[Stage], sources: dict[str, str] | None = None) -> None:
        """sources: names of tables that stages read, with what tells their content (a snapshot's version, a digest)."""
        self.spark, self.place, self.files = spark, place.rstrip("/"), Files(spark, place)
        self.stages, self.sources, self.made = {s.name: s for s in stages}, sources or {}, []
        if len(self.stages) != len(stages):
            raise ContractError("two stages have one name")
        self.order: list[str] = []
        for s in stages:
            self._visit(s.name, ())

    def _visit(self, name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ContractError(f"stages in a circle: {' < '.join([*above, name])}")
        if name in self.order:
            return
        if name not in self.stages:
            raise ContractError(f"no stage {name}")
        for x in self.stages[name].inputs:
            self._visit(x, (*above, name))
        self.order.append(name)

    def key(self, name: str) -> str:
        s = self.stages[name]
        told = {"name": name, "code": s.code if s.code is not None else inspect.getsource(s.make), "parameters": s.parameters, "inputs": {x: self.key(x) for x in s.inputs}, "sources": self.sources}
        return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()

    def _entry(self, name: str) -> str:
        return f"{self.place}/_done/{self.key(name)}.json"

    def done(self, name: str) -> bool:
        return self.files.exists(self._entry(name))

    def result(self, name: str) -> DataFrame:
        told = json.loads(self.files.read(self._entry(name)))
        return self.spark.read.parquet(f"{self.place}/data/{told['folder']}")

    def run(self, only: list[str] | None = None) -> list[str]:
        """Makes the stages that aren't there, inputs first; their names. A stage that fails leaves nothing behind."""
        wanted, todo = set(), list(only or self.order)
        while todo:
            x = todo.pop()
            wanted.add(x)
            todo += [y for y in self.stages[x].inputs if y not in wanted]
        made = []
        for name in self.order:
            if name not in wanted or self.done(name):
                continue
            s, folder = self.stages[name], uuid.uuid4().hex
            at = f"{self.place}/data/{folder}"
            try:
                s.make(self.spark, {x: self.result(x) for x in s.inputs}, s.parameters).write.parquet(at)
                told = {"name": name, "folder": folder, "rows": self.spark.read.parquet(at).count(), "parameters": s.parameters}
                if not self.files.create(self._entry(name), json.dumps(told, sort_keys=True, default=str)):
                    self.files.delete(at)  # someone else was faster
            except BaseException:
                self.files.delete(at)
                raise
            made.append(name)
        return made


def matrix(stem: str, make, axes: dict[str, list], inputs: list[str] | None = None, **parameters) -> list[Stage]:
    """A stage for each point of the axes, named stem:value:value."""
    return [Stage(":".join([stem, *map(str, point)]), make, list(inputs or []), parameters | dict(zip(axes, point, strict=True))) for point in product(*axes.values())]
