"""Tables of snapshots on any Hadoop file system: immutable folders of Parquet, and a numbered log that says which make up
the table.

A writer puts its rows into a folder of its own, checks them there, and then creates the log's next entry, which must not
exist yet: of two that began from the same snapshot one gets it, the other raises Conflict and takes its folder back. Readers
see whole snapshots; nothing is renamed, and nothing is deleted but by vacuum(). Rolling back is an entry with the folders of
an older one. An entry holds the table's columns and types, and for each of its folders the rows, the hash of the keys,
and by column the missing and the infinite values.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.panel import ContractError, key_hash


class Conflict(Exception):
    """Someone else wrote the next snapshot."""


class Files:
    """Small files of a Hadoop file system, from the driver."""

    def __init__(self, spark: SparkSession, place: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(place).getFileSystem(self.conf)
        self.local = self.fs.getScheme() == "file"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file that mustn't exist; False if it does. The file system's exclusive create decides; the local one
        looks before it writes, so there the operating system's own is used."""
        data, at = bytearray(text.encode()), self.path(name)
        self.fs.mkdirs(at.getParent())
        if self.local:
            nio = self.jvm.java.nio.file
            options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("java.nio.file.OpenOption"), 2)
            options[0], options[1] = nio.StandardOpenOption.CREATE_NEW, nio.StandardOpenOption.WRITE
            held = f"{name}.{uuid.uuid4().hex}"
            try:  # whole before it has its name: a link is made once only, and never to half a file
                nio.Files.write(nio.Paths.get(self.path(held).toUri().getPath(), self._none()), data, options)
                nio.Files.createLink(nio.Paths.get(at.toUri().getPath(), self._none()), nio.Paths.get(self.path(held).toUri().getPath(), self._none()))
                return True
            except Exception as e:
                if "FileAlreadyExists" in str(e):
                    return False
                raise
            finally:
                self.fs.delete(self.path(held), False)
        try:
            stream = self.fs.create(at, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        stream.write(data)
        stream.close()
        return True

    def _none(self):
        return self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("java.lang.String"), 0)

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def concat(self, parts: list[str], into: str, head: str = "") -> None:
        """One file of the parts' bytes, one after another; through a buffer, and in place only when it is whole."""
        held = f"{into}.{uuid.uuid4().hex}"
        out = self.fs.create(self.path(held), True)
        try:
            out.write(bytearray(head.encode()))
            for p in parts:
                stream = self.fs.open(self.path(p))
                self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
                stream.close()
            out.close()
            self.fs.delete(self.path(into), False)
            if not self.fs.rename(self.path(held), self.path(into)):
                raise OSError(f"can't name {into}")
        except BaseException:
            self.fs.delete(self.path(held), False)
            raise


def figures(df: DataFrame, keys: list[str]) -> dict:
    """rows, key_hash, keys that come twice or more, and by column missing and infinite values: two aggregates."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    rest = [c for c in df.columns if c not in keys]
    count = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), key_hash(*keys).alias("key_hash"), F.struct(*[count(F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()).alias(c) for c in rest] or [F.lit(0).alias("_")]).alias("missing"),
        F.struct(*[count(F.abs(F.col(c)) == float("inf")).alias(c) for c in floats] or [F.lit(0).alias("_")]).alias("infinite"),
    ).first()
    out = {"rows": row["rows"], "key_hash": row["key_hash"], "missing": row["missing"].asDict() if rest else {}, "infinite": row["infinite"].asDict() if floats else {}}
    out["repeated"] = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return out


class Snapshots:
    """A table at place, its rows named by keys."""

    def __init__(self, spark: SparkSession, place: str, keys: list[str]) -> None:
        self.spark, self.place, self.keys, self.files = spark, place.rstrip("/"), list(keys), Files(spark, place)

    def _entry(self, version: int) -> str:
        return f"{self.place}/_log/{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n[:12]) for n in self.files.names(f"{self.place}/_log") if n.endswith(".json") and n[:12].isdigit() and len(n) == 17]

    def entry(self, version: int | None = None) -> dict | None:
        """What the log says of a version, the last one if none is told; None for an empty table."""
        known = self.versions()
        if not known:
            return None
        return json.loads(self.files.read(self._entry(known[-1] if version is None else version)))

    def read(self, version: int | None = None) -> DataFrame:
        found = self.entry(version)
        if found is None or not found["folders"]:
            raise FileNotFoundError(f"no snapshot at {self.place}")
        return self.spark.read.parquet(*[f"{self.place}/data/{x['folder']}" for x in found["folders"]]).select(*[c for c, _ in found["schema"]])

    def _commit(self, parent: dict | None, folders: list[dict], schema: list, kind: str) -> int:
        version = (parent["version"] if parent else 0) + 1
        told = {"version": version, "parent": parent["version"] if parent else None, "kind": kind, "schema": schema, "folders": folders, "rows": sum(x["rows"] for x in folders)}
        if not self.files.create(self._entry(version), json.dumps(told, sort_keys=True)):
            raise Conflict(f"version {version} of {self.place} is taken")
        return version

    def write(self, df: DataFrame, kind: str = "append", partition: list[str] | None = None, parent: dict | None = None, check: Callable[[DataFrame], None] | None = None) -> int:
        """A new snapshot: what was there and df (append), or df alone (replace). Columns and types must be those of the
        table, no key may repeat, among df's rows or in the table. parent: the entry that the caller looked at, if it did."""
        parent = parent or self.entry()
        schema = [[c, t] for c, t in df.dtypes]
        if parent is not None and parent["schema"] != schema:
            raise ContractError(f"the table has {parent['schema']}, not {schema}")
        folder = uuid.uuid4().hex
        at = f"{self.place}/data/{folder}"
        try:
            (df.write.partitionBy(*partition) if partition else df.write).option("compression", "zstd").parquet(at)
            back = self.spark.read.schema(df.schema).parquet(at)
            told = figures(back, self.keys)
            if told["repeated"]:
                raise ContractError(f"{told['repeated']} rows have a key that repeats")
            if check is not None:
                check(back)
            old = parent["folders"] if parent and kind == "append" else []
            if old and not self.read(parent["version"]).select(*self.keys).join(back.select(*self.keys), self.keys, "left_semi").isEmpty():
                raise ContractError("the table has some of these keys")
            return self._commit(parent, [*old, {"folder": folder} | told], schema, kind)
        except BaseException:
            self.files.delete(at)
            raise

    def rollback(self, version: int) -> int:
        """A new snapshot with what an older one had."""
        old = self.entry(version)
        return self._commit(self.entry(), old["folders"], old["schema"], f"rollback to {version}")

    def compact(self) -> int:
        """A new snapshot with the same rows in one folder."""
        parent = self.entry()
        before = self.read(parent["version"])
        rows = before.count()

        def same(df: DataFrame) -> None:
            if df.count() != rows:
                raise ContractError("compaction lost rows")

        return self.write(before, "replace", parent=parent, check=same)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes the folders that none of the last `keep` snapshots has, and what writers left that never committed.
        Not while someone writes: a folder is there before its entry."""
        used = {x["folder"] for v in self.versions()[-keep:] for x in self.entry(v)["folders"]}
        gone = [n for n in self.files.names(f"{self.place}/data") if n not in used]
        for n in gone:
            self.files.delete(f"{self.place}/data/{n}")
        return gone
