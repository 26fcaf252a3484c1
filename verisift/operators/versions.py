"""Tables that change together: versions in the shared folder, of which one pointer names the current one.

A version is a folder with a Parquet table for each name. It is written first and counts from the moment its commit file, numbered one above the last, is
renamed into place, which one of two writers can do. A reader that holds a commit reads its tables whatever comes later, until
`vacuum` takes versions away that are neither among the newest nor young.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed first."""


@dataclass(frozen=True)
class Commit:
    number: int
    folder: str
    schemas: dict[str, str]
    made: float
    expires: float | None

    def expired(self, now: float) -> bool:
        return self.expires is not None and now >= self.expires


class Versions:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/commits"))

    def _numbers(self) -> list[int]:
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(self._path(f"{self.root}/commits")) if s.getPath().getName().endswith(".json"))

    def _load(self, number: int) -> Commit:
        stream = self._fs.open(self._path(f"{self.root}/commits/{number:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Commit(**json.loads(text))

    def current(self) -> Commit | None:
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else None

    def commit(self, tables: dict[str, DataFrame], now: float, ttl: float | None = None, after: Commit | None = None) -> Commit:
        """Write all tables, then make them current at once. With `after` it fails if another commit has come since that one. A failure before
        the last step leaves the current version as it was."""
        folder = f"{self.root}/versions/{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        last = self._numbers()
        number = (after.number if after else last[-1] if last else 0) + 1
        made = Commit(number, folder, {name: df.schema.json() for name, df in tables.items()}, now, None if ttl is None else now + ttl)
        new, to = self._path(f"{self.root}/commits/.{uuid.uuid4().hex}"), self._path(f"{self.root}/commits/{number:012d}.json")
        out = self._fs.create(new)
        out.write(json.dumps(made.__dict__).encode())
        out.close()
        try:
            # Without the option to overwrite, the rename fails where the number is taken.
            self._context.rename(new, to, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs.delete(new, False)
            if self._fs.exists(to):
                raise Conflict(f"commit {number} of {self.root} is taken") from e
            raise
        return made

    def read(self, name: str, of: Commit | None = None) -> DataFrame:
        of = of or self.current()
        if of is None:
            raise LookupError(f"nothing is committed in {self.root}")
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(of.schemas[name]))).parquet(f"{of.folder}/{name}")

    def fresh(self, build: Callable[[], dict[str, DataFrame]], now: float, ttl: float) -> Commit:
        """The current version, built anew where there is none or it has expired. Where another writer is first, or building
        fails while there is an old version, that one serves."""
        old = self.current()
        if old and not old.expired(now):
            return old
        try:
            return self.commit(build(), now, ttl, old)
        except Conflict:
            return self.current()
        except PySparkException:
            if old is None:
                raise
            return old

    def delete_cascade(self, parent: str, key: str, keys: DataFrame, children: dict[str, str], now: float) -> Commit:
        """Remove the rows of parent whose key is in keys (one column), and those of children (name: column that refers to the key) which refer
        to a key that parent does not have then, all in one version."""
        of = self.current()
        gone = keys.select(F.col(keys.columns[0]).alias("_gone")).distinct()
        left = self.read(parent, of).join(gone, F.col(key) == F.col("_gone"), "left_anti")
        out = {name: self.read(name, of) for name in of.schemas} | {parent: left}
        held = left.select(F.col(key).alias("_held")).distinct()
        out |= {name: out[name].join(held, F.col(column) == F.col("_held"), "left_semi") for name, column in children.items()}
        return self.commit(out, now, after=of)

    def orphans(self, parent: str, key: str, children: dict[str, str], of: Commit | None = None) -> DataFrame:
        """child, and how many of its rows refer to no row of parent."""
        held = self.read(parent, of).select(F.col(key).alias("_held")).distinct()
        found = [
            self.read(n, of).join(held, F.col(c) == F.col("_held"), "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("child"), "n") for n, c in children.items()
        ]
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    def vacuum(self, keep: int, before: float) -> int:
        """Delete versions made before a time, but for the newest `keep`, and what failed writers left; returns how many commits went."""
        commits = [self._load(n) for n in self._numbers()]
        old = [c for c in commits[: max(0, len(commits) - keep)] if c.made < before]
        for c in old:
            self._fs.delete(self._path(f"{self.root}/commits/{c.number:012d}.json"), False)
        kept = {c.folder.rsplit("/", 1)[1] for c in commits if c not in old}
        versions = self._path(f"{self.root}/versions")
        for s in self._fs.listStatus(versions) if self._fs.exists(versions) else []:
            if s.getPath().getName() not in kept and s.getModificationTime() < before * 1000:
                self._fs.delete(s.getPath(), True)
        return len(old)
