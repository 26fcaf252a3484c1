"""Size-tiered compaction of document shards (native: DataFrame functions only).

A store is a folder of immutable runs and of versioned manifests. Arrivals are appended as small runs. Compaction
looks at the manifest alone: runs are put into tiers by size, each tier a few times larger than the one below; a tier
that holds enough runs is merged into one run, written as files of the target size. Every change
writes its files first and then the next manifest, whose creation fails if another writer was faster; readers see the
old or the new version and nothing between. That asks for a store whose rename fails where the target exists, such as HDFS and local
file systems; an object store without it needs one writer at a time. A manifest holds each run's schema, and a version reads as the union of its runs'
columns, null where a run lacks one. Runs that no manifest names are swept by `vacuum` once they are old enough to belong to no writer at work.

Edge cases: an empty arrival makes no run; null texts have size 0; repeated rows are stored as often as they come; all
columns are kept as they are, whatever their names; a column that comes with another type is refused; an empty store reads as no rows.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from verisift.llm.common import _fs, fresh_path, table

#: Runs of a tier are merged once so many of them lie there; each tier is this much larger than the one below.
FANOUT = 4
#: Bytes of text in a file after a merge, and upper edge of the lowest tier.
TARGET = 128 << 20
SMALL = 1 << 20


#: Seconds for which an uncommitted run may be the work of another writer.
YOUNG = 86_400.0


def _stats() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("b"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")]


def _listed(spark: SparkSession, path: str) -> list:
    fs, p = _fs(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


class Conflict(RuntimeError):
    """Another writer committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, small: int = SMALL, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.small, self.fanout = spark, root.rstrip("/"), target, small, fanout

    # Manifests.
    def versions(self) -> list[int]:
        fs, p = _fs(self.spark, f"{self.root}/manifests")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions() if version is None else [version]
        if not found:
            return {"version": 0, "runs": []}
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/manifests/v{found[-1]:012d}.json", wholetext=True).collect())
        return json.loads(text)

    def commit(self, base: dict, runs: list[dict], note: str) -> dict:
        """Write the manifest after base. The name of a version can be taken once: the rename of a finished
        file onto it fails if it exists, so half a manifest is never seen."""
        new = {"version": base["version"] + 1, "note": note, "runs": runs}
        self.schema(runs)
        fs, path = _fs(self.spark, f"{self.root}/manifests/v{new['version']:012d}.json")
        _, draft = _fs(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}")
        fs.mkdirs(path.getParent())
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(draft, path):
            fs.delete(draft, False)
            raise Conflict(f"version {new['version']} exists")
        return new

    @staticmethod
    def schema(runs: list[dict]) -> StructType:
        """All columns of the runs, in the order in which they first came."""
        fields: dict[str, StructField] = {}
        for r in runs:
            for f in StructType.fromJson(json.loads(r["schema"])).fields:
                had = fields.setdefault(f.name, StructField(f.name, f.dataType, True))
                if had.dataType != f.dataType:
                    raise TypeError(f"column {f.name} is {had.dataType.simpleString()} and {f.dataType.simpleString()}")
        return StructType(list(fields.values()))

    # Runs.
    def _write(self, df: DataFrame, files: int | None, tier_of: str) -> dict | None:
        name = f"{tier_of}-{uuid.uuid4().hex}"
        path = f"{self.root}/runs/{name}"
        if files is not None:
            df = df.coalesce(files)  # whole inputs side by side: a merge needs no shuffle
        df.write.parquet(path)
        got = self.spark.read.schema(df.schema).parquet(path).agg(*_stats()).first()
        return self._run(name, df.schema, got) if got["n"] else None

    @staticmethod
    def _run(name: str, schema: StructType, got) -> dict:
        return {"run": name, "rows": got["n"], "bytes": got["b"], "lo": got["lo"], "hi": got["hi"], "schema": schema.json()}

    def append(self, *arrivals: DataFrame) -> dict:
        """Store each arrival as a run of its own; one commit for all of them."""
        base = self.manifest()
        made = [r for df in arrivals if (r := self._write(df, None, "arrival"))]
        return self.commit(base, base["runs"] + made, f"append {len(made)}") if made else base

    def append_batches(self, df: DataFrame, batch: Column) -> dict:
        """Store the rows of each value of batch as a run of its own, all of them written in one pass over df; one commit."""
        base = self.manifest()
        name, key = f"arrival-{uuid.uuid4().hex}", f"batch_{uuid.uuid4().hex}"
        path = f"{self.root}/runs/{name}"
        df.withColumn(key, batch.cast("string")).write.partitionBy(key).parquet(path)
        got = self.spark.read.schema(StructType([*df.schema.fields, StructField(key, StringType())])).parquet(path).groupBy(key).agg(*_stats()).orderBy(key).collect()  # a row for each arrival
        made = [self._run(f"{name}/{key}={r[key]}", df.schema, r) for r in got]
        return self.commit(base, base["runs"] + made, f"append {len(made)}") if made else base

    def tier(self, n_bytes: int) -> int:
        t, edge = 0, self.small
        while n_bytes >= edge:
            t, edge = t + 1, edge * self.fanout
        return t

    def plan(self, runs: list[dict]) -> list[list[dict]]:
        """Groups of similarly sized runs that are to be merged, the oldest first."""
        tiers: dict[int, list[dict]] = {}
        for r in runs:
            tiers.setdefault(self.tier(r["bytes"]), []).append(r)
        return [g[: len(g) // self.fanout * self.fanout] for _, g in sorted(tiers.items()) if len(g) >= self.fanout]

    def read_runs(self, runs: list[dict]) -> DataFrame | None:
        return self.spark.read.schema(self.schema(runs)).parquet(*[f"{self.root}/runs/{r['run']}" for r in runs]) if runs else None

    def compact(self) -> dict:
        """Merge tiers until none is full. Each merge is one commit."""
        while True:
            base = self.manifest()
            groups = self.plan(base["runs"])
            if not groups:
                return base
            made, gone = [], set()
            for g in groups:
                files = max(1, -(-sum(r["bytes"] for r in g) // self.target))
                made.append(self._write(self.read_runs(g), files, "merged"))
                gone |= {r["run"] for r in g}
            self.commit(base, [r for r in base["runs"] if r["run"] not in gone] + made, f"merge {len(gone)} into {len(made)}")

    def read(self, version: int | None = None) -> DataFrame | None:
        return self.read_runs(self.manifest(version)["runs"])

    def vacuum(self, keep_versions: int = 1, older_than: float = YOUNG) -> int:
        """Delete runs that none of the last versions names and that are older than so many seconds (a writer may be about to commit
        younger ones); the number of deleted runs."""
        live = {r["run"] for v in self.versions()[-keep_versions:] for r in self.manifest(v)["runs"]}
        tops = {r.split("/")[0] for r in live}
        fs, _ = _fs(self.spark, self.root)
        dead = []
        for s in _listed(self.spark, f"{self.root}/runs"):
            name = s.getPath().getName()
            if s.getModificationTime() / 1000 > time.time() - older_than or name in live:
                continue
            # Arrivals that were written together lie in one folder.
            inner = [x for x in _listed(self.spark, f"{self.root}/runs/{name}") if x.isDirectory()] if name in tops else [s]
            dead += [x.getPath() for x in inner if x is s or f"{name}/{x.getPath().getName()}" not in live]
        for d in dead:
            fs.delete(d, True)
        return len(dead)


#: Arrivals of the query: documents come in so many batches, by hash of the id.
ARRIVALS = 8


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in batches, each a run; the tiers are compacted; every document is read back from
    the last version: doc_id, lang, source, its size and the digest of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    store = ShardStore(spark, fresh_path(spark, "shards"))
    batch = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(ARRIVALS))
    store.append_batches(docs, batch)
    store.compact()
    store.vacuum(older_than=0)  # nobody else writes to this store
    out = store.read()
    out = docs.limit(0) if out is None else out
    return out.select("doc_id", "lang", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


SQL = """SELECT doc_id, lang, source, coalesce(strlen(text), 0)::BIGINT AS n_bytes, md5(coalesce(text, '')) AS digest FROM documents"""
