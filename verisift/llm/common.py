"""Shared plumbing of the training-data operators: table reading, shared staging, size-checked broadcast."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: The same set as a regular expression for the JVM and for DuckDB.
SPACE_RE = r"[\x20\x09-\x0D]+"

#: Rows up to which a staged side may be broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in spark.checkpoint.dir, and has to. Only in a local session, as in
    tests, is a folder chosen where that is unset.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/verisift-shared"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to the Python workers in batches of so many rows, which bounds a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/verisift/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage so that a lost
    executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.staged_path = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    for df in frames:
        path = getattr(df, "staged_path", None)
        if path:
            remove(df.sparkSession, path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it provably has at most `limit` rows, else df
    itself (the join then shuffles and AQE splits skewed keys). df should be staged,
    since this counts its rows, up to the limit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_keys(text: Column) -> list[Column]:
    """k1 and k2: two hashes that tell texts apart."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(20_011), text).alias("k2")]


def rows_without(docs: DataFrame, bad: DataFrame, more: list[str] | None = None) -> DataFrame:
    """The rows of docs whose text (null: empty), and other columns `more`, are not in bad (staged; k1, k2 and more). Columns of docs keep out of
    the way, whatever their names."""
    more = more or []
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    held = docs.select(row, *text_keys(F.coalesce("text", F.lit(""))), *[F.col(c).alias(f"_{c}") for c in more])
    b = bad.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), *[F.col(c).alias(f"b_{c}") for c in more])
    same = (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2"))
    for c in more:
        same = same & F.col(f"_{c}").eqNullSafe(F.col(f"b_{c}"))
    return held.join(small_side(b, 1_000_000), same, "left_anti").select("_row.*")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
