"""Token-id output: whole texts as token ids in Re-Pair compressed shards, in ascending doc_id order.

The files are Parquet containers written through Spark's commit protocol (so a lost executor leaves no half
file and any store works); each row is one shard in the format of repair.py, and rows and
files are in the order of the documents.

Edge cases: a null or empty text is the end id alone; a null doc_id sorts first; rows that share a
doc_id stand together, ordered by the text's hash; an empty table gives no shard and an empty result; other columns
are not read. Very long texts make a shard of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verisift.llm.common import fresh_path, parts, small_batches, small_side, staged, table
from verisift.llm.tokens import chunks, default_tokenizer, token_ids

#: Ids of a shard: bounds a worker's memory and the work of one random access.
SHARD_IDS = 1 << 20
SHARDS = "part int, seq int, n_docs int, n_ids long, shard binary"
DIGESTS = "part int, seq int, place int, doc_id long, rel long, n_tokens long, ids_crc32 long"


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Write the shards of docs (doc_id, text) to path."""

    def shards(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from verisift.llm.repair import pack

        part = TaskContext.get().partitionId()
        ids = token_ids(tokenizer, end_id)
        names, held, size, seq = [], [], 0, 0

        def flush():
            nonlocal names, held, size, seq
            out = pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(held)], pa.int32()), "n_ids": pa.array([size], pa.int64()), "shard": pa.array([pack(names, held)], pa.binary())}
            )
            names, held, size, seq = [], [], 0, seq + 1
            return out

        for batch in chunks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for d, x in zip(batch.column("doc_id").to_pylist(), ids.encode(texts), strict=True):
                if held and size + len(x) > shard_ids:
                    yield flush()
                names.append(d)
                held.append(x)
                size += len(x)
        if held:
            yield flush()

    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    # Rows that share a doc_id would all fall into one range: the text's hash spreads them.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange(parts(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.select("doc_id", "text").mapInArrow(shards, SHARDS).write.parquet(path)


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards."""

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from verisift.llm.repair import digests

        for batch in batches:
            for part, seq, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "shard")), strict=True):
                rows = digests(blob)
                n = len(rows)
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(range(n), pa.int32()), *(pa.array(c, pa.int64()) for c in cols)],
                    names=["part", "seq", "place", "doc_id", "rel", "n_tokens", "ids_crc32"],
                )

    shards = spark.read.schema(SHARDS).parquet(path)
    # Offsets: totals of the ranges first (one row each), then within a range.
    per_part = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    within = shards.select("part", "seq", (F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("inside"))
    offsets = staged(within.join(per_part, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("before")), "token-offsets")
    rows = shards.select("part", "seq", "shard").mapInArrow(decode, DIGESTS)
    return rows.join(small_side(offsets), ["part", "seq"]).select("doc_id", (F.col("before") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32")


def op10_token_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    path = fresh_path(spark, "token-shards")
    write_token_shards(table(spark, sf_dir, "documents"), path, tokenizer or default_tokenizer(), end_id)
    return read_token_digests(spark, path)
