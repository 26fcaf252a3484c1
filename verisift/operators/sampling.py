"""Samples of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_hash(key: str, seed: int) -> Column:
    return F.sha2(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")), 256)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash of key: a uniform sample that reruns agree on. n <= 0 gives none."""
    return df.orderBy(order_hash(key, seed), key).limit(max(0, n))


def bottom_k(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """Of the distinct keys the k with the least hashes, each with the least of its rows: a uniform sample of distinct keys, in which repeats take no
    place. Null keys are left out.

    Every task keeps a sketch of its k least keys, so k rows a task are shuffled whatever the table's size; sketches merge by grouping. A
    key that is among the least of all is among those of every task that has it, so that its least row is found too.
    """
    if k <= 0:
        return df.limit(0)
    rest = [c for c in df.columns if c != key]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)
    hashed = df.where(F.col(f"`{key}`").isNotNull()).select(order_hash(f"`{key}`", seed).alias("_hash"), F.col(f"`{key}`").alias("_key"), row.alias("_row"), F.to_json(F.struct(row.alias("r"))).alias("_rank"))

    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if held is not None and len(held) == k:
                t = t.filter(pc.less_equal(t.column("_hash"), held.column("_hash")[-1]))
            t = t if held is None else pa.concat_tables([held, t])
            t = t.take(pc.sort_indices(t, [("_hash", "ascending"), ("_rank", "ascending")]))
            # The first row of each hash stays.
            h = t.column("_hash").combine_chunks()
            if len(h) > 1:
                new = pc.not_equal(h.slice(1), h.slice(0, len(h) - 1))
                t = t.filter(pa.concat_arrays([pa.array([True]), new.combine_chunks() if isinstance(new, pa.ChunkedArray) else new]))
            held = t.slice(0, k)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    merged = hashed.mapInArrow(sketch, hashed.schema).groupBy("_hash").agg(F.first("_key").alias("_key"), F.min_by("_row", "_rank").alias("_row"))
    least = merged.orderBy("_hash").limit(k)
    return least.select(*[F.col("_key").alias(c) if c == key else F.col(f"_row.`{c}`").alias(c) for c in df.columns])
