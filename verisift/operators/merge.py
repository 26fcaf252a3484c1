"""Mutations expressed as joins: an update keeps every target row and takes new values where there are any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_update(target: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """target with `columns` replaced by those of updates for equal keys. A key may stand once in updates."""
    u = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    j = target.join(u, F.col(key) == F.col("_key"), "left")
    return j.select(*[F.when(F.col("_hit"), F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def first_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: that of the least order value. Aggregates before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])
