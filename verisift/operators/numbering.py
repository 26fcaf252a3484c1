"""Row numbers within groups that may be as large as the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verisift.operators.staging import staged


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """df with the number of each row within its group in that order, from 1. Ranges of (by, order) are dealt to tasks and numbered there;
    a range's start is the sum of those before it, so no task holds a group. Rows of equal order count in any order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id())
    here = staged(here, "numbered").withColumn("_task", F.shiftright("_at", 33))  # staged, since ranges are drawn anew in every run
    parts = here.groupBy(*by, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    w = W.partitionBy(*by).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)  # a row for each task
    starts = parts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_task").alias("_t"), (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = F.col("_task") == F.col("_t")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return here.join(starts, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name))
