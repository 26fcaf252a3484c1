"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its share of the mix, held to `cap` times its own size. A document's expected
copies are target / size of its source (times a relative weight, if a weight column is given). The whole part is
certain; for the rest, documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and taken in that order as long as they fit into the words still missing. Documents that
no longer fit are passed over; further rounds fill the gap that is left from smaller ones.

All decisions of a source come down to one bound for each round: the first document in rank order that did not fit. So
the decisions are a small table by source, and any row can be judged by itself. Bounds are found without
putting a source into one task: a histogram of ranks finds the bucket where the words run out, and only that
bucket is summed in order.

Edge cases: null text has size 0; null sources are a source (last); null doc_ids rank as the
least id; rows equal in id and size are judged alike; sources without words have target 0;
an empty table gives an empty result; other columns are kept by mixed_rows and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verisift.llm.common import small_side, staged, table

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
CAP = 2
ROUNDS = 6
#: Buckets of the histogram of ranks; the one where the words run out is a task's share of a source.
BUCKETS = 65_536
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def _uniform() -> Column:
    h = F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    return (F.conv(h, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def _sized(docs: DataFrame, weight: str | None) -> DataFrame:
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), w.alias("w"),
    )


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: tuple = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target, one row for each source. The level at which targets stop growing
    is found in the order of cap per weight: sources before it are held to their cap."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("w")).alias("weighted"))
    cycle = F.array(*[F.lit(x) for x in weights])
    order = W.orderBy(F.col("source").asc_nulls_last())
    a = per.select("*", F.row_number().over(order).alias("pos")).withColumn("sw", F.get(cycle, (F.col("pos") - 1) % len(weights)).cast("long"))
    a = a.withColumn("most", F.lit(cap) * F.col("source_size"))
    w = W.orderBy((F.col("most") / F.col("sw")), "pos")
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    b = a.select(
        "*", F.row_number().over(w).alias("k"),
        (F.lit(share[0]) * F.sum("source_size").over(every) - F.lit(share[1]) * (F.sum("most").over(w) - F.col("most"))).alias("num"),
        (F.lit(share[1]) * F.sum("sw").over(w.rowsBetween(0, W.unboundedFollowing))).alias("den"),
    )
    b = b.withColumn("free", F.col("num").cast("double") / F.col("den") * F.col("sw") <= F.col("most"))
    first = F.min(F.when(F.col("free"), F.struct("k", "num", "den"))).over(every)
    return b.withColumn("at", first).select(
        "source", "source_size", "weighted",
        F.when(F.col("free"), F.col("at.num").cast("double") / F.col("at.den") * F.col("sw")).otherwise(F.col("most").cast("double")).alias("target"),
    )


def _with_rank(sized: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """Joins the source's row; adds copies that are certain and the rank q of the rest."""
    t = targets.withColumnRenamed("source", "_source")
    j = sized.join(small_side(t), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    expected = F.when(F.col("weighted") > 0, F.least(F.lit(float(cap)), F.col("target") * F.col("w") / F.col("weighted"))).otherwise(F.lit(0.0))
    j = j.withColumn("expected", expected).withColumn("sure", F.floor("expected").cast("long"))
    p = F.col("expected") - F.col("sure")
    u = _uniform()
    q = F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))
    return j.withColumn("q", q).withColumn("u", u).withColumn("oid", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))


def _picked(bounds: Column) -> Column:
    """Whether a row is taken once more: it fits one round's gap and stands before that round's bound."""
    key = F.struct(F.col("q").alias("q"), F.col("oid").alias("oid"), F.col("size").alias("size"))
    return F.col("q").isNotNull() & F.exists(
        bounds, lambda b: (F.col("size") <= b["gap"]) & (b["stop"].isNull() | (key < b["stop"]))
    )


STOP = "struct<q:double,oid:bigint,size:bigint>"
BOUNDS = f"array<struct<gap:double,stop:{STOP}>>"


def decisions(docs: DataFrame, weights: tuple = WEIGHTS, share: tuple = SHARE, cap: int = CAP, weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sized rows (staged) and the table of sources with target and bounds (staged)."""
    sized = staged(_sized(docs, weight), "mix-sizes")
    t = staged(source_targets(sized, weights, share, cap), "mix-targets")
    sure = _with_rank(sized, t, cap).groupBy("source").agg(F.sum(F.col("sure") * F.col("size")).alias("sure_words"))
    t = t.join(sure.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    t = t.select("source", "source_size", "weighted", "target", (F.col("target") - F.coalesce("sure_words", F.lit(0))).alias("gap"), F.array().cast(BOUNDS).alias("bounds"))
    t = staged(t, "mix-bounds")
    for _ in range(ROUNDS):
        rows = _with_rank(sized, t, cap).where(F.col("q").isNotNull() & (F.col("size") <= F.col("gap")) & (F.col("size") > 0) & ~_picked(F.col("bounds")))
        # For equal weights the odds' order is that of u, so its buckets are even; the order itself is by q.
        scaled = F.col("q") * (F.col("target") / F.col("source_size") % 1) / (1 - F.col("target") / F.col("source_size") % 1)
        rows = rows.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.floor(scaled / (1 + scaled) * BUCKETS)).cast("int"))
        hist = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("gap").alias("gap"))
        cum = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("cum", cum)
        crossing = staged(
            hist.groupBy("source").agg(
                F.min(F.when(F.col("cum") > F.col("gap"), F.struct("bucket", (F.col("cum") - F.col("words")).alias("before")))).alias("x"), F.sum("words").alias("all_words")
            ),
            "mix-crossing",
        )
        c = crossing.select(F.col("source").alias("_s"), F.col("x.bucket").alias("at"), F.col("x.before").alias("before"))
        inside = rows.join(small_side(c), F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("at")))
        # Rows of one place in the order are taken together or not at all, so they are summed before the bucket meets in one task.
        inside = inside.groupBy("source", "gap", "before", "q", "oid", "size").agg(F.sum("size").alias("words"))
        run = F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("q", "oid", "size").rowsBetween(W.unboundedPreceding, 0))
        over = inside.select("source", "gap", F.struct("q", "oid", "size").alias("key"), "words", run.alias("run")).where(F.col("run") > F.col("gap"))
        stop = over.groupBy("source").agg(F.min(F.struct("key", (F.col("run") - F.col("words")).alias("taken"))).alias("m"))
        found = crossing.join(stop.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select(
            F.col("source").alias("_s"), F.coalesce("m.taken", "all_words").alias("taken"), F.col("m.key").cast(STOP).alias("stop")
        )
        t = staged(
            t.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source", "source_size", "weighted", "target",
                (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap"),
                F.when(F.col("taken").isNull(), F.col("bounds")).otherwise(F.concat("bounds", F.array(F.struct(F.col("gap").alias("gap"), "stop")).cast(BOUNDS))).alias("bounds"),
            ),
            "mix-bounds",
        )
    return sized, t


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: tuple = SHARE, cap: int = CAP, weight: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row."""
    sized, t = decisions(docs, weights, share, cap, weight)
    copies = F.col("sure") + _picked(F.col("bounds")).cast("long")
    return _with_rank(sized, t, cap).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple = WEIGHTS, share: tuple = SHARE, cap: int = CAP) -> DataFrame:
    """The rows of docs as the mix takes them: a row taken twice stands there twice. Rows are judged
    by the table of sources, so texts are not shuffled."""
    _, t = decisions(docs, weights, share, cap)
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    one = held.select("_row", F.col("_row.doc_id").cast("long").alias("doc_id"), F.col("_row.source").alias("source"), F.coalesce(F.regexp_count("_row.text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.lit(1.0).alias("w"))
    copies = F.col("sure") + _picked(F.col("bounds")).cast("long")
    out = _with_rank(one, t, cap).withColumn("copies", copies).where("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_k")).select("_row.*")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _sql() -> str:
    cycle = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    rounds = ""
    for r in range(ROUNDS):
        rounds += f""",
c{r} AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM r{r} WHERE NOT pick AND q IS NOT NULL AND size > 0 AND size <= gap),
s{r} AS (SELECT source, min((q, doc_id, size)) FILTER (WHERE run > gap) AS stop FROM c{r} GROUP BY source),
p{r} AS (SELECT r{r}.* EXCLUDE (pick), pick OR (q IS NOT NULL AND size <= gap AND s{r}.source IS NOT DISTINCT FROM r{r}.source AND has AND (stop IS NULL OR (q, doc_id, size) < stop)) AS now, pick
  FROM r{r} LEFT JOIN (SELECT *, true AS has FROM s{r}) s{r} ON s{r}.source IS NOT DISTINCT FROM r{r}.source),
r{r + 1} AS (SELECT * EXCLUDE (gap, pick, now), coalesce(now, false) AS pick, gap - sum(CASE WHEN coalesce(now, false) AND NOT pick THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM p{r})"""
    return f"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM d GROUP BY source),
b AS (SELECT *, {cycle}[((pos - 1) % {len(WEIGHTS)} + 1)::INT] AS sw, {CAP} * source_size AS most FROM a),
e AS (SELECT *, row_number() OVER o AS k, {SHARE[0]} * sum(source_size) OVER () - {SHARE[1]} * (sum(most) OVER (o ROWS UNBOUNDED PRECEDING) - most) AS num,
  {SHARE[1]} * sum(sw) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den FROM b WINDOW o AS (ORDER BY most::DOUBLE / sw, pos)),
f AS (SELECT *, num::DOUBLE / den * sw <= most AS free FROM e),
l AS (SELECT arg_min(num, k) FILTER (WHERE free) AS n1, arg_min(den, k) FILTER (WHERE free) AS d1 FROM f),
g AS (SELECT * FROM f, l),
t AS (SELECT source, source_size, CASE WHEN free THEN n1::DOUBLE / d1 * sw ELSE most::DOUBLE END AS target FROM g),
h AS (SELECT d.doc_id, d.source, d.size, source_size, target, CASE WHEN source_size > 0 THEN least({float(CAP)}::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS expected,
  (('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
i AS (SELECT *, floor(expected)::BIGINT AS sure, expected - floor(expected) AS p FROM h),
r0 AS (SELECT doc_id, source, size, source_size, target, sure, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q, false AS pick,
  target - sum(sure * size) OVER (PARTITION BY source) AS gap FROM i){rounds}
SELECT doc_id, size, source_size, target, ((sure + pick::INT) * size)::BIGINT AS taken FROM r{ROUNDS}"""


SQL = _sql()
