"""Quality rules with adaptive thresholds (native: DataFrame functions only).

Every document gets a handful of rates: a count over an exposure, such as letters over words, each with half a unit more in the count (Jeffreys' prior
of a Poisson rate), so that a text of ten words without a symbol says less than one of a thousand. For each rate a quantile sketch
is kept per (lang, source): a log-linear histogram whose buckets are derived from the
value alone, so sketches merge by adding counts and the result does not depend on the
order of rows, tasks or merges. Fences come from the sketches alone: they stand twice as far beyond the 0.8 (0.2) quantile as that is from the
median, so that a fifth of a group may be bad. A document is rejected when its count lies beyond what its
group's fence makes due for its length by more than five deviations of a Poisson count of that size; nothing else is added. A group's sketch holds its language's as so many documents more, and a language's that of
everything, so small groups lean on their parents and large ones do not, without a size at which that changes.

Edge cases: null and empty texts have no words and fail the base rule; null lang or
source form groups of their own (null-safe join); repeated rows are judged one by one
and count as often as they occur; an empty table gives an empty result; columns other
than doc_id, text, lang and source are not read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verisift.llm.common import SPACE_RE, rows_without, small_side, staged, table, text_keys

SYMBOLS = "[#*$%&|<>]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Linear sub-buckets per power of two: quantiles have a relative error of 1 / SUB at most.
SUB_BITS = 7
SUB = 1 << SUB_BITS
#: Documents that a parent's sketch counts as in its child's, and parts of one in which they are counted.
WEIGHT, PARTS = 8, 1 << 20
#: Fence distance in distances of the outer quantile from the median, and deviations that chance is given.
REACH, CHANCE = 2, 5.0
#: metric -> (count, exposure, scale of the rate, unit: words or letters that come together, whether it has a lower fence). Repeats come in
#: passages, of two windows at least.
METRICS = {
    "m_word_len": ("word_chars", "n_words", 1_000, 1, True),
    "m_symbols": ("n_symbols", "word_chars", 1_000_000, 1, False),
    "m_dup_lines": ("n_dup_lines", "n_lines", 1_000_000, 1, False),
    "m_repeats": ("n_repeat_words", "n_words", 1_000_000, 10, False),
    "m_punct_caps": ("n_caps", "word_chars", 1_000_000, 1, False),
}


def _windows(words: Column) -> Column:
    """Hashes of the 5-word windows; empty for fewer than 5 words."""
    at = lambda i, k: F.get(words, i + F.lit(k))
    return F.when(
        F.size(words) >= 5,
        F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[at(i, k) for k in range(5)])),
    ).otherwise(F.array().cast("array<bigint>"))


def doc_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, two hashes of the text, the counts and the rates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("t"))
    one = base.select(
        "doc_id", "lang", "source", *text_keys(F.col("t")), "t",
        F.array_remove(F.split("t", SPACE_RE), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda ln: F.rlike(ln, F.lit(NOT_SPACE))).alias("lines"),
        (F.length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("[A-Z!]")).cast("long").alias("n_caps"),
    )
    two = one.select(
        "doc_id", "lang", "source", "k1", "k2", "word_chars", "n_symbols", "n_caps",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _windows(F.col("words")).alias("h"),
    )
    # Only texts with a repeated window pay for the sort.
    has = F.size(F.array_distinct("h")) < F.size("h")
    three = two.withColumn(
        "s",
        F.when(has, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("h")
    s = F.col("s")
    hit = F.filter(s, lambda p, j: (p["h"] == F.get(s, j - 1)["h"]) | (p["h"] == F.get(s, j + 1)["h"]))
    four = three.withColumn("p", F.sort_array(F.transform(hit, lambda p: p["i"]))).drop("s")
    p = F.col("p")
    gaps = F.transform(p, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - x, F.lit(5))))
    five = four.withColumn(
        "n_repeat_words",
        F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")),
    ).drop("p")
    rate = lambda k, n, scale, unit, _: F.expr(f"(2 * {k} + {unit}) * {scale} div (2 * greatest({n}, 1))").cast("long")
    return five.select(
        "doc_id", "lang", "source", "k1", "k2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        *[rate(*how).alias(name) for name, how in METRICS.items()],
    )


def _bucket(v: str) -> str:
    """SQL of the log-linear bucket of a value >= 0."""
    e = f"(length(bin({v})) - {SUB_BITS + 1})"
    return f"CASE WHEN {v} < {SUB} THEN {v} ELSE CAST({e} + 1 AS BIGINT) * {SUB} + ({v} div CAST(pow(2, greatest({e}, 0)) AS BIGINT)) - {SUB} END"


def _lower(b: str) -> str:
    """SQL of the least value of a bucket."""
    return f"CASE WHEN {b} < {SUB} THEN {b} ELSE ({SUB} + {b} % {SUB}) * CAST(pow(2, greatest({b} div {SUB} - 1, 0)) AS BIGINT) END"


def sketch(metrics: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """Mergeable sketches: one row per group, metric and bucket with its count.
    Partial aggregation reduces each task's rows to its buckets before the shuffle,
    so a hot group sends as little as any other."""
    long = metrics.select(
        *by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("x")
    ).select(*by, "x.metric", F.col("x.v").alias("v"))
    return long.select(*by, "metric", F.expr(_bucket("v")).alias("bucket")).groupBy(*by, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    return parts.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sk: DataFrame, by: list[str]) -> DataFrame:
    """by, metric, total, q2, q5, q8 (tenths) read from sketches. A group has a few hundred buckets at most."""
    w = W.partitionBy(*by, "metric")
    cum = sk.select(
        *by, "metric", "bucket",
        F.sum("n").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)).alias("cum"),
        F.sum("n").over(w).alias("total"),
    )
    value = F.expr(_lower("bucket"))
    reach = lambda k: F.min(F.when(10 * F.col("cum") >= k * F.col("total"), value)).alias(f"q{k}")
    return cum.groupBy(*by, "metric").agg(F.max("total").alias("total"), reach(2), reach(5), reach(8))


def leaning(own: DataFrame, by: list[str], parent: DataFrame | None, up: list[str]) -> DataFrame:
    """Sketches (by, metric, bucket, n) in PARTS of documents, each with its parent's (up, metric, bucket, n) as WEIGHT documents more. by holds up."""
    mine = own.select(*by, "metric", "bucket", (F.col("n") * PARTS).alias("n"))
    if parent is None:
        return mine
    total = parent.groupBy(*up, "metric").agg(F.sum("n").alias("total"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in up] + [F.col(f"{a}.metric") == F.col(f"{b}.metric")]
    part = F.floor(F.col("p.n").cast("double") * PARTS / F.col("t.total").cast("double"))
    share = parent.alias("p").join(total.alias("t"), functools.reduce(Column.__and__, same("p", "t"))).select(*[F.col(f"p.{c}") for c in [*up, "metric", "bucket"]], (WEIGHT * part).cast("long").alias("n"))
    groups = own.select(*by, "metric").distinct()
    lent = groups.alias("g").join(share.alias("s"), functools.reduce(Column.__and__, same("g", "s"))).select(*[F.col(f"g.{c}") for c in [*by, "metric"]], "s.bucket", "s.n")
    return merged(mine.unionByName(lent), by)


def fences(metrics: DataFrame) -> DataFrame:
    """One row per (lang, source) with lo_* and hi_* for each metric."""
    names = list(METRICS)
    fine = staged(sketch(metrics.where("not base_failed"), names, ["lang", "source"]), "quality-sketch")
    every = leaning(merged(fine, []), [], None, [])
    by_lang = leaning(merged(fine, ["lang"]), ["lang"], every, [])
    rows = quantiles(leaning(fine, ["lang", "source"], by_lang, ["lang"]), ["lang", "source"])
    hi = F.col("q8") + REACH * (F.col("q8") - F.col("q5"))
    lo = F.greatest(F.lit(0), F.col("q2") - REACH * (F.col("q5") - F.col("q2")))
    rows = rows.select("lang", "source", "metric", hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))
    aggs = []
    for name in names:
        aggs += [F.max(F.when(F.col("metric") == name, F.col(k))).alias(f"{k}_{name}") for k in ("hi", "lo")]
    return rows.groupBy("lang", "source").agg(*aggs)


def _within(name: str) -> Column:
    """Whether the count of a metric lies within what is due at its fences, give or take the deviations of a count that is due."""
    k, n, scale, unit, lower = METRICS[name]
    count = F.col(k).cast("double") + unit / 2
    due = lambda fence: F.col(n).cast("double") * F.col(f"{fence}_{name}") / scale
    ok = count <= due("hi") + CHANCE * F.sqrt(due("hi") * unit)
    if lower:
        ok = ok & (count >= due("lo") - CHANCE * F.sqrt(due("lo") * unit))
    return F.coalesce(ok, F.lit(True))


def _judged(docs: DataFrame) -> DataFrame:
    m = staged(doc_metrics(docs), "quality-metrics")
    f = staged(fences(m), "quality-fences").withColumnRenamed("lang", "f_lang").withColumnRenamed("source", "f_source")
    j = m.join(small_side(f), F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    ok = F.lit(True)
    for name in METRICS:
        ok = ok & _within(name)
    return j.withColumn("kept", ~F.col("base_failed") & ok)


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of docs: the counts, base_failed, kept."""
    return _judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *METRICS)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs whose verdict is kept. A verdict follows from text, lang and source, so rows are told apart by these, whatever
    their doc_id: rows that share an id, or have none, are judged one by one."""
    bad = staged(_judged(docs).where("NOT kept").select("k1", "k2", "lang", "source").distinct(), "quality-rejected")
    return rows_without(docs, bad, ["lang", "source"])


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _sql() -> str:
    ws = r"[\x20\x09-\x0D]"
    unions = " UNION ALL ".join(f"SELECT lang, source, '{n}' AS metric, {n} AS v FROM m WHERE NOT base_failed" for n in METRICS)
    bucket = f"CASE WHEN v < {SUB} THEN v ELSE (length(bin(v)) - {SUB_BITS})::BIGINT * {SUB} + (v // (1::BIGINT << greatest(length(bin(v)) - {SUB_BITS + 1}, 0)::INT)) - {SUB} END"
    lower = f"CASE WHEN bucket < {SUB} THEN bucket ELSE ({SUB} + bucket % {SUB}) * (1::BIGINT << greatest(bucket // {SUB} - 1, 0)::INT) END"

    def leaning_sql(name: str, own: str, by: str, parent: str, up: str) -> str:
        """As leaning(): own sketch and the parent's share of it."""
        of = lambda x: "".join(f"{x}.{c.strip()}, " for c in by.split(",") if c)
        same = " AND ".join([f"g.{c.strip()} IS NOT DISTINCT FROM p.{c.strip()}" for c in up.split(",") if c] + ["g.metric = p.metric"])
        keys = f"{by}, " if by else ""
        over = ", ".join(x for x in (up, "metric") if x)
        return f"""
{name} AS (SELECT {keys}metric, bucket, sum(n)::BIGINT AS n FROM (SELECT {keys}metric, bucket, n * {PARTS} AS n FROM {own}
  UNION ALL SELECT {of("g")}g.metric, p.bucket, ({WEIGHT} * floor(p.n::DOUBLE * {PARTS} / p.total::DOUBLE))::BIGINT FROM (SELECT DISTINCT {keys}metric FROM {own}) g
  JOIN (SELECT *, sum(n) OVER (PARTITION BY {over}) AS total FROM {parent}) p ON {same}) GROUP BY ALL)"""

    reach = ", ".join(f"min({lower}) FILTER (WHERE 10 * cum >= {k} * total) AS q{k}" for k in (2, 5, 8))
    merged_sql = lambda name, by: f"{name} AS (SELECT {by}metric, bucket, sum(n) AS n FROM s GROUP BY ALL)"
    due = lambda name, fence: f"({METRICS[name][1]}::DOUBLE * f.{fence}['{name}'] / {METRICS[name][2]}.0::DOUBLE)"
    checks = []
    for name, (k, _, _, unit, two) in METRICS.items():
        count = f"({k}::DOUBLE + {unit / 2}::DOUBLE)"
        hi, lo = due(name, "hi"), due(name, "lo")
        checks.append(f"coalesce({count} <= {hi} + {CHANCE}::DOUBLE * sqrt({hi} * {unit})" + (f" AND {count} >= {lo} - {CHANCE}::DOUBLE * sqrt({lo} * {unit})" if two else "") + ", true)")
    checks = " AND ".join(checks)
    rates = ",\n  ".join(f"(2 * {k} + {unit}) * {scale} // (2 * greatest({n}, 1)) AS {name}" for name, (k, n, scale, unit, _) in METRICS.items())
    metric_cols = ", ".join(METRICS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), 1) AS i FROM d),
g AS (SELECT rid, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, w4 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w1, w2, w3, w4) >= 2 AS hit FROM g),
c AS (SELECT rid, bool_or(hit) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM r),
rep AS (SELECT rid, count(*) AS n_words, count(*) FILTER (WHERE inside) AS n_repeat_words FROM c GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS ln FROM d),
ld AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT ln) AS n_dup_lines FROM l WHERE regexp_matches(ln, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
k AS (SELECT d.rid, doc_id, lang, source, coalesce(n_words, 0) AS n_words, length(regexp_replace(t, '{ws}', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^A-Z!]', '', 'g')) AS n_caps,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN ld USING (rid)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  {rates} FROM k),
s AS (SELECT lang, source, metric, {bucket} AS bucket, count(*) AS n FROM ({unions}) GROUP BY ALL),
{merged_sql("every", "")}, {merged_sql("each", "lang, ")}, e AS (SELECT metric, bucket, n * {PARTS} AS n FROM every),{leaning_sql("by_lang", "each", "lang", "e", "")},{leaning_sql("own", "s", "lang, source", "by_lang", "lang")},
c2 AS (SELECT lang, source, metric, bucket, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM own),
p AS (SELECT lang, source, metric, {reach} FROM c2 GROUP BY ALL),
f AS (SELECT lang, source, map_from_entries(list((metric, (q8 + {REACH} * (q8 - q5))::BIGINT))) AS hi,
  map_from_entries(list((metric, greatest(0, q2 - {REACH} * (q5 - q2))::BIGINT))) AS lo FROM p GROUP BY lang, source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {checks} AS kept, {metric_cols}
FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source"""


SQL = _sql()
