"""Analog views: the engine's inputs derived from the driver tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_K = "CAST(json_extract_string(props, '$.k') AS INT)"

CLAIMS = """claims_v AS (SELECT d.doc_id AS id, d.text AS claim_text, d.source AS source_url,
 CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'completed' END AS status,
 CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 0 THEN 'False' WHEN l.toxic = 1 THEN 'Misleading' ELSE 'True' END AS verdict,
 CAST(d.n_chars % 101 AS DOUBLE) / 100 AS confidence, d.doc_id AS created_seq FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
EVIDENCE = """evidence_v AS (SELECT conv_id AS claim_id, turn AS ordinal, text AS summary,
 CASE role WHEN 'user' THEN 'supporting' WHEN 'assistant' THEN 'refuting' ELSE 'neutral' END AS stance FROM conversations)"""
PRICES = "prices_v AS (SELECT user_id AS ticker, ts, CAST(1000 AS DOUBLE) - value AS close, event_id AS seq FROM events)"
NEWS = f"""news_v AS (SELECT event_id AS news_id, user_id AS ticker, ts AS published, {_K} AS panic_score,
 concat(event_type, '-', CAST(user_id AS VARCHAR)) AS title FROM events WHERE event_type <> 'error')"""
ITEMS = f"""items_v AS (SELECT event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'news' WHEN event_type = 'signup' THEN 'paparazzi' ELSE 'fan_wars' END AS source,
 2 * {_K} - 100 AS sentiment_score, {_K} % 3 = 0 AS is_threat FROM events)"""
MEASURES = """measures_v AS (SELECT event_id AS id, user_id AS ticker, ts AS deployed_at, CAST(1000 AS DOUBLE) - value AS stock_price_at_deployment
 FROM events WHERE event_type = 'signup')"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def k_of() -> Column:
    return F.get_json_object("props", "$.k").try_cast("int")


def events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def claims(spark: SparkSession, d: str) -> DataFrame:
    doc, lab = table(spark, d, "documents").alias("d"), table(spark, d, "labels").alias("l")
    known = F.col("l.doc_id").isNotNull()
    verdict = F.when(~known, None).when(F.col("l.quality") == 0, "False").when(F.col("l.toxic") == 1, "Misleading").otherwise("True")
    return doc.join(lab, F.col("d.doc_id") == F.col("l.doc_id"), "left").select(
        F.col("d.doc_id").alias("id"), F.col("d.text").alias("claim_text"), F.col("d.source").alias("source_url"),
        F.when(known, "completed").otherwise("pending").alias("status"), verdict.alias("verdict"),
        ((F.col("d.n_chars") % 101).cast("double") / 100).alias("confidence"), F.col("d.doc_id").alias("created_seq"),
    )


def evidence(spark: SparkSession, d: str) -> DataFrame:
    stance = F.when(F.col("role") == "user", "supporting").when(F.col("role") == "assistant", "refuting").otherwise("neutral")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("claim_id"), F.col("turn").alias("ordinal"), F.col("text").alias("summary"), stance.alias("stance"))


def prices(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.col("user_id").alias("ticker"), "ts", (F.lit(1000.0) - F.col("value")).alias("close"), F.col("event_id").alias("seq"))


def news(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"))
    return events(spark, d).where("event_type <> 'error'").select(
        F.col("event_id").alias("news_id"), F.col("user_id").alias("ticker"), F.col("ts").alias("published"), k_of().alias("panic_score"), title.alias("title")
    )


def items(spark: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("event_type").isin("view", "click"), "news").when(F.col("event_type") == "signup", "paparazzi").otherwise("fan_wars")
    return events(spark, d).select(F.col("event_id").alias("seq"), source.alias("source"), (2 * k_of() - 100).alias("sentiment_score"), (k_of() % 3 == 0).alias("is_threat"))


def measures(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type = 'signup'").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("ticker"), F.col("ts").alias("deployed_at"), (F.lit(1000.0) - F.col("value")).alias("stock_price_at_deployment")
    )
