"""Causal correlation of crashes and news: interval join, as-of pick, score, gates, archive and deployment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.operators.intervals import asof_within, interval_join
from verisift.operators.merge import merge_update
from verisift.plans.base import Plan
from verisift.plans.market import STATS, STATUS, TREND, TREND_LOSS, stats, status, trend
from verisift.sources.views import NEWS, PRICES, events, news, prices

P = Plan()
MINUTES = 30
GATE = 80

CAND = f"""crash AS (SELECT event_id AS crash_id, user_id AS crash_ticker, ts AS crash_ts FROM events WHERE event_type = 'error'),
cand AS (SELECT crash_id, crash_ticker, crash_ts, news_id, title, panic_score, date_diff('microsecond', published, crash_ts) AS latency_us FROM crash JOIN news_v ON published < crash_ts AND published >= crash_ts - INTERVAL {MINUTES} MINUTES)"""
GUN = "gun AS (SELECT crash_id, crash_ticker, crash_ts, arg_min(news_id, (latency_us, news_id)) AS news_id, min(latency_us) AS latency_us, arg_min(panic_score, (latency_us, news_id)) AS panic_score, arg_min(title, (latency_us, news_id)) AS title, count(*) AS total_candidates FROM cand GROUP BY ALL)"
SCORE = "score AS (SELECT *, CAST(trunc(0.6::DOUBLE * greatest(0::DOUBLE, 100 - 3 * (latency_us::DOUBLE / 60000000)) + 0.4::DOUBLE * panic_score) AS INT) AS correlation_confidence FROM gun)"


def crashes(spark, d) -> DataFrame:
    return events(spark, d).where("event_type = 'error'").select(F.col("event_id").alias("crash_id"), F.col("user_id").alias("crash_ticker"), F.col("ts").alias("crash_ts"))


def candidates(spark, d) -> DataFrame:
    c, n = crashes(spark, d).select("crash_id", "crash_ts"), news(spark, d).select("news_id", "published")
    return interval_join(c, n, "crash_ts", "published", MINUTES)


def guns(spark, d) -> DataFrame:
    """The latest article before each crash; of equal ones the least id."""
    n = news(spark, d).select("news_id", "published", "panic_score", "title")
    g = asof_within(crashes(spark, d), n, "crash_ts", "published", "news_id", MINUTES, "total_candidates")
    return g.select("crash_id", "crash_ticker", "crash_ts", "news_id", "latency_us", "panic_score", "title", "total_candidates")


def score(g: DataFrame) -> DataFrame:
    near = F.greatest(F.lit(0.0), 100 - 3 * (F.col("latency_us").cast("double") / 60_000_000))
    return g.withColumn("correlation_confidence", (F.lit(0.6) * near + F.lit(0.4) * F.col("panic_score")).cast("int"))


def scored(spark, d) -> DataFrame:
    return score(guns(spark, d))


@P.query(f"WITH {NEWS}, {CAND} SELECT crash_id, news_id, latency_us FROM cand")
def causal_candidates(spark, d):
    return candidates(spark, d).select("crash_id", "news_id", "latency_us")


@P.query(f"WITH {NEWS}, {CAND}, {GUN} SELECT crash_id, news_id, title, latency_us, total_candidates FROM gun")
def smoking_gun(spark, d):
    return guns(spark, d).select("crash_id", "news_id", "title", "latency_us", "total_candidates")


@P.query(f"WITH {NEWS}, {CAND}, {GUN}, {SCORE} SELECT crash_id, news_id, correlation_confidence, CASE WHEN correlation_confidence > {GATE} THEN 'HIGH' ELSE 'MEDIUM' END AS verdict, total_candidates FROM score")
def correlation_confidence(spark, d):
    c = F.col("correlation_confidence")
    return scored(spark, d).select("crash_id", "news_id", "correlation_confidence", F.when(c > GATE, "HIGH").otherwise("MEDIUM").alias("verdict"), "total_candidates")


FULL = f"{PRICES}, {NEWS}, {STATS}, {CAND}, {GUN}, {SCORE}, w AS (SELECT c.crash_id, c.crash_ticker AS ticker, c.crash_ts, {STATUS} AS volatility, round(z, 4) AS z_score, news_id, latency_us, correlation_confidence FROM crash c JOIN z ON z.ticker = c.crash_ticker LEFT JOIN score USING (crash_id)), st AS (SELECT *, CASE WHEN volatility <> 'SIGMA_EVENT' THEN 'NO_CRASH' WHEN news_id IS NULL THEN 'NO_SMOKING_GUN' WHEN correlation_confidence < {GATE} THEN 'LOW_CONFIDENCE' ELSE 'ATTACK' END AS status FROM w)"


def gated(spark, d) -> DataFrame:
    """All crashes with the gate at which each one stops."""
    z = stats(prices(spark, d)).select(F.col("ticker"), "z")
    s = scored(spark, d).select("crash_id", "news_id", "latency_us", "correlation_confidence")
    j = crashes(spark, d).withColumnRenamed("crash_ticker", "ticker").join(z, "ticker").join(s, "crash_id", "left")
    j = j.withColumn("volatility", status(F.col("z"))).withColumn("z_score", F.round("z", 4)).drop("z")
    gate = (
        F.when(F.col("volatility") != "SIGMA_EVENT", "NO_CRASH").when(F.col("news_id").isNull(), "NO_SMOKING_GUN")
        .when(F.col("correlation_confidence") < GATE, "LOW_CONFIDENCE").otherwise("ATTACK")
    )
    return j.withColumn("status", gate)


@P.query(f"WITH {FULL} SELECT crash_id, ticker, status FROM st")
def warroom_status(spark, d):
    return gated(spark, d).select("crash_id", "ticker", "status")


@P.query(f"WITH {FULL} SELECT crash_id, ticker, z_score, abs(z_score) AS severity, news_id, latency_us, correlation_confidence FROM st WHERE status = 'ATTACK'")
def warroom(spark, d):
    return gated(spark, d).where("status = 'ATTACK'").select("crash_id", "ticker", "z_score", F.abs("z_score").alias("severity"), "news_id", "latency_us", "correlation_confidence")


ARCHIVE = f"""{FULL}, {TREND}, x AS (SELECT st.*, g.title, g.panic_score FROM st JOIN gun g USING (crash_id) WHERE status = 'ATTACK')
SELECT concat(ticker::VARCHAR, '_', strftime(crash_ts, '%Y%m%d_%H%M%S')) AS event_id, ticker, crash_ts AS crash_timestamp, round(z.latest, 4) AS current_price, t.projected_loss, z_score, title AS smoking_gun_headline, '' AS smoking_gun_link,
  panic_score, correlation_confidence, round(latency_us::DOUBLE / 60000000, 2) AS latency_minutes, NULL::VARCHAR AS responses, false AS response_deployed FROM x JOIN z USING (ticker) LEFT JOIN (SELECT ticker, {TREND_LOSS} AS projected_loss FROM f) t USING (ticker)"""


def archived(guns_: DataFrame, spark, d) -> DataFrame:
    """The attack packages of crashes and their articles: those that pass all gates, with the archive's thirteen columns. responses come from a model and are null."""
    z = stats(prices(spark, d)).select("ticker", "z", F.round("latest", 4).alias("current_price"))
    j = score(guns_).withColumnRenamed("crash_ticker", "ticker").join(z, "ticker").where((status(F.col("z")) == "SIGMA_EVENT") & (F.col("correlation_confidence") >= GATE))
    j = j.join(trend(spark, d).select("ticker", "projected_loss"), "ticker", "left")
    key = F.concat(F.col("ticker").cast("string"), F.lit("_"), F.date_format("crash_ts", "yyyyMMdd_HHmmss"))
    return j.select(
        key.alias("event_id"), "ticker", F.col("crash_ts").cast("timestamp_ntz").alias("crash_timestamp"), "current_price", "projected_loss", F.round("z", 4).alias("z_score"), F.col("title").alias("smoking_gun_headline"), F.lit("").alias("smoking_gun_link"),
        "panic_score", "correlation_confidence", F.round(F.col("latency_us").cast("double") / 60_000_000, 2).alias("latency_minutes"), F.lit(None).cast("string").alias("responses"), F.lit(False).alias("response_deployed"),
    )


@P.query(f"WITH {ARCHIVE}")
def threat_archive(spark, d):
    return archived(guns(spark, d), spark, d)


@P.query("""WITH a AS (SELECT event_id AS news_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'n/a' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS published FROM events)
SELECT news_id, try_strptime(published, '%Y-%m-%dT%H:%M:%S') AS published FROM a WHERE try_strptime(published, '%Y-%m-%dT%H:%M:%S') IS NOT NULL""")
def news_timestamps(spark, d):
    """Articles whose time is missing or cannot be read are left out."""
    raw = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    e = events(spark, d).select(F.col("event_id").alias("news_id"), F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("published"))
    return e.where("published IS NOT NULL")


@P.query("SELECT event_id AS id, concat(user_id::VARCHAR, '_', strftime(ts, '%Y%m%d_%H%M%S')) AS event_id FROM events WHERE event_type = 'error'")
def event_id(spark, d):
    e = events(spark, d).where("event_type = 'error'")
    return e.select(F.col("event_id").alias("id"), F.concat(F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd_HHmmss")).alias("event_id"))


@P.query(f"WITH {PRICES}, {STATS}, l AS (SELECT ticker, max(ts) AS ts FROM prices_v GROUP BY ticker) SELECT ticker, {STATUS} AS signal_type, round(z, 4) AS severity FROM z JOIN l USING (ticker) ORDER BY l.ts DESC, ticker LIMIT 20")
def signals_topn(spark, d):
    p = prices(spark, d)
    last = p.groupBy("ticker").agg(F.max("ts").alias("ts"))
    s = stats(p).join(last, "ticker").select("ticker", status(F.col("z")).alias("signal_type"), F.round("z", 4).alias("severity"), "ts")
    return s.orderBy(F.desc("ts"), "ticker").limit(20).drop("ts")


@P.query(f"WITH {NEWS}, {CAND}, {GUN}, {SCORE} SELECT crash_id, correlation_confidence FROM score ORDER BY crash_ts DESC, crash_id LIMIT 10")
def threats_topn(spark, d):
    return scored(spark, d).orderBy(F.desc("crash_ts"), "crash_id").limit(10).select("crash_id", "correlation_confidence")


# Deployment requests: every signup event asks for a measure against the crash of the same number plus one.
ASK = "ask AS (SELECT event_id AS ask_id, event_id + 1 AS threat_id FROM events WHERE event_type = 'signup')"


def asks(spark, d) -> DataFrame:
    return events(spark, d).where("event_type = 'signup'").select(F.col("event_id").alias("ask_id"), (F.col("event_id") + 1).alias("threat_id"))


@P.query(f"WITH {NEWS}, {PRICES}, {STATS}, {CAND}, {GUN}, {SCORE}, {ASK} SELECT ask_id, crash_id, crash_ticker AS ticker, round(latest, 4) AS price, true AS response_deployed FROM ask JOIN score ON threat_id = crash_id JOIN z ON z.ticker = crash_ticker")
def deploy_measure(spark, d):
    latest = stats(prices(spark, d)).select("ticker", F.round("latest", 4).alias("price"))
    threats = scored(spark, d).select("crash_id", F.col("crash_ticker").alias("ticker"), F.lit(False).alias("response_deployed"))
    ok = asks(spark, d).join(threats, F.col("threat_id") == F.col("crash_id"))
    flagged = merge_update(threats, ok.select("crash_id").withColumn("response_deployed", F.lit(True)), "crash_id", ["response_deployed"])
    return ok.select("ask_id", "crash_id").join(flagged.where("response_deployed"), "crash_id").join(latest, "ticker").select("ask_id", "crash_id", "ticker", "price", "response_deployed")


@P.query(f"WITH {NEWS}, {CAND}, {GUN}, {ASK} SELECT ask_id, threat_id, 404 AS code FROM ask WHERE threat_id NOT IN (SELECT crash_id FROM gun)")
def deploy_rejects(spark, d):
    threats = guns(spark, d).select(F.col("crash_id").alias("threat_id"))
    return asks(spark, d).join(threats, "threat_id", "left_anti").select("ask_id", "threat_id", F.lit(404).alias("code"))
