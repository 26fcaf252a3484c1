"""Market anomaly: population z-scores, status, trend, three kinds of drop, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verisift.plans.base import Plan
from verisift.sources.views import MEASURES, PRICES, events, measures, prices

P = Plan()

STATS = "s AS (SELECT ticker, avg(close) AS mean, stddev_pop(close) AS sd, arg_max(close, (ts, seq)) AS latest, arg_min(close, (ts, seq)) AS opening, count(*) AS n FROM prices_v GROUP BY ticker), z AS (SELECT *, CASE WHEN sd > 0 THEN (latest - mean) / sd ELSE 0 END AS z FROM s)"
STATUS = "CASE WHEN z < -2 THEN 'SIGMA_EVENT' WHEN z < -1 THEN 'HIGH_VOLATILITY' WHEN z > 2 THEN 'RALLY' ELSE 'STABLE' END"


def stats(df: DataFrame) -> DataFrame:
    """One pass by ticker: mean, population deviation, first and last price, z of the last one."""
    at = F.struct("ts", "seq")
    s = df.groupBy("ticker").agg(
        F.avg("close").alias("mean"), F.stddev_pop("close").alias("sd"), F.max_by("close", at).alias("latest"), F.min_by("close", at).alias("opening"), F.count(F.lit(1)).alias("n")
    )
    return s.withColumn("z", F.when(F.col("sd") > 0, (F.col("latest") - F.col("mean")) / F.col("sd")).otherwise(F.lit(0.0)))


def status(z: Column) -> Column:
    return F.when(z < -2, "SIGMA_EVENT").when(z < -1, "HIGH_VOLATILITY").when(z > 2, "RALLY").otherwise("STABLE")


@P.query(f"WITH {PRICES}, {STATS} SELECT ticker, round(mean, 4) AS mean, round(sd, 4) AS std_dev, round(z, 4) AS z_score, round(latest, 4) AS latest_price FROM z")
def zscore(spark, d):
    r = lambda a, b: F.round(a, 4).alias(b)
    return stats(prices(spark, d)).select("ticker", r("mean", "mean"), r("sd", "std_dev"), r("z", "z_score"), r("latest", "latest_price"))


@P.query(f"WITH {PRICES}, {STATS} SELECT ticker, {STATUS} AS volatility_status FROM z")
def volatility_status(spark, d):
    return stats(prices(spark, d)).select("ticker", status(F.col("z")).alias("volatility_status"))


TREND = """r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, seq DESC) AS k FROM prices_v), l AS (SELECT ticker, close, k, max(k) OVER (PARTITION BY ticker) AS n FROM r WHERE k <= 10),
f AS (SELECT ticker, regr_slope(close, (n - k)::DOUBLE) AS a, regr_intercept(close, (n - k)::DOUBLE) AS b, max(n) AS n, arg_min(close, k) AS latest FROM l GROUP BY ticker HAVING count(*) >= 2)"""
TREND_LOSS = "round((a * (n + 12) + b - latest) / latest * 100, 4)"


@P.query(f"""WITH {PRICES}, {TREND}
SELECT ticker, round(a, 6) AS slope, round(a * (n + 12) + b, 4) AS projected_price_1hr, {TREND_LOSS} AS projected_loss, CASE WHEN a < -0.1 THEN 'DOWN' WHEN a > 0.1 THEN 'UP' ELSE 'SIDEWAYS' END AS trend FROM f""")
def trend(spark, d):
    w = W.partitionBy("ticker").orderBy(F.desc("ts"), F.desc("seq"))
    last = prices(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 10")
    # x counts from the oldest of the last points: the newest is k = 1.
    g = last.groupBy("ticker").agg(F.regr_slope("close", -F.col("k").cast("double")).alias("a"), F.regr_intercept("close", -F.col("k").cast("double")).alias("b0"), F.max("k").alias("n"), F.min_by("close", "k").alias("latest")).where("n >= 2")
    projected = F.col("b0") + F.col("a") * 12.0
    a = F.col("a")
    return g.select(
        "ticker", F.round(a, 6).alias("slope"), F.round(projected, 4).alias("projected_price_1hr"), F.round((projected - F.col("latest")) / F.col("latest") * 100, 4).alias("projected_loss"),
        F.when(a < -0.1, "DOWN").when(a > 0.1, "UP").otherwise("SIDEWAYS").alias("trend"),
    )


@P.query(f"WITH {PRICES}, {STATS}, i AS (SELECT ticker, latest, (latest - opening) / opening * 100 AS x, z FROM z WHERE n >= 2 AND opening <> 0) SELECT ticker, round(latest, 4) AS current_price, round(x, 4) AS drop_percent, round(z, 2) AS z_score, x <= -2 OR round(z, 2) <= -2 AS is_crashing FROM i")
def stock_impact(spark, d):
    s = stats(prices(spark, d)).where("n >= 2 AND opening <> 0")
    x = (F.col("latest") - F.col("opening")) / F.col("opening") * 100
    return s.select("ticker", F.round("latest", 4).alias("current_price"), F.round(x, 4).alias("drop_percent"), F.round("z", 2).alias("z_score"), ((x <= -2) | (F.round("z", 2) <= -2)).alias("is_crashing"))


LAST2 = "l AS (SELECT ticker, close, lag(close) OVER (PARTITION BY ticker ORDER BY ts, seq) AS prev, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, seq DESC) AS k FROM prices_v)"


def previous(spark, d) -> DataFrame:
    back = W.partitionBy("ticker").orderBy(F.desc("ts"), F.desc("seq"))
    return prices(spark, d).select("ticker", "close", F.lead("close").over(back).alias("prev"), F.row_number().over(back).alias("k")).where("k = 1")


@P.query(f"WITH {PRICES}, {LAST2} SELECT ticker, round(close, 4) AS last_close, round((close - prev) / prev * 100, 4) AS change_percent FROM l WHERE k = 1 AND prev <> 0")
def prev_close_change(spark, d):
    return previous(spark, d).where("prev <> 0").select("ticker", F.round("close", 4).alias("last_close"), F.round((F.col("close") - F.col("prev")) / F.col("prev") * 100, 4).alias("change_percent"))


@P.query(f"WITH {PRICES}, {LAST2}, c AS (SELECT ticker, (close - prev) / prev * 100 AS x FROM l WHERE k = 1 AND prev <> 0) SELECT ticker, CASE WHEN x < -2 THEN 'red' WHEN x > 1 THEN 'green' ELSE 'amber' END AS band FROM c")
def change_band(spark, d):
    x = (F.col("close") - F.col("prev")) / F.col("prev") * 100
    return previous(spark, d).where("prev <> 0").select("ticker", F.when(x < -2, "red").when(x > 1, "green").otherwise("amber").alias("band"))


UI = "p AS (SELECT ticker, ts, seq, CASE WHEN seq % 10 = 3 THEN NULL ELSE close END AS close FROM prices_v), u AS (SELECT ticker, avg(coalesce(close, 0)) AS mean, CASE WHEN count(*) > 2 THEN stddev_pop(coalesce(close, 0)) ELSE 1 END AS sd, arg_max(coalesce(close, 0), (ts, seq)) AS latest, arg_min(coalesce(close, 0), (ts, seq)) AS opening FROM p GROUP BY ticker), v AS (SELECT ticker, CASE WHEN opening <> 0 THEN (latest - opening) / opening * 100 ELSE 0 END AS x, CASE WHEN sd > 0 THEN (latest - mean) / sd ELSE 0 END AS z FROM u)"


@P.query(f"WITH {PRICES}, {UI} SELECT ticker, round(x, 4) AS drop_percent, round(z, 4) AS z_score, abs(x) > 3 OR abs(z) > 2 AS is_anomaly FROM v")
def stock_impact_ui(spark, d):
    """The browser's variant: missing bars count as 0, two bars or fewer have a deviation of 1."""
    p = prices(spark, d).withColumn("close", F.when(F.col("seq") % 10 != 3, F.col("close"))).fillna(0.0, ["close"])
    s = stats(p).withColumn("sd", F.when(F.col("n") > 2, F.col("sd")).otherwise(F.lit(1.0)))
    x = F.when(F.col("opening") != 0, (F.col("latest") - F.col("opening")) / F.col("opening") * 100).otherwise(F.lit(0.0))
    z = F.when(F.col("sd") > 0, (F.col("latest") - F.col("mean")) / F.col("sd")).otherwise(F.lit(0.0))
    return s.select("ticker", F.round(x, 4).alias("drop_percent"), F.round(z, 4).alias("z_score"), ((F.abs(x) > 3) | (F.abs(z) > 2)).alias("is_anomaly"))


@P.query(f"WITH {PRICES}, {MEASURES}, {STATS}, j AS (SELECT m.id, m.ticker, m.stock_price_at_deployment AS p0, s.latest AS p1 FROM measures_v m LEFT JOIN s USING (ticker)), r AS (SELECT *, (p1 - p0) / p0 * 100 AS x FROM j WHERE p0 <> 0 AND p1 <> 0) SELECT id, ticker, round(x, 4) AS recovery_pct, CASE WHEN x > 0.5 THEN 'SUCCESS' WHEN x < -1.0 THEN 'FAILURE' ELSE 'NEUTRAL' END AS effectiveness FROM r")
def recovery(spark, d):
    latest = stats(prices(spark, d)).select("ticker", F.col("latest").alias("p1"))
    j = measures(spark, d).withColumn("p0", F.coalesce(F.col("stock_price_at_deployment").try_cast("double"), F.lit(0.0))).join(latest, "ticker", "left").where("p0 <> 0 AND p1 <> 0")
    x = (F.col("p1") - F.col("p0")) / F.col("p0") * 100
    return j.select("id", "ticker", F.round(x, 4).alias("recovery_pct"), F.when(x > 0.5, "SUCCESS").when(x < -1.0, "FAILURE").otherwise("NEUTRAL").alias("effectiveness"))


@P.query(f"WITH {MEASURES} SELECT id, ticker FROM measures_v WHERE deployed_at >= (SELECT max(deployed_at) FROM measures_v) - INTERVAL 2 HOURS")
def recent_measures(spark, d):
    m = measures(spark, d)
    since = m.agg(F.max("deployed_at") - F.expr("INTERVAL 2 HOURS")).scalar()
    return m.where(F.col("deployed_at") >= since).select("id", "ticker")


@P.query("SELECT user_id AS ticker, count(value) AS n_closes, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def price_extract(spark, d):
    """Closes out of chart documents, nulls dropped: each event is a document with one bar and one missing bar."""
    doc = F.concat(F.lit('{"chart":{"result":[{"meta":{"symbol":"'), F.col("user_id").cast("string"), F.lit('"},"indicators":{"quote":[{"close":['), F.col("value").cast("string"), F.lit(",null]}]}}]}}"))
    schema = "chart struct<result:array<struct<meta:struct<symbol:string>,indicators:struct<quote:array<struct<close:array<double>>>>>>>"
    parsed = events(spark, d).select(F.from_json(doc, schema).alias("j"))
    r = F.get("j.chart.result", 0)
    closes = F.filter(F.get(r["indicators"]["quote"], 0)["close"], lambda x: x.isNotNull())
    flat = parsed.select(r["meta"]["symbol"].try_cast("bigint").alias("ticker"), closes.alias("c"))
    return flat.groupBy("ticker").agg(F.sum(F.size("c")).alias("n_closes"), F.round(F.sum(F.aggregate("c", F.lit(0.0), lambda a, x: a + x)), 2).alias("total"))


@P.query(f"WITH {PRICES}, m AS (SELECT ticker, count(*) AS n, arg_max(close, (ts, seq)) AS latest FROM prices_v WHERE hour(ts) = 12 GROUP BY ticker), dd AS (SELECT ticker, arg_max(close, (ts, seq)) AS daily, count(*) AS nd FROM prices_v GROUP BY ticker) SELECT dd.ticker, CASE WHEN coalesce(n, 0) < 10 THEN 'daily' ELSE 'minute' END AS origin, round(CASE WHEN coalesce(n, 0) < 10 THEN daily ELSE latest END, 4) AS price FROM dd LEFT JOIN m USING (ticker) WHERE coalesce(n, 0) >= 10 OR nd >= 2")
def price_fallback(spark, d):
    """Bars of one hour a day, or all bars where those are fewer than ten."""
    at = F.struct("ts", "seq")
    p = prices(spark, d)
    mid = F.hour("ts") == 12
    g = p.groupBy("ticker").agg(F.count_if(mid).alias("n"), F.max_by("close", F.when(mid, at)).alias("latest"), F.max_by("close", at).alias("daily"), F.count(F.lit(1)).alias("nd"))
    few = F.col("n") < 10
    return g.where(~few | (F.col("nd") >= 2)).select("ticker", F.when(few, "daily").otherwise("minute").alias("origin"), F.round(F.when(few, F.col("daily")).otherwise(F.col("latest")), 4).alias("price"))


#: Grains of bars, finest first, in seconds; bars that a grain must have, and the daily bars that do where no grain has them.
GRAINS, ENOUGH, DAYS = (60, 300, 86_400), 10, 2


def rolled(bars: DataFrame, seconds: int, *more: Column) -> DataFrame:
    """Bars (ticker, day, start in seconds, b: open, high, low, close, n with the times of the first and last tick) of a coarser grain, and more aggregates. Bars
    merge in any order."""
    b = F.col("b")
    merged = F.struct(
        F.min_by(b["open"], b["first"]).alias("open"), F.max(b["high"]).alias("high"), F.min(b["low"]).alias("low"), F.max_by(b["close"], b["last"]).alias("close"), F.sum(b["n"]).alias("n"),
        F.min(b["first"]).alias("first"), F.max(b["last"]).alias("last"),
    )
    start = (F.floor(F.col("start") / seconds) * seconds).alias("start")
    return bars.groupBy("ticker", "day", start).agg(merged.alias("b"), *more)


def dealt(ticks: DataFrame) -> DataFrame:
    """Ticks (ticker, ts, close, seq) as bars of their own, moved once, to their ticker and day: all grains group what lies together then."""
    us = F.unix_micros("ts")
    at = F.struct(us.alias("us"), F.col("seq"))
    one = F.struct(F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), "close", F.lit(1).cast("long").alias("n"), at.alias("first"), at.alias("last"))
    n = int(ticks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    day = F.floor(us / 86_400_000_000)
    return ticks.select("ticker", day.alias("day"), F.floor(us / 1_000_000).alias("start"), one.alias("b")).repartition(n, "ticker", "day")


def bars(ticks: DataFrame) -> dict[int, DataFrame]:
    """Bars of ticks at each grain, each one made of the finer one."""
    out, held = {}, dealt(ticks)
    for grain in GRAINS:
        held = out[grain] = rolled(held, grain)
    return out


_BAR = """b{0} AS (SELECT ticker, epoch_us(ts) // 1000000 // {0} * {0} AS start, arg_min(close, (ts, seq)) AS open, max(close) AS high, min(close) AS low, arg_max(close, (ts, seq)) AS close, count(*) AS n FROM prices_v GROUP BY ALL),
w{0} AS (SELECT ticker, {0} AS grain, count(*) AS n_bars, arg_max(close, start) AS latest, arg_max(close, start) FILTER (WHERE start < last) AS previous, max(high) AS high, min(low) AS low FROM (SELECT *, max(start) OVER (PARTITION BY ticker) AS last FROM b{0} WHERE start >= {1}) GROUP BY ticker)"""
_SINCE = "(SELECT max(epoch_us(ts)) // 1000000 // 86400 * 86400 - {0} * 86400 FROM prices_v)"


@P.query(f"""WITH {PRICES}, {_BAR.format(60, _SINCE.format(4))}, {_BAR.format(300, _SINCE.format(9))}, {_BAR.format(86400, _SINCE.format(29))}, u AS (SELECT * FROM w60 WHERE n_bars >= {ENOUGH} UNION ALL SELECT * FROM w300 WHERE n_bars >= {ENOUGH} UNION ALL SELECT * FROM w86400 WHERE n_bars >= {DAYS})
SELECT ticker, grain, n_bars, round(latest, 4) AS latest, round(previous, 4) AS previous, round(high, 4) AS high, round(low, 4) AS low FROM u QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY grain) = 1""")
def price_bars(spark, d):
    """The finest bars of which a ticker has enough: minutes of the last five days, five minutes of the last ten, days of the last thirty; with the last
    close and the one before."""
    p = prices(spark, d)
    today = p.agg(F.floor(F.max(F.unix_micros("ts")) / 86_400_000_000)).first()[0] or 0
    ended = F.struct("start", F.col("b.close").alias("close"))
    two = lambda c: F.slice(F.sort_array(c, False), 1, 2)
    # Each grain hands on how many bars the finer ones have and the last two of them, so that one pass serves all.
    minutes = rolled(dealt(p), GRAINS[0])
    fives = rolled(minutes, GRAINS[1], F.count(F.lit(1)).alias("n0"), two(F.collect_list(ended)).alias("two0"))
    days = rolled(fives, GRAINS[2], F.sum("n0").alias("n0"), two(F.flatten(F.collect_list("two0"))).alias("two0"), F.count(F.lit(1)).alias("n1"), two(F.collect_list(ended)).alias("two1"))
    days = days.withColumn("n2", F.lit(1).cast("long")).withColumn("two2", F.array(ended))
    looks, out = [], []
    for k, (grain, back, least) in enumerate(zip(GRAINS, (4, 9, 29), (ENOUGH, ENOUGH, DAYS), strict=True)):
        seen = F.col("day") >= today - back
        looks += [
            F.sum(F.when(seen, F.col(f"n{k}"))).alias(f"n{k}"), two(F.flatten(F.collect_list(F.when(seen, F.col(f"two{k}"))))).alias(f"two{k}"),
            F.max(F.when(seen, F.col("b.high"))).alias(f"high{k}"), F.min(F.when(seen, F.col("b.low"))).alias(f"low{k}"),
        ]
        close = lambda i, k=k: F.get(f"two{k}", F.lit(i))["close"]
        bar = F.struct(F.lit(grain).alias("grain"), F.col(f"n{k}").alias("n_bars"), close(0).alias("latest"), close(1).alias("previous"), F.col(f"high{k}").alias("high"), F.col(f"low{k}").alias("low"))
        out.append(F.when(F.col(f"n{k}") >= least, bar))
    finest = days.groupBy("ticker").agg(*looks).select("ticker", F.coalesce(*out).alias("g")).where("g IS NOT NULL")
    four = lambda c: F.round(F.col(f"g.{c}"), 4).alias(c)
    return finest.select("ticker", "g.grain", "g.n_bars", *map(four, ("latest", "previous", "high", "low")))
