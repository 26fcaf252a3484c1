"""Content and VIP threats: unions, enrichment by position, thresholds, counts, alerts, and text parsing."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions.text import MOJIBAKE, bracket_span, fence_slice, fence_split, fence_strip as strip_fence, mojibake_fix as fix, not_empty, strip_block
from verisift.operators.numbering import numbered
from verisift.plans.base import Plan
from verisift.sources.views import ITEMS, NEWS, events, items, k_of, news, table

P = Plan()
K = "CAST(json_extract_string(props, '$.k') AS INT)"


def literal(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)


@P.query(f"WITH {ITEMS}, u AS (SELECT seq, source, sentiment_score, CASE source WHEN 'news' THEN 0 WHEN 'paparazzi' THEN 1 ELSE 2 END AS pri FROM items_v) SELECT seq, source, sentiment_score, pri FROM u")
def content_union(spark, d):
    i = items(spark, d)
    one = lambda s, k: i.where(F.col("source") == s).select("seq", "source", "sentiment_score", F.lit(k).alias("pri"))
    return one("news", 0).unionByName(one("paparazzi", 1)).unionByName(one("fan_wars", 2))


@P.query(f"WITH {ITEMS} SELECT count(*) FILTER (WHERE source = 'paparazzi') AS paparazzi_count, count(*) FILTER (WHERE source = 'news') AS news_count, count(*) FILTER (WHERE source = 'fan_wars') AS fan_wars_count FROM items_v")
def source_counts(spark, d):
    return items(spark, d).agg(*[F.count_if(F.col("source") == s).alias(f"{s}_count") for s in ("paparazzi", "news", "fan_wars")])


LIMITS = {"news": 5, "paparazzi": 15, "fan_wars": 20}


@P.query(f"WITH {ITEMS}, r AS (SELECT seq, source, row_number() OVER (PARTITION BY source ORDER BY seq) AS k FROM items_v) SELECT seq, source FROM r WHERE k <= CASE source WHEN 'news' THEN 5 WHEN 'paparazzi' THEN 15 ELSE 20 END")
def per_source_limit(spark, d):
    i = items(spark, d).select("seq", "source")
    # Each source's top rows are cut in every task before they meet.
    top = [i.where(F.col("source") == s).orderBy("seq").limit(n) for s, n in LIMITS.items()]
    return top[0].unionByName(top[1]).unionByName(top[2])


@P.query(f"WITH {NEWS} SELECT title, min(news_id) AS position, arg_max(panic_score, news_id) AS panic_score FROM news_v GROUP BY title")
def news_dedup_last(spark, d):
    return news(spark, d).groupBy("title").agg(F.min("news_id").alias("position"), F.max_by("panic_score", "news_id").alias("panic_score"))


@P.query(f"WITH {NEWS} SELECT news_id, title FROM news_v ORDER BY published DESC, news_id LIMIT 4")
def news_top4(spark, d):
    return news(spark, d).orderBy(F.desc("published"), "news_id").limit(4).select("news_id", "title")


TERMS = ("view", "click", "purchase", "signup", "fraud", "crash", "scandal", "boycott")


@P.query(f"WITH {NEWS}, t(term) AS (VALUES {values([(t,) for t in TERMS])}) SELECT term, count(*) AS n, max(news_id) AS newest FROM t JOIN news_v ON contains(title, term) GROUP BY term")
def keyword_news(spark, d):
    hits = F.filter(F.array(*map(F.lit, TERMS)), lambda t: F.contains(F.col("title"), t))
    return news(spark, d).select("news_id", F.explode(hits).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("news_id").alias("newest"))


@P.query(f"SELECT event_id AS seq, 2 * {K} - 100 AS sentiment_score, event_type FROM events")
def positional_zip(spark, d):
    """Row i of the enrichment belongs to row i of the queue: a join on the sequence number carried since the union."""
    e = events(spark, d)
    queue = e.select(F.col("event_id").alias("seq"), "event_type")
    answers = e.select(F.col("event_id").alias("seq"), (2 * k_of() - 100).alias("sentiment_score"))
    return queue.join(answers, "seq").select("seq", "sentiment_score", "event_type")


@P.query(f"WITH {ITEMS} SELECT seq, source, sentiment_score FROM items_v WHERE is_threat AND sentiment_score < -70")
def critical_threats(spark, d):
    s = F.coalesce(F.col("sentiment_score").cast("string").try_cast("double").cast("int"), F.lit(0))
    return items(spark, d).where(F.col("is_threat") & (s < -70)).select("seq", "source", s.alias("sentiment_score"))


@P.query(f"WITH {ITEMS} SELECT seq, CASE WHEN sentiment_score < -30 THEN 'red' WHEN sentiment_score > 30 THEN 'green' ELSE 'amber' END AS feed_band, CASE WHEN sentiment_score < -20 THEN 'red' WHEN sentiment_score > 20 THEN 'green' ELSE 'amber' END AS stock_band, least(abs(sentiment_score), 100)::INT AS bar FROM items_v")
def sentiment_band(spark, d):
    s = F.col("sentiment_score")
    band = lambda n: F.when(s < -n, "red").when(s > n, "green").otherwise("amber")
    return items(spark, d).select("seq", band(30).alias("feed_band"), band(20).alias("stock_band"), F.least(F.abs(s), F.lit(100)).alias("bar"))


# Mentions: pages from the web, conversation turns from social media.
MENTIONS = "m AS (SELECT 'web' AS source, page_id AS id, url, '' AS author, coalesce(url, '') || ' - ' || coalesce(html, '') AS content, length(html) AS n FROM pages UNION ALL SELECT 'twitter', conv_id * 1000 + turn, '', role, text, length(text) FROM conversations)"


def mentions(spark, d) -> DataFrame:
    p = table(spark, d, "pages").select(F.lit("web").alias("source"), F.col("page_id").alias("id"), "url", F.lit("").alias("author"), F.concat_ws(" - ", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))).alias("content"), F.length("html").alias("n"))
    c = table(spark, d, "conversations").select(F.lit("twitter").alias("source"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("").alias("url"), F.col("role").alias("author"), F.col("text").alias("content"), F.length("text").alias("n"))
    return p.unionByName(c)


@P.query(f"WITH {MENTIONS} SELECT source, id, url, author, content FROM m")
def mentions_union(spark, d):
    return mentions(spark, d).drop("n")


@P.query(f"WITH {MENTIONS} SELECT id, author FROM m WHERE source = 'twitter' AND author <> 'assistant'")
def mentions_exclude_author(spark, d):
    handle = F.ltrim(F.lit("@assistant"), F.lit("@"))
    return mentions(spark, d).where((F.col("source") == "twitter") & (F.col("author") != handle)).select("id", "author")


@P.query(f"WITH {MENTIONS}, t AS (SELECT source, id, substr(coalesce(nullif(content, ''), nullif(url, ''), author), 1, 200) AS text FROM m) SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY id, text) || '. [' || source || '] ' || text AS line FROM t")
def mention_text(spark, d):
    t = mentions(spark, d).select("source", "id", F.substring(F.coalesce(not_empty("content"), not_empty("url"), F.col("author")), 1, 200).alias("text"))
    n = numbered(t, ["source"], ["id", "text"], "k")
    return n.select("id", "source", F.concat(F.col("k").cast("string"), F.lit(". ["), "source", F.lit("] "), "text").alias("line"))


RISK = "CASE WHEN n % 7 = 0 THEN 'HIGH' WHEN n % 5 = 0 THEN 'MEDIUM' ELSE 'LOW' END"


def risk() -> Column:
    return F.when(F.col("n") % 7 == 0, "HIGH").when(F.col("n") % 5 == 0, "MEDIUM").otherwise("LOW")


@P.query(f"WITH {MENTIONS} SELECT id, source, {RISK} AS risk_level FROM m WHERE {RISK} <> 'LOW'")
def risk_partition(spark, d):
    return mentions(spark, d).select("id", "source", risk().alias("risk_level")).where("risk_level <> 'LOW'")


@P.query(f"WITH {MENTIONS}, r AS (SELECT source, {RISK} AS x FROM m) SELECT count(*) AS total_mentions, count(*) FILTER (WHERE source = 'web') AS web, count(*) FILTER (WHERE source = 'twitter') AS twitter, count(*) FILTER (WHERE x = 'HIGH') AS high, count(*) FILTER (WHERE x = 'MEDIUM') AS medium, count(*) FILTER (WHERE x = 'LOW') AS low FROM r")
def risk_counts(spark, d):
    r = mentions(spark, d).select("source", risk().alias("x"))
    n = r.agg(F.count(F.lit(1)).alias("total_mentions"), F.count_if(F.col("source") == "web").alias("web"), F.count_if(F.col("source") == "twitter").alias("twitter"), F.count_if(F.col("x") == "HIGH").alias("high"), F.count_if(F.col("x") == "MEDIUM").alias("medium"))
    return n.withColumn("low", F.col("total_mentions") - F.col("high") - F.col("medium"))


@P.query(f"SELECT c.conv_id, c.turn AS position, CASE WHEN length(c.text) % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk_level FROM conversations c JOIN conversations t ON t.conv_id = c.conv_id AND c.turn = t.turn - 1")
def risk_index_join(spark, d):
    """Threat k speaks of the mention at position k - 1; indexes without a mention fall away."""
    c = table(spark, d, "conversations")
    threats = c.select(F.col("conv_id"), (F.coalesce("turn", F.lit(1)) - 1).alias("position"))
    m = c.select("conv_id", F.col("turn").alias("position"), F.when(F.length("text") % 2 == 0, "HIGH").otherwise("LOW").alias("risk_level"))
    return m.join(threats, ["conv_id", "position"])


@P.query(f"WITH {MENTIONS} SELECT id, 'whatsapp:+10000000000' AS recipient, substr(content, 1, 100) || '...' AS preview FROM m WHERE {RISK} = 'HIGH'")
def alert_rows(spark, d):
    a = mentions(spark, d).where(risk() == "HIGH")
    return a.select("id", F.concat(F.lit("whatsapp:"), F.lit("+10000000000")).alias("recipient"), F.concat(F.substring("content", 1, 100), F.lit("...")).alias("preview"))


@P.query("SELECT event_id AS id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 3)::INT AS key_index FROM events")
def round_robin(spark, d):
    """The keys take turns within a user. Places are counted by ranges, so that one user's calls may be as many as the table."""
    k = numbered(events(spark, d).select(F.col("event_id").alias("id"), "user_id"), ["user_id"], ["id"], "k")
    return k.select("id", F.pmod(F.col("k") - 1, F.lit(3)).cast("int").alias("key_index"))


@P.query(f"SELECT event_id AS id, {K} AS likes FROM events WHERE event_type <> 'view'")
def social_posts_typed(spark, d):
    """Scraped posts with a like count that is no number are skipped."""
    raw = F.when(F.col("event_type") == "view", "n/a").otherwise(F.get_json_object("props", "$.k"))
    return events(spark, d).select(F.col("event_id").alias("id"), raw.try_cast("int").alias("likes")).where("likes IS NOT NULL")


TICKER = "concat(upper(event_type), '_', user_id, CASE event_id % 4 WHEN 0 THEN '.NS' WHEN 1 THEN '.BO' WHEN 2 THEN '.NS.BO' ELSE '' END)"


@P.query(f"WITH t AS (SELECT event_id AS id, {TICKER} AS ticker FROM events) SELECT id, ticker, CASE WHEN contains(ticker, '.NS') THEN replace(ticker, '.NS', '') WHEN contains(ticker, '.BO') THEN replace(ticker, '.BO', '') ELSE ticker END AS symbol, replace(replace(replace(ticker, '.NS', ''), '.BO', ''), '_', ' ') AS company FROM t")
def ticker_company(spark, d):
    """Symbols and company names of tickers with the endings of two exchanges, with both, or with none."""
    n = F.col("event_id") % 4
    ending = F.when(n == 0, ".NS").when(n == 1, ".BO").when(n == 2, ".NS.BO").otherwise("")
    t = events(spark, d).select(F.col("event_id").alias("id"), F.concat(F.upper("event_type"), F.lit("_"), F.col("user_id").cast("string"), ending).alias("ticker"))
    cut = lambda x, s: F.replace(x, F.lit(s), F.lit(""))
    c = F.col("ticker")
    symbol = F.when(F.contains(c, F.lit(".NS")), cut(c, ".NS")).when(F.contains(c, F.lit(".BO")), cut(c, ".BO")).otherwise(c)
    return t.select("id", "ticker", symbol.alias("symbol"), F.replace(cut(cut(c, ".NS"), ".BO"), F.lit("_"), F.lit(" ")).alias("company"))


@P.query("SELECT p_partkey AS id, replace(lower(p_name), ' ', '-') AS slug FROM part")
def movie_slug(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace(F.lower("p_name"), F.lit(" "), F.lit("-")).alias("slug"))


@P.query("SELECT p_partkey AS id, replace(replace(replace(url_encode(p_name), '%20', '+'), '~', '%7E'), '%2A', '*') AS encoded FROM part")
def keyword_encode(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.url_encode("p_name").alias("encoded"))


@P.query("SELECT o_orderkey AS id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'darkred' WHEN '2' THEN 'red' WHEN '3' THEN 'amber' ELSE 'grey' END AS color FROM orders")
def severity_band(spark, d):
    k = F.substring("o_orderpriority", 1, 1)
    sev = F.when(k == "1", "critical").when(k == "2", "high").when(k == "3", "medium").otherwise("low")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), sev.alias("severity"))
    s = F.col("severity")
    return o.withColumn("color", F.when(s == "critical", "darkred").when(s == "high", "red").when(s == "medium", "amber").otherwise("grey"))


@P.query("SELECT p_partkey AS id, repeat('★', least(CASE WHEN p_size % 4 = 0 THEN 3 ELSE p_size % 10 END, 5)::INT) AS stars FROM part")
def brand_stars(spark, d):
    n = F.coalesce(F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 10), F.lit(3))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.repeat(F.lit("★"), F.least(n, F.lit(5))).alias("stars"))


@P.query(f"SELECT event_id AS id, {K} AS k FROM events")
def fence_strip(spark, d):
    fenced = F.concat(F.lit("```JSON\n"), "props", F.lit("\n```"))
    return events(spark, d).select(F.col("event_id").alias("id"), F.from_json(strip_fence(fenced), "k int")["k"].alias("k"))


@P.query("SELECT event_id AS id, '[' || props || ']' AS found FROM events")
def json_recover(spark, d):
    noisy = F.concat(F.lit("Here you go: ["), "props", F.lit("] - hope it helps"))
    return events(spark, d).select(F.col("event_id").alias("id"), bracket_span(noisy).alias("found"))


@P.query("SELECT page_id AS id, regexp_replace(regexp_replace(html, '(?s)<nav.*?</nav>', '', 'g'), '(?s)<footer.*?</footer>', '', 'g') AS html FROM pages")
def html_block_strip(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), strip_block(strip_block("html", "nav"), "footer").alias("html"))


SPOILT = "|".join(bad for bad, _ in MOJIBAKE)
MENDED = functools.reduce(lambda x, p: f"replace({x}, {quoted(p[0])}, {quoted(p[1])})", MOJIBAKE, f"concat(text, {quoted(SPOILT)})")


@P.query(f"SELECT doc_id AS id, {MENDED} AS text FROM documents")
def mojibake_fix(spark, d):
    """Texts with every known wrong sequence behind them, mended."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), fix(F.concat("text", F.lit(SPOILT))).alias("text"))


@P.query(f"SELECT event_id AS id, {K} AS by_slice, {K} AS by_split FROM events")
def fence_variants(spark, d):
    fenced, amid = F.concat(F.lit("```json"), "props", F.lit("```")), F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone."))
    k = lambda x: F.from_json(x, "k int")["k"]
    return events(spark, d).select(F.col("event_id").alias("id"), k(fence_slice(fenced)).alias("by_slice"), k(fence_split(amid)).alias("by_split"))


@P.query("SELECT doc_id AS id, substr(text, 1, 1000) AS long, substr(text, 1, 500) AS short FROM documents")
def explanation_cut(spark, d):
    t = F.col("text").cast("string")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring(t, 1, 1000).alias("long"), F.substring(t, 1, 500).alias("short"))


@P.query("SELECT event_id AS id, upper(event_type) AS ticker, event_type AS key FROM events")
def input_clean(spark, d):
    """Tickers as typed, and keys with the quotes of a settings file round them."""
    e = events(spark, d)
    typed, quoted_ = F.concat(F.lit("  "), "event_type", F.lit(" ")), F.concat(F.lit("'\""), "event_type", F.lit("\"'"))
    return e.select(F.col("event_id").alias("id"), F.upper(F.trim(typed)).alias("ticker"), F.btrim(quoted_, F.lit("\"'")).alias("key"))


#: Pages of a feed, and items that are read of one.
FEED_PAGES, FEED_ITEMS = 8, 5
#: Feeds made of pages: every sixth item has no title, every tenth feed is cut short in the middle.
FEED = rf"""feed AS (SELECT page_id // {FEED_PAGES} AS feed, page_id, url, CASE WHEN page_id % 6 = 0 THEN '' ELSE trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\s+', ' ', 'g')) END AS title FROM pages),
told AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY page_id) - 1 AS pos FROM feed WHERE title <> '' AND feed % 10 <> 9)"""


def feeds(spark, d) -> DataFrame:
    """feed and its XML document, one for FEED_PAGES pages."""
    raw = F.trim(F.regexp_replace(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), r"\s+", " "))
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28).cast("int")), "EEE, d MMM yyyy")
    item = F.concat(
        F.lit("<item><title> "), F.when(F.col("page_id") % 6 == 0, "").otherwise(safe(raw)), F.lit(" </title><link>"), safe(F.col("url")), F.lit("</link><pubDate>"), day, F.lit(" 10:00:00 GMT</pubDate><source>"),
        safe(F.regexp_extract("url", "//([^/]*)/", 1)), F.lit("</source></item>"),
    )
    pages = table(spark, d, "pages").select(F.floor(F.col("page_id") / FEED_PAGES).alias("feed"), "page_id", item.alias("item"))
    f = pages.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("page_id", "item"))).alias("i"))
    whole = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("i", lambda x: x["item"]), ""), F.lit("</channel></rss>"))
    return f.select("feed", F.when(F.col("feed") % 10 == 9, F.substring(whole, F.lit(1), F.floor(F.length(whole) / 2).cast("int"))).otherwise(whole).alias("xml"))


def rss_items(xml: Column, most: int) -> Column:
    """The first items with a title: title and link of each, an empty link where it has none; no items where the document cannot be read."""
    i = F.from_xml(xml, "channel struct<item: array<struct<title: string, link: string>>>")["channel"]["item"]
    told = F.filter(F.coalesce(i, F.array().cast("array<struct<title: string, link: string>>")), lambda x: F.coalesce(x["title"], F.lit("")) != "")
    return F.slice(F.transform(told, lambda x: F.struct(F.trim(x["title"]).alias("title"), F.trim(F.coalesce(x["link"], F.lit(""))).alias("link"))), 1, most)


@P.query(f"WITH {FEED} SELECT feed, pos::INT AS pos, title, url AS link FROM told WHERE pos < {FEED_ITEMS}")
def rss_parse(spark, d):
    x = feeds(spark, d).select("feed", F.posexplode(rss_items(F.col("xml"), FEED_ITEMS)).alias("pos", "item"))
    return x.select("feed", "pos", F.col("item")["title"].alias("title"), F.col("item")["link"].alias("link"))


@P.query(f"""WITH {FEED} SELECT feed, (row_number() OVER (PARTITION BY feed ORDER BY page_id) - 1)::INT AS pos, title, url AS link, strftime(DATE '2024-01-01' + (page_id % 28)::INT, '%-d %b %Y') || ' 10:00:00' AS published, regexp_extract(url, '//([^/]*)/', 1) AS source
FROM feed WHERE feed % 10 <> 9 QUALIFY pos < {FEED_ITEMS}""")
def news_items(spark, d):
    """The first items of each feed, titled or not, with their time and source."""
    schema = "channel struct<item: array<struct<title: string, link: string, pubDate: string, source: string>>>"
    i = feeds(spark, d).select("feed", F.posexplode(F.from_xml("xml", schema)["channel"]["item"]).alias("pos", "x")).where(F.col("pos") < FEED_ITEMS)
    return i.select("feed", "pos", F.coalesce(F.trim("x.title"), F.lit("")).alias("title"), "x.link", F.regexp_extract("x.pubDate", r"(\d{1,2} \w{3} \d{4} [\d:]+)", 1).alias("published"), "x.source")


# Enrichment: the neutral scorer and its defaults.
@P.query("SELECT event_id AS seq, 0 AS sentiment_score, false AS is_threat, 'Analysis skipped (no key)' AS summary FROM events")
def sentiment_neutral(spark, d):
    from verisift.operators.enrich import NeutralSentiment, enrich

    return enrich(events(spark, d).select(F.col("event_id").alias("seq"), F.col("event_type").alias("text")), NeutralSentiment())


@P.query(f"SELECT event_id AS seq, CASE WHEN {K} % 4 = 0 THEN 0 ELSE 2 * {K} - 100 END AS sentiment_score, CASE WHEN {K} % 4 = 0 THEN 'Incomplete analysis' ELSE 'ok' END AS summary FROM events")
def sentiment_length_repair(spark, d):
    """Answers that are missing are padded; surplus ones find no item."""
    e = events(spark, d)
    queue = e.select(F.col("event_id").alias("seq"))
    answers = e.where(k_of() % 4 != 0).select(F.col("event_id").alias("seq"), (2 * k_of() - 100).alias("s"), F.lit("ok").alias("t"))
    j = queue.join(answers, "seq", "left")
    return j.select("seq", F.coalesce("s", F.lit(0)).alias("sentiment_score"), F.coalesce("t", F.lit("Incomplete analysis")).alias("summary"))


@P.query(f"SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS n_supporting, CASE WHEN event_type = 'error' THEN 0.5::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, {K}::DOUBLE / 50)) END AS confidence FROM events")
def research_validate(spark, d):
    """Model answers that are no JSON or lack a key become the fallback."""
    k = (k_of().cast("double") / 50).cast("string")
    good = F.concat(F.lit('```json\n{"supporting_evidence":["a"],"refuting_evidence":[],"overall_evidence_confidence":'), k, F.lit("}\n```"))
    raw = F.when(F.col("event_type") == "error", "the model refused").otherwise(good)
    j = F.from_json(strip_fence(raw), "supporting_evidence array<string>, refuting_evidence array<string>, overall_evidence_confidence double")
    e = events(spark, d).select(F.col("event_id").alias("id"), j.alias("j"))
    ok = F.col("j.supporting_evidence").isNotNull() & F.col("j.refuting_evidence").isNotNull()
    c = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("j.overall_evidence_confidence"))), F.lit(0.5))
    return e.select("id", F.when(ok, F.size("j.supporting_evidence")).otherwise(0).alias("n_supporting"), F.when(ok, c).otherwise(F.lit(0.5)).alias("confidence"))
