"""Claim lifecycle: normalise, hash, dedup, evidence, updates, dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.functions.text import claim_hash as hashed
from verisift.functions.text import hash_sql, normalize, normalize_sql, not_empty
from verisift.operators.merge import first_of, merge_update
from verisift.operators.sampling import hash_sample
from verisift.operators.staging import fresh
from verisift.plans.base import Plan
from verisift.sources.datasets import csv_scan, csv_sink
from verisift.sources.views import CLAIMS, EVIDENCE, claims, events, evidence, table

P = Plan()
HASHED = f"{CLAIMS}, h AS (SELECT *, {hash_sql('claim_text')} AS claim_hash FROM claims_v)"


def with_hash(spark: SparkSession, d: str) -> DataFrame:
    return claims(spark, d).withColumn("claim_hash", hashed("claim_text"))


def bucket(v: Column) -> Column:
    low = F.lower(v)
    return F.when(low.isin("true", "1", "real"), "True").when(low.isin("misleading", "partially true", "mixed"), "Misleading").otherwise("False")


BUCKET = "CASE WHEN lower(verdict) IN ('true', '1', 'real') THEN 'True' WHEN lower(verdict) IN ('misleading', 'partially true', 'mixed') THEN 'Misleading' ELSE 'False' END"
#: Fixed value: what stands for a reason where there is none.
NO_REASON = "AI-verified claim from live news feed."


@P.query(f"WITH {CLAIMS} SELECT id, {normalize_sql('claim_text')} AS normalized_text FROM claims_v")
def claim_normalize(spark, d):
    return claims(spark, d).select("id", normalize("claim_text").alias("normalized_text"))


@P.query(f"WITH {HASHED} SELECT id, claim_hash FROM h")
def claim_hash(spark, d):
    return with_hash(spark, d).select("id", "claim_hash")


@P.query(f"WITH {CLAIMS} SELECT id, length(claim_text)::INT AS n_chars FROM claims_v")
def claim_length(spark, d):
    return claims(spark, d).select("id", F.length("claim_text").alias("n_chars"))


@P.query(f"WITH {HASHED} SELECT claim_hash, min(id) AS id FROM h GROUP BY claim_hash")
def claim_batch_dedup(spark, d):
    return with_hash(spark, d).groupBy("claim_hash").agg(F.min("id").alias("id"))


@P.query(f"WITH {HASHED} SELECT id, claim_hash FROM h WHERE status = 'pending' AND claim_hash NOT IN (SELECT claim_hash FROM h WHERE status = 'completed')")
def claim_new_anti(spark, d):
    h = with_hash(spark, d)
    return h.where("status = 'pending'").join(h.where("status = 'completed'").select("claim_hash"), "claim_hash", "left_anti").select("id", "claim_hash")


@P.query(f"WITH {HASHED} SELECT id, claim_hash FROM h WHERE status = 'pending' AND claim_hash IN (SELECT claim_hash FROM h WHERE status = 'completed')")
def claim_dup_semi(spark, d):
    h = with_hash(spark, d)
    return h.where("status = 'pending'").join(h.where("status = 'completed'").select("claim_hash"), "claim_hash", "left_semi").select("id", "claim_hash")


@P.query(f"WITH {HASHED}, n AS (SELECT count(*) FILTER (WHERE claim_hash NOT IN (SELECT claim_hash FROM h WHERE status = 'completed')) AS submitted, count(*) AS n FROM h WHERE status = 'pending') SELECT submitted, n - submitted AS skipped FROM n")
def ingest_counters(spark, d):
    h = with_hash(spark, d)
    known = h.where("status = 'completed'").select("claim_hash").distinct().withColumn("known", F.lit(True))
    j = h.where("status = 'pending'").join(known, "claim_hash", "left")
    return j.agg(F.count_if(F.col("known").isNull()).alias("submitted"), F.count_if("known").alias("skipped"))


@P.query(f"WITH {HASHED} SELECT id, claim_hash, status FROM h WHERE claim_hash = (SELECT claim_hash FROM h WHERE id = 1)")
def claim_by_hash(spark, d):
    h = with_hash(spark, d)
    return h.join(h.where("id = 1").select("claim_hash"), "claim_hash", "left_semi").select("id", "claim_hash", "status")


@P.query(f"WITH {CLAIMS} SELECT id, status, verdict, confidence FROM claims_v WHERE id = 42")
def claim_by_id(spark, d):
    return claims(spark, d).where("id = 42").select("id", "status", "verdict", "confidence")


@P.query(f"WITH {CLAIMS}, {EVIDENCE} SELECT c.id, c.status, count(e.claim_id) AS n_evidence, coalesce(string_agg(e.stance || ':' || e.summary, '|' ORDER BY e.ordinal, e.summary), '') AS evidence FROM claims_v c LEFT JOIN evidence_v e ON c.id = e.claim_id GROUP BY c.id, c.status")
def claim_with_evidence(spark, d):
    e = evidence(spark, d).select("claim_id", F.struct("ordinal", "summary", "stance").alias("e"))
    per = e.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("e")).alias("all"))
    text = F.array_join(F.transform("all", lambda x: F.concat(x["stance"], F.lit(":"), x["summary"])), "|")
    return claims(spark, d).join(per, F.col("id") == F.col("claim_id"), "left").select("id", "status", F.coalesce("n", F.lit(0)).alias("n_evidence"), F.coalesce(text, F.lit("")).alias("evidence"))


@P.query(f"WITH {CLAIMS} SELECT id, coalesce(nullif({normalize_sql('claim_text')}, ''), claim_text) AS text FROM claims_v")
def claim_text_pick(spark, d):
    n = claims(spark, d).withColumn("normalized_text", normalize("claim_text"))
    return n.select("id", F.coalesce(not_empty("normalized_text"), F.col("claim_text")).alias("text"))


@P.query(f"WITH {HASHED} SELECT claim_hash, claim_text, {normalize_sql('claim_text')} AS normalized_text, 'pending' AS status, NULL::VARCHAR AS verdict, NULL::DOUBLE AS confidence, NULL::VARCHAR AS severity, NULL::VARCHAR AS reasoning FROM h WHERE status = 'pending'")
def claim_insert_rows(spark, d):
    null = lambda t, n: F.lit(None).cast(t).alias(n)
    h = with_hash(spark, d).where("status = 'pending'")
    return h.select("claim_hash", "claim_text", normalize("claim_text").alias("normalized_text"), F.lit("pending").alias("status"), null("string", "verdict"), null("double", "confidence"), null("string", "severity"), null("string", "reasoning"))


@P.query(f"WITH {CLAIMS} SELECT c.id, CASE WHEN e.claim_id IS NOT NULL AND c.status = 'pending' THEN 'in_progress' ELSE c.status END AS status FROM claims_v c LEFT JOIN (SELECT DISTINCT conv_id AS claim_id FROM conversations) e ON c.id = e.claim_id")
def claim_status_update(spark, d):
    c = claims(spark, d).select("id", "status")
    picked = c.where("status = 'pending'").join(evidence(spark, d).select(F.col("claim_id").alias("id")).distinct(), "id", "left_semi")
    return merge_update(c, picked.withColumn("status", F.lit("in_progress")), "id", ["status"])


@P.query(f"WITH {CLAIMS}, {EVIDENCE}, s AS (SELECT claim_id, count(*) FILTER (WHERE stance = 'supporting') AS a, count(*) FILTER (WHERE stance = 'refuting') AS b FROM evidence_v GROUP BY claim_id) SELECT id, CASE WHEN claim_id IS NULL THEN status ELSE 'completed' END AS status, CASE WHEN claim_id IS NULL THEN verdict WHEN a > b THEN 'True' WHEN a < b THEN 'False' ELSE 'Misleading' END AS verdict FROM claims_v LEFT JOIN s ON id = claim_id")
def claim_final_update(spark, d):
    c = claims(spark, d).select("id", "status", "verdict")
    s = evidence(spark, d).groupBy(F.col("claim_id").alias("id")).agg(F.count_if(F.col("stance") == "supporting").alias("a"), F.count_if(F.col("stance") == "refuting").alias("b"))
    verdict = F.when(F.col("a") > F.col("b"), "True").when(F.col("a") < F.col("b"), "False").otherwise("Misleading")
    return merge_update(c, s.select("id", F.lit("completed").alias("status"), verdict.alias("verdict")), "id", ["status", "verdict"])


@P.query("SELECT user_id AS claim_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_changes FROM events GROUP BY user_id")
def claim_latest_state(spark, d):
    return events(spark, d).groupBy(F.col("user_id").alias("claim_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count(F.lit(1)).alias("n_changes"))


@P.query("SELECT event_id AS id, 'failed' AS status, 'Internal processing error: ' || props AS reasoning FROM events WHERE event_type = 'error'")
def claim_failure_rows(spark, d):
    return events(spark, d).where("event_type = 'error'").select(F.col("event_id").alias("id"), F.lit("failed").alias("status"), F.concat(F.lit("Internal processing error: "), "props").alias("reasoning"))


@P.query(f"WITH {CLAIMS} SELECT id, status, verdict FROM claims_v ORDER BY id LIMIT 50 OFFSET 10")
def claims_page(spark, d):
    return claims(spark, d).select("id", "status", "verdict").orderBy("id").offset(10).limit(50)


@P.query(f"WITH {CLAIMS} SELECT count(*) AS total_claims FROM (SELECT id FROM claims_v ORDER BY id LIMIT 50 OFFSET 10)")
def claims_page_count(spark, d):
    return claims_page(spark, d).agg(F.count(F.lit(1)).alias("total_claims"))


@P.query(f"WITH {CLAIMS} SELECT id, verdict FROM claims_v WHERE (contains(lower(claim_text), 'worth') OR contains(lower(coalesce(source_url, '')), 'worth')) AND verdict = 'Misleading'")
def claim_search(spark, d):
    hit = F.contains(F.lower("claim_text"), F.lit("worth")) | F.contains(F.lower(F.coalesce("source_url", F.lit(""))), F.lit("worth"))
    return claims(spark, d).where(hit & (F.col("verdict") == "Misleading")).select("id", "verdict")


@P.query(f"WITH {CLAIMS} SELECT id FROM claims_v WHERE contains(lower(concat_ws(' ', claim_text, verdict, source_url)), 'src1') AND verdict = 'True'")
def card_search(spark, d):
    return claims(spark, d).where(F.contains(F.lower(F.concat_ws(" ", "claim_text", "verdict", "source_url")), F.lit("src1")) & (F.col("verdict") == "True")).select("id")


@P.query(f"WITH {CLAIMS}, {EVIDENCE}, n AS (SELECT claim_id, count(*) AS k FROM evidence_v GROUP BY claim_id) SELECT id, 'done' AS submitted, CASE WHEN k > 0 THEN 'done' WHEN status = 'completed' THEN 'skipped' ELSE 'active' END AS research, CASE WHEN verdict IS NOT NULL THEN 'done' WHEN k > 0 THEN 'active' ELSE 'waiting' END AS verdict_step FROM claims_v LEFT JOIN n ON id = claim_id")
def claim_timeline(spark, d):
    n = evidence(spark, d).groupBy("claim_id").agg(F.count(F.lit(1)).alias("k"))
    j = claims(spark, d).join(n, F.col("id") == F.col("claim_id"), "left")
    research = F.when(F.col("k") > 0, "done").when(F.col("status") == "completed", "skipped").otherwise("active")
    step = F.when(F.col("verdict").isNotNull(), "done").when(F.col("k") > 0, "active").otherwise("waiting")
    return j.select("id", F.lit("done").alias("submitted"), research.alias("research"), step.alias("verdict_step"))


@P.query(f"WITH {CLAIMS} SELECT id, {BUCKET} AS verdict FROM claims_v")
def verdict_bucket(spark, d):
    return claims(spark, d).select("id", bucket(F.col("verdict")).alias("verdict"))


@P.query(f"WITH {CLAIMS} SELECT id, CASE WHEN lower(verdict) = 'true' THEN 'true' WHEN lower(verdict) = 'false' THEN 'false' WHEN contains(lower(verdict), 'mislead') THEN 'misleading' ELSE 'pending' END AS class FROM claims_v")
def verdict_class(spark, d):
    v = F.lower("verdict")
    c = F.when(v == "true", "true").when(v == "false", "false").when(F.contains(v, F.lit("mislead")), "misleading").otherwise("pending")
    return claims(spark, d).select("id", c.alias("class"))


@P.query(f"WITH {CLAIMS} SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'True') AS n_true, count(*) FILTER (WHERE verdict = 'False') AS n_false, count(*) FILTER (WHERE verdict = 'Misleading') AS n_misleading, count(*) FILTER (WHERE verdict IS NULL) AS n_unverified FROM claims_v")
def verdict_counts(spark, d):
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    c = claims(spark, d).agg(F.count(F.lit(1)).alias("total"), is_("True").alias("n_true"), is_("False").alias("n_false"), is_("Misleading").alias("n_misleading"))
    return c.withColumn("n_unverified", F.col("total") - F.col("n_true") - F.col("n_false") - F.col("n_misleading"))


@P.query("SELECT event_id AS id, CASE WHEN event_type IN ('view', 'click') THEN 'True' WHEN event_type = 'error' THEN 'Misleading' ELSE 'Unverified' END AS verdict, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) < 30 THEN 'Low' WHEN CAST(json_extract_string(props, '$.k') AS INT) > 70 THEN 'High' ELSE 'Medium' END AS severity FROM events")
def verdict_validate(spark, d):
    e = events(spark, d)
    raw = F.when(F.col("event_type").isin("view", "click"), "True").when(F.col("event_type") == "error", "Misleading").otherwise(F.col("event_type"))
    k = F.get_json_object("props", "$.k").try_cast("int")
    sev = F.when(k < 30, "Low").when(k > 70, "High").otherwise("unknown")
    valid = lambda c, kinds, other: F.when(c.isin(*kinds), c).otherwise(other)
    return e.select(F.col("event_id").alias("id"), valid(raw, ("True", "False", "Misleading", "Unverified"), "Unverified").alias("verdict"), valid(sev, ("Low", "Medium", "High"), "Medium").alias("severity"))


@P.query("SELECT event_id AS id, coalesce(greatest(0::DOUBLE, least(1::DOUBLE, TRY_CAST(CASE WHEN event_type = 'view' THEN 'high' ELSE CAST(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50 - 0.5::DOUBLE AS VARCHAR) END AS DOUBLE))), 0.5::DOUBLE) AS confidence FROM events")
def confidence_clamp(spark, d):
    raw = F.when(F.col("event_type") == "view", "high").otherwise((F.get_json_object("props", "$.k").try_cast("double") / 50 - 0.5).cast("string"))
    c = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw.try_cast("double"))), F.lit(0.5))
    return events(spark, d).select(F.col("event_id").alias("id"), c.alias("confidence"))


@P.query(f"WITH {CLAIMS}, p AS (SELECT id, CAST(floor(confidence * 100 + 0.5::DOUBLE) AS INT) AS pct FROM claims_v) SELECT id, pct, CASE WHEN pct >= 70 THEN 'high' WHEN pct >= 40 THEN 'medium' ELSE 'low' END AS band FROM p")
def confidence_band(spark, d):
    pct = F.floor(F.col("confidence") * 100 + 0.5).cast("int")
    p = claims(spark, d).select("id", pct.alias("pct"))
    return p.withColumn("band", F.when(F.col("pct") >= 70, "high").when(F.col("pct") >= 40, "medium").otherwise("low"))


def recent(spark, d) -> DataFrame:
    c = claims(spark, d).where("status = 'completed' AND verdict IS NOT NULL").orderBy(F.col("created_seq").desc()).limit(30)
    return c.select("id", F.col("claim_text").alias("claim"), bucket(F.col("verdict")).alias("verdict"), F.coalesce(not_empty("source_url"), F.lit(NO_REASON)).alias("explanation"))


RECENT = f"SELECT id, claim_text AS claim, {BUCKET} AS verdict, coalesce(nullif(source_url, ''), '{NO_REASON}') AS explanation FROM (SELECT * FROM claims_v WHERE status = 'completed' AND verdict IS NOT NULL ORDER BY created_seq DESC LIMIT 30)"


@P.query(f"WITH {CLAIMS} {RECENT}")
def dashboard_recent(spark, d):
    return recent(spark, d)


@P.query(f"WITH {CLAIMS}, r AS ({RECENT}), s AS (SELECT id, claim_text AS claim, {BUCKET} AS verdict, '' AS explanation FROM claims_v WHERE status = 'pending' ORDER BY sha256(id::VARCHAR || '#1'), id LIMIT 15), u AS (SELECT *, 0 AS pri FROM r UNION ALL SELECT *, 1 FROM s), n AS (SELECT *, row_number() OVER (ORDER BY pri, id) AS k, (SELECT count(*) FROM r) AS real FROM u) SELECT id, claim, verdict, pri AS sampled FROM n WHERE k <= greatest(15, real)")
def dashboard_topup(spark, d):
    r = recent(spark, d).withColumn("sampled", F.lit(0))
    s = hash_sample(claims(spark, d).where("status = 'pending'"), "id", 15, 1)
    s = s.select("id", F.col("claim_text").alias("claim"), bucket(F.col("verdict")).alias("verdict"), F.lit("").alias("explanation"), F.lit(1).alias("sampled"))
    from pyspark.sql import Window as W

    u = r.unionByName(s).withColumn("k", F.row_number().over(W.orderBy("sampled", "id")))  # 45 rows at most
    u = u.withColumn("most", F.greatest(F.lit(15), F.count_if(F.col("sampled") == 0).over(W.partitionBy())))
    return u.where("k <= most").select("id", "claim", "verdict", "sampled")


@P.query(f"WITH {EVIDENCE} SELECT claim_id, ordinal, CASE stance WHEN 'supporting' THEN 'support' WHEN 'refuting' THEN 'refute' ELSE 'neutral' END AS stance, '' AS source_url FROM evidence_v")
def stance_normalize(spark, d):
    s = F.when(F.col("stance") == "supporting", "support").when(F.col("stance") == "refuting", "refute").otherwise("neutral")
    return evidence(spark, d).select("claim_id", "ordinal", s.alias("stance"), F.coalesce(F.lit(None).cast("string"), F.lit("")).alias("source_url"))


@P.query(f"WITH {CLAIMS}, {EVIDENCE}, p AS (SELECT claim_id, arg_min((stance, summary), (CASE stance WHEN 'refuting' THEN 0 WHEN 'supporting' THEN 1 ELSE 2 END, ordinal, summary)) AS e FROM evidence_v WHERE stance <> 'neutral' GROUP BY claim_id) SELECT id, coalesce(e[1], 'neutral') AS stance, coalesce(e[2], 'No direct evidence found.') AS summary FROM claims_v LEFT JOIN p ON id = claim_id")
def evidence_select_one(spark, d):
    pri = F.when(F.col("stance") == "refuting", 0).otherwise(1)
    e = evidence(spark, d).where("stance <> 'neutral'").groupBy("claim_id").agg(F.min(F.struct(pri.alias("p"), "ordinal", "summary", "stance")).alias("e"))
    j = claims(spark, d).join(e, F.col("id") == F.col("claim_id"), "left")
    return j.select("id", F.coalesce("e.stance", F.lit("neutral")).alias("stance"), F.coalesce("e.summary", F.lit("No direct evidence found.")).alias("summary"))


@P.query(f"WITH {EVIDENCE} SELECT claim_id, count(*) FILTER (WHERE stance = 'supporting') AS n_supporting, count(*) FILTER (WHERE stance = 'refuting') AS n_refuting FROM evidence_v GROUP BY claim_id")
def evidence_counts(spark, d):
    n = lambda s: F.count_if(F.col("stance") == s)
    return evidence(spark, d).groupBy("claim_id").agg(n("supporting").alias("n_supporting"), n("refuting").alias("n_refuting"))


@P.query(f"WITH {CLAIMS}, {EVIDENCE} SELECT claim_id, ordinal FROM evidence_v WHERE claim_id IN (SELECT id FROM claims_v WHERE status = 'completed')")
def evidence_orphan_filter(spark, d):
    live = claims(spark, d).where("status = 'completed'").select(F.col("id").alias("claim_id"))
    return evidence(spark, d).join(live, "claim_id", "left_semi").select("claim_id", "ordinal")


@P.query(f"WITH {CLAIMS} SELECT sha1(string_agg(claim_text, chr(10) ORDER BY id)) AS checksum FROM (SELECT * FROM claims_v ORDER BY id LIMIT 30)")
def claims_checksum(spark, d):
    page = claims(spark, d).select("id", "claim_text").orderBy("id").limit(30)
    rows = page.agg(F.array_sort(F.collect_list(F.struct("id", "claim_text"))).alias("r"))  # one page
    return rows.select(F.sha1(F.array_join(F.transform("r", lambda x: x["claim_text"]), "\n")).alias("checksum"))


@P.query(f"WITH {CLAIMS} SELECT id, regexp_replace(substr(claim_text, 1, 120), '[^\\x00-\\x7F]', '?', 'g') AS header FROM claims_v")
def ascii_header(spark, d):
    return claims(spark, d).select("id", F.regexp_replace(F.substring("claim_text", 1, 120), r"[^\x00-\x7F]", "?").alias("header"))


# Labelled datasets: title and label with invalid labels as 0.
DATA = "data AS (SELECT d.doc_id AS seq, d.text AS title, l.quality AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def dataset(spark, d) -> DataFrame:
    doc, lab = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id", "quality")
    return doc.join(lab, "doc_id", "left").select(F.col("doc_id").alias("seq"), F.col("text").alias("title"), F.col("quality").alias("label"))


@P.query(f"WITH {DATA} SELECT seq, title AS claim, coalesce(label, 0)::INT AS label FROM data WHERE title IS NOT NULL")
def dataset_scan(spark, d):
    return dataset(spark, d).dropna(subset=["title"]).select("seq", F.col("title").alias("claim"), F.coalesce("label", F.lit(0)).cast("int").alias("label"))


@P.query(f"WITH {DATA} SELECT title AS claim, coalesce(label, 0)::INT AS label FROM data WHERE title IS NOT NULL")
def dataset_scan_csv(spark, d):
    """The labelled table written as CSV and read back, with line ends and quotes in its texts."""
    path = fresh(spark, "dataset-csv")
    csv_sink(dataset(spark, d).select("title", "label"), path)
    return csv_scan(spark, path)


@P.query(f"WITH {DATA} SELECT seq, CASE WHEN coalesce(label, 0) = 1 THEN 'True' ELSE 'False' END AS verdict FROM data")
def dataset_label(spark, d):
    return dataset(spark, d).select("seq", F.when(F.coalesce("label", F.lit(0)) == 1, "True").otherwise("False").alias("verdict"))


@P.query(f"WITH {DATA} SELECT title AS claim, min(seq) AS seq, arg_min(coalesce(label, 0), seq)::INT AS label FROM data WHERE title IS NOT NULL GROUP BY title")
def dataset_dedup(spark, d):
    return first_of(dataset_scan(spark, d), "claim", "seq")


@P.query("SELECT doc_id AS id FROM documents ORDER BY sha256(doc_id::VARCHAR || '#7'), doc_id LIMIT 15")
def reservoir_sample(spark, d):
    return hash_sample(table(spark, d, "documents").select(F.col("doc_id").alias("id")), "id", 15, 7)
