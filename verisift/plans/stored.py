"""Queries over what the engine has written itself: dataset files in each format, snapshots that expire, and tables that change together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verisift.operators.sampling import hash_sample, order_hash
from verisift.operators.staging import fresh
from verisift.operators.versions import Versions
from verisift.plans.base import Plan
from verisift.plans.claims import DATA, dataset
from verisift.sources import datasets
from verisift.sources.views import CLAIMS, EVIDENCE, claims, evidence, table

P = Plan()
#: Seconds that a dashboard's sample is served, and claims of it.
TTL, SHOWN = 300, 15
_CLAIM = "SELECT title AS claim, coalesce(label, 0)::INT AS label FROM data WHERE title <> ''"


@P.query(f"WITH {DATA} {_CLAIM}")
def dataset_scan_zip(spark, d):
    """The labelled table as CSV files in ZIP archives, read back."""
    return datasets.zip_rows(datasets.zip_packed(dataset(spark, d).select("title", "label")))


@P.query(f"WITH {DATA} SELECT title AS claim, coalesce(arg_min(coalesce(label, 0), seq), 0)::INT AS label FROM data WHERE title <> '' GROUP BY title")
def dataset_scan_xlsx(spark, d):
    """The labelled table as workbooks in the order of its rows, read back; each title with its first label."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = dataset(spark, d).repartitionByRange(n, "seq").sortWithinPartitions("seq")
    return datasets.xlsx_rows(datasets.xlsx_packed(rows.select("title", "label")))


@P.query(f"WITH {DATA} {_CLAIM} AND label IS NOT NULL")
def dataset_source_order(spark, d):
    """Of a large CSV and a small one beside it the small one is read: here the rows with a label."""
    folder = fresh(spark, "sources")
    rows = dataset(spark, d).select("title", "label")
    datasets.csv_sink(rows, f"{folder}/set.csv")
    datasets.csv_sink(rows.where("label IS NOT NULL"), f"{folder}/set.min.csv")
    return datasets.load_dataset(spark, folder, "set").where("claim <> ''")


@P.query(f"""WITH {DATA}, u AS (SELECT title AS claim, coalesce(label, 0)::INT AS label FROM data WHERE title IS NOT NULL UNION ALL SELECT title, 7 FROM data, range(20) WHERE seq % 50 = 0)
SELECT claim, min(label) AS label FROM u GROUP BY claim ORDER BY sha256(claim || '#0') LIMIT 500""")
def rotating_pool(spark, d):
    """The pool for 15 claims, from a file in which every fiftieth row comes twenty times more."""
    folder = fresh(spark, "pool")
    rows = dataset(spark, d).where("title IS NOT NULL")
    more = rows.where("seq % 50 = 0").select("title", F.lit(7).alias("label"), F.explode(F.sequence(F.lit(1), F.lit(20)))).select("title", "label")
    datasets.csv_sink(rows.select("title", F.col("label").cast("int").alias("label")).unionByName(more), f"{folder}/set.csv")
    return datasets.rotating_pool(spark, folder, "set", SHOWN)


@P.query(f"""WITH {CLAIMS}, s AS (SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY sha256(id::VARCHAR || '#' || seed), id) AS k FROM claims_v, (VALUES (1), (2)) v(seed) WHERE status = 'pending')
SELECT seen_at, id FROM s, (VALUES (0, 1), (299, 1), (300, 2), (599, 2)) t(seen_at, of) WHERE of = seed AND k <= {SHOWN}""")
def dashboard_snapshot(spark, d):
    """The dashboard's sample as readers see it at four times: it is drawn once, served until it expires, then drawn anew."""
    kept, seen = Versions(spark, fresh(spark, "dashboard")), []
    pending = claims(spark, d).where("status = 'pending'").select("id")
    for at in (0, TTL - 1, TTL, 2 * TTL - 1):
        now = kept.fresh(lambda: {"sample": hash_sample(pending, "id", SHOWN, (kept.current().number if kept.current() else 0) + 1)}, at, TTL)
        seen.append(kept.read("sample", now).select(F.lit(at).alias("seen_at"), "id"))
    out = seen[0]
    for s in seen[1:]:
        out = out.unionByName(s)
    return out


def _linked(spark, d) -> dict[str, DataFrame]:
    e = evidence(spark, d)
    c = claims(spark, d).select("id", "status")
    return {"claims": c, "evidence": e.join(c, F.col("claim_id") == F.col("id"), "left_semi").select("claim_id", "ordinal", "stance")}


@P.query(f"""WITH {CLAIMS}, {EVIDENCE}, c AS (SELECT id, status FROM claims_v WHERE id % 3 <> 0) SELECT 'claim' AS kind, id, status AS what, count(*) AS n FROM c GROUP BY ALL
UNION ALL SELECT 'evidence', claim_id, stance, count(*) FROM evidence_v WHERE claim_id IN (SELECT id FROM c) GROUP BY ALL UNION ALL SELECT 'orphan', 0, 'evidence', 0""")
def claim_cascade_delete(spark, d):
    """Every third claim is deleted and its evidence with it, in one version of both tables; no evidence is left without its claim."""
    v = Versions(spark, fresh(spark, "linked"))
    v.commit(_linked(spark, d), 0)
    gone = v.read("claims").where("id % 3 = 0").select("id")
    now = v.delete_cascade("claims", "id", gone, {"evidence": "claim_id"}, 1)
    one = lambda name, kind, key, what: v.read(name, now).groupBy(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(what).alias("what")).agg(F.count(F.lit(1)).alias("n"))
    orphans = v.orphans("claims", "id", {"evidence": "claim_id"}, now).select(F.lit("orphan").alias("kind"), F.lit(0).cast("long").alias("id"), F.col("child").alias("what"), "n")
    return one("claims", "claim", "id", "status").unionByName(one("evidence", "evidence", "claim_id", "stance")).unionByName(orphans)


@P.query(f"""WITH {CLAIMS}, s AS (SELECT claim_text, row_number() OVER (ORDER BY sha256(id::VARCHAR || '#1'), id) AS k FROM claims_v WHERE status = 'pending' QUALIFY k <= {SHOWN})
SELECT count(*) AS n, coalesce(min(claim_text) FILTER (WHERE k = 1), '') AS first_claim, sha1(coalesce(string_agg(claim_text, chr(10) ORDER BY k), '')) AS checksum, coalesce(string_agg(claim_text, chr(10) ORDER BY k) FILTER (WHERE k <= 3), '') AS preview FROM s""")
def dashboard_debug(spark, d):
    """What the served sample holds: its size, first claim, the checksum of its claims in order, and the first three."""
    kept = Versions(spark, fresh(spark, "dashboard"))
    pending = claims(spark, d).where("status = 'pending'").select("id", "claim_text")
    now = kept.fresh(lambda: {"sample": hash_sample(pending, "id", SHOWN, 1)}, 0, TTL)
    # A sample's rows, SHOWN at most, in the order in which they were drawn.
    rows = kept.read("sample", now).agg(F.array_sort(F.collect_list(F.struct(order_hash("id", 1).alias("h"), "id", "claim_text"))).alias("r"))
    text = F.transform("r", lambda x: x["claim_text"])
    joined = F.array_join(text, "\n")
    return rows.select(F.size("r").cast("long").alias("n"), F.coalesce(F.get(text, F.lit(0)), F.lit("")).alias("first_claim"), F.sha1(joined).alias("checksum"), F.array_join(F.slice(text, 1, 3), "\n").alias("preview"))


@P.query("""SELECT c_custkey AS asset_id, c_name AS name, count(o_orderkey) AS n_reports, max(o_orderdate) AS last_scan, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_report
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL UNION ALL SELECT NULL, 'orphans', count(*), NULL, NULL FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def asset_reports(spark, d):
    """Each asset (a customer) with its reports (orders): how many, the latest and when; assets without any stay, and reports without an asset are counted."""
    v = Versions(spark, fresh(spark, "assets"))
    assets = table(spark, d, "customer").select(F.col("c_custkey").alias("asset_id"), F.col("c_name").alias("name"))
    reports = table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_custkey").alias("asset"), F.col("o_orderdate").alias("at"))
    of = v.commit({"assets": assets, "reports": reports}, 0)
    g = v.read("reports", of).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("at", "report_id")).alias("last"))
    told = v.read("assets", of).join(g, F.col("asset_id") == F.col("asset"), "left")
    rows = told.select("asset_id", "name", F.coalesce("n", F.lit(0).cast("long")).alias("n_reports"), F.col("last.at").alias("last_scan"), F.col("last.report_id").alias("last_report"))
    lost = v.orphans("assets", "asset_id", {"reports": "asset"}, of)
    none = lambda kind: F.lit(None).cast(kind)
    return rows.unionByName(lost.select(none("long").alias("asset_id"), F.lit("orphans").alias("name"), F.col("n").alias("n_reports"), none("timestamp_ntz").alias("last_scan"), none("long").alias("last_report")))
