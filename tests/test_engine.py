"""Boundaries, properties and streams against their batch twins."""

import datetime as dt
import random
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from verisift.functions import text
from verisift.operators.enrich import NeutralSentiment, RateLimited, enrich
from verisift.operators.intervals import asof_within, interval_join
from verisift.operators.merge import merge_update
from verisift.operators.numbering import numbered
from verisift.operators.sampling import hash_sample
from verisift.plans import claims, content, correlate, market
from verisift.sources import datasets
from verisift.streaming import live
from verisift.streaming import queries as streams

T0 = dt.datetime(2024, 1, 1, 12)


def test_entry_expected_counts(spark, sf):
    rows = correlate.correlation_confidence(spark, sf).collect()
    assert len(rows) == 93
    assert sum(r.total_candidates for r in rows) == 120


def test_expected_statuses(spark):
    got = {r.volatility_status: r["count"] for r in market.volatility_status(spark, "/root/testdata/sf0.01").groupBy("volatility_status").count().collect()}
    assert got == {"HIGH_VOLATILITY": 9, "SIGMA_EVENT": 8, "STABLE": 133}


@pytest.mark.parametrize(("z", "want"), [(-2.0, "HIGH_VOLATILITY"), (-2.0001, "SIGMA_EVENT"), (-1.0, "STABLE"), (2.0, "STABLE"), (2.0001, "RALLY")])
def test_status_bounds(spark, z, want):
    assert spark.range(1).select(market.status(F.lit(z)).alias("s")).first().s == want


def test_demo_ticker():
    assert round((1250.00 - 1300.00) / 17.86, 1) == -2.8


def test_zero_deviation(spark):
    df = spark.createDataFrame([("a", T0, 5.0, 1), ("a", T0, 5.0, 2)], "ticker string, ts timestamp, close double, seq long")
    assert market.stats(df).first().z == 0


def test_interval_bounds(spark):
    us = lambda n: T0 - dt.timedelta(microseconds=n)
    later = spark.createDataFrame([(1, T0)], "c long, ct timestamp")
    lags = [0, 1, 30 * 60_000_000, 30 * 60_000_000 + 1, -5]
    earlier = spark.createDataFrame([(i, us(n)) for i, n in enumerate(lags)], "n long, nt timestamp")
    got = interval_join(later, earlier, "ct", "nt", 30)
    assert sorted(r.n for r in got.collect()) == [1, 2]
    assert interval_join(later.limit(0), earlier, "ct", "nt", 30).count() == 0


def test_interval_join_is_an_equi_join(spark, sf):
    plan = correlate.causal_candidates(spark, sf)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_interval_pairs_over_several_blocks(spark):
    r = random.Random(5)
    lt, et = [r.randrange(0, 5400) for _ in range(300)], [r.randrange(0, 5400) for _ in range(1200)]
    frame = lambda ts, a, b: spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s)) for i, s in enumerate(ts)], f"{a} long, {b} timestamp")
    got = interval_join(frame(lt, "c", "ct"), frame(et, "n", "nt"), "ct", "nt", 30)
    want = {(i, k): (a - b) * 1_000_000 for i, a in enumerate(lt) for k, b in enumerate(et) if 0 < a - b <= 1800}
    rows = got.collect()
    assert len(rows) == len(want) and {(x.c, x.n): x.latency_us for x in rows} == want


def test_interval_pairs_of_copies_stay_small(spark, tmp_path):
    """Copies at equal times, which come mixed: the pairs stand in the order of time, so their file has a fraction of a byte for each."""
    r = random.Random(8)
    frame = lambda n, a, b: spark.range(n * 50).select(F.col("id").alias(a), (F.lit(T0) + F.make_dt_interval(secs=F.pmod(F.xxhash64(F.col("id") % n), F.lit(1800)))).alias(b)).orderBy(F.rand(r.randrange(99)))
    got = interval_join(frame(10, "c", "ct"), frame(40, "n", "nt"), "ct", "nt", 30).select("c", "n", "latency_us")
    got.write.parquet(str(tmp_path / "pairs"))
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    n = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert n > 100_000 and size < 0.6 * n


def test_normalize(spark):
    rows = spark.createDataFrame([("\t A b  \n",), ("",), (None,)], "t string")
    assert [r.n for r in rows.select(text.normalize("t").alias("n")).collect()] == ["a b", "", None]


def test_anti_and_semi_are_all(spark, sf):
    pending = claims.claims(spark, sf).where("status = 'pending'").count()
    assert claims.claim_new_anti(spark, sf).count() + claims.claim_dup_semi(spark, sf).count() == pending


def test_bucket(spark):
    rows = [("TRUE", "True"), ("1", "True"), ("mixed", "Misleading"), ("Unverified", "False"), (None, "False"), ("", "False")]
    df = spark.createDataFrame(rows, "v string, want string").withColumn("got", claims.bucket(F.col("v")))
    assert df.where("got <> want").count() == 0


def test_merge(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, s string, v string")
    u = spark.createDataFrame([(2, "z", None), (9, "q", "q")], "id long, s string, v string")
    assert sorted(merge_update(t, u, "id", ["s", "v"]).collect()) == [(1, "a", "x"), (2, "z", "y")]


@pytest.mark.parametrize("n", [-1, 0, 3, 99])
def test_sample_size(spark, n):
    df = spark.range(20)
    got = hash_sample(df, "id", n)
    assert got.count() == max(0, min(n, 20)) and got.distinct().count() == got.count()


def test_fences(spark):
    rows = [('```json\n{"a":1}\n```', '{"a":1}'), ('{"a":1}', '{"a":1}'), ('```JSON {"a":1}', '{"a":1}')]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.where(text.fence_strip("t") != F.col("want")).count() == 0
    assert spark.createDataFrame([("so: [1, {2}] ok",)], "t string").select(text.bracket_span("t")).first()[0] == "[1, {2}]"


@pytest.mark.parametrize(("answers", "padded"), [(None, 0), (4, 1), (9, 0), (-1, 5)])
def test_enrich_pads(spark, answers, padded):
    class Some(NeutralSentiment):  # local, so that workers get it by value
        def score(self, texts):
            if answers == -1:
                raise ConnectionError
            rows = super().score(texts)
            return rows if answers is None else (rows * 2)[:answers]

    df = spark.range(5).select(F.col("id").alias("seq"), F.lit("x").alias("text")).coalesce(1)
    got = enrich(df, Some())
    assert got.count() == 5 and got.where("summary = 'Incomplete analysis'").count() == padded


@pytest.mark.parametrize(("limited", "least"), [(False, 0.6), (True, 1.2)])
def test_enrich_waits(spark, limited, least):
    class Late(NeutralSentiment):  # fails twice in each worker, then answers
        calls = 0

        def score(self, texts):
            self.calls += 1
            if self.calls < 3:
                raise (RateLimited if limited else ConnectionError)
            return super().score(texts)

    df = spark.range(5).select(F.col("id").alias("seq"), F.lit("x").alias("text")).coalesce(1)
    start = time.time()
    assert enrich(df, Late(), wait=0.2).where("summary = 'Incomplete analysis'").count() == 0
    assert time.time() - start >= least


def test_stream_twins(spark, sf):
    pairs = lambda df: sorted((r.crash_id, r.news_id) for r in df.collect())
    assert pairs(streams.s_correlate(spark, sf)) == pairs(correlate.causal_candidates(spark, sf))
    hashes = lambda df: sorted(r.claim_hash for r in df.collect())
    assert hashes(streams.s_claim_dedup(spark, sf)) == hashes(claims.claim_batch_dedup(spark, sf))
    state = lambda df: sorted((r.claim_id, r.n_changes) for r in df.collect())
    assert state(streams.s_claim_state(spark, sf)) == state(claims.claim_latest_state(spark, sf))
    assert sorted(map(str, streams.s_warroom(spark, sf).collect())) == sorted(map(str, correlate.threat_archive(spark, sf).collect()))
    items = content.rss_parse(spark, sf).select(text.claim_hash("title").alias("claim_hash")).distinct()
    assert hashes(live.s_rss_ingest(spark, sf)) == hashes(items)
    batch = streams.surveyed(spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), None)
    assert sorted(map(str, streams.s_surveillance(spark, sf).collect())) == sorted(map(str, batch.collect()))
    latest = {r.claim_id: streams.STEPS[r.state] for r in claims.claim_latest_state(spark, sf).collect()}
    assert {r.claim_id: r.state for r in streams.s_claim_state(spark, sf).collect()} == latest


def test_correlation_over_shuffled_files(spark, sf, tmp_path):
    d = str(tmp_path)
    spark.read.parquet(f"{sf}/events.parquet").repartition(20, "event_id").write.parquet(f"{d}/events.parquet")
    want = sorted((r.crash_id, r.news_id) for r in correlate.causal_candidates(spark, d).collect())
    assert len(want) == 120 and sorted((r.crash_id, r.news_id) for r in streams.s_correlate(spark, d).collect()) == want
    assert sorted(map(str, streams.s_warroom(spark, d).collect())) == sorted(map(str, correlate.threat_archive(spark, d).collect()))


def test_asof_against_all_pairs(spark):
    r = random.Random(3)
    at = lambda n: T0 + dt.timedelta(minutes=n)
    later = spark.createDataFrame([(i, at(r.randrange(0, 200) * 5)) for i in range(60)], "c long, ct timestamp")
    earlier = spark.createDataFrame([(i, at(r.randrange(0, 200) * 5)) for i in range(90)], "n long, nt timestamp")
    pairs = interval_join(later, earlier, "ct", "nt", 30).groupBy("c").agg(F.min(F.struct("latency_us", "n")).alias("m"), F.count(F.lit(1)).alias("k"))
    got = asof_within(later, earlier, "ct", "nt", "n", 30, "k")
    assert sorted((x.c, x.n, x.latency_us, x.k) for x in got.collect()) == sorted((x.c, x.m.n, x.m.latency_us, x.k) for x in pairs.collect())
    assert asof_within(later, earlier.limit(0), "ct", "nt", "n", 30, "k").count() == 0


def test_crash_plans_build_no_pairs(spark, sf):
    plan = correlate.smoking_gun(spark, sf)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Window" in plan


def test_numbers_within_large_groups(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 2, None).otherwise(F.lit("x")).alias("s"), "id")
    got = numbered(df, ["s"], ["id"], "k").collect()
    for s in ("x", None):
        rows = sorted((r.id, r.k) for r in got if r.s == s)
        assert [k for _, k in rows] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize(("bad", "good"), text.MOJIBAKE)
def test_each_wrong_sequence(spark, bad, good):
    assert spark.createDataFrame([(f"a{bad}b",)], "t string").select(text.mojibake_fix("t")).first()[0] == f"a{good}b"


CSV = 'id,title,label\n1,"A, ""quoted""\ntitle",1\n2,,1\n3,Surplus,1,2,3\n4,No label\n5,Word,x\n6,Seven,0.0\n'
ROWS = [('A, "quoted"\ntitle', 1), ("No label", 0), ("Seven", 0), ("Word", 0)]


def workbook(rows):
    cell = lambda c, i, v: f'<c r="{c}{i}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{c}{i}" t="inlineStr"><is><t>{v}</t></is></c>'
    body = "".join(f'<row r="{i}">{"".join(cell(c, i, v) for c, v in zip("ABC", r, strict=True) if v is not None)}</row>' for i, r in enumerate(rows, 1))
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'


def test_dataset_files(spark, tmp_path):
    rows = lambda df: sorted((r.claim, r.label) for r in df.collect())
    d = str(tmp_path)
    (tmp_path / "set.csv").write_text(CSV)
    assert rows(datasets.load_dataset(spark, d, "set")) == ROWS
    with zipfile.ZipFile(tmp_path / "set.zip", "w") as z:
        z.writestr("read.me", "x")
        z.writestr("a/First.CSV", CSV)
        z.writestr("second.csv", "title,label\nno,1\n")
    assert rows(datasets.load_dataset(spark, d, "set")) == ROWS == rows(datasets.rotating_pool(spark, d, "set", 3))
    with zipfile.ZipFile(tmp_path / "set.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", workbook([("title", "id", "label"), ("One", 1, 1), ("Two", 2, None), ("One", 3, 0), (None, 4, 1)]))
    assert rows(datasets.load_dataset(spark, d, "set")) == [("One", 1), ("Two", 0)]
    made = datasets.ensure_min_csv(spark, d, "set")
    assert made.endswith("set.min.csv") and rows(datasets.csv_scan(spark, made)) == [("One", 1), ("Two", 0)]
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("read.me", "x")
    assert datasets.zip_scan(spark, f"{d}/none.zip").count() == 0
    (tmp_path / "seed.json").write_text('[{"claim": "a"}, {"claim": "b", "verdict": "True"}]')
    assert datasets.json_seeds(spark, f"{d}/seed.json").count() == 2


def test_any_text_survives_the_csv(spark, tmp_path):
    r, signs = random.Random(2), ['"', "\\", "\n", "\r", ",", " ", "a", "#", "\0", "\ufeff", "\x85", "\u2028", "\U0001f600", "\t"]
    texts = ["", " ", '"', '""', "\\", "\0", '"\0', "\n", "\r\n", "null", "NULL", ",", "#", "x" * 70_000, None] + ["".join(r.choices(signs, k=r.randrange(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t, i % 2 if i % 3 else None) for i, t in enumerate(texts)], "title string, label long")
    datasets.csv_sink(df, f"{tmp_path}/set")
    want = sorted((t, i % 2 if i % 3 else 0) for i, t in enumerate(texts) if t is not None)
    assert sorted((x.claim, x.label) for x in datasets.csv_scan(spark, f"{tmp_path}/set").collect()) == want


def test_dataset_scan_csv_keeps_empty_texts(spark, tmp_path):
    docs = [(1, ""), (2, None), (3, "a\r\nb"), (4, ""), (5, "nul\0")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (5, 0)], "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    got = claims.dataset_scan_csv(spark, str(tmp_path)).collect()
    assert sorted((x.claim, x.label) for x in got) == [("", 0), ("", 1), ("a\r\nb", 0), ("nul\0", 0)]


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
