"""Versions, samples of distinct keys, answers, bars, and the as-of pick over ranges."""

import collections
import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from verisift.operators.answers import Field, Gone, asked, quarantine, structured
from verisift.operators.enrich import RateLimited
from verisift.operators.intervals import asof_within
from verisift.operators.sampling import bottom_k
from verisift.operators.versions import Conflict, Versions
from verisift.plans import content, market
from verisift.sources import datasets

T0 = dt.datetime(2024, 1, 1, 12)


def test_sample_of_distinct_keys(spark):
    """604 distinct claims, one of them 600 times: repeats take no place."""
    rows = [(f"c{k}", k % 3) for k in range(604)] + [("c7", 9 - k % 9) for k in range(600)]
    random.Random(1).shuffle(rows)
    got = bottom_k(spark.createDataFrame(rows, "claim string, label int").repartition(7), "claim", 500).collect()
    order = sorted({c for c, _ in rows}, key=lambda c: hashlib.sha256(f"{c}#0".encode()).hexdigest())
    assert {r.claim for r in got} == set(order[:500]) and len(got) == 500
    least = collections.defaultdict(lambda: 99)
    for c, label in rows:
        least[c] = min(least[c], label)
    assert all(r.label == least[r.claim] for r in got)


@pytest.mark.parametrize("k", [-1, 0, 1, 5, 99])
def test_sample_sizes(spark, k):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("c",)], "claim string")
    assert bottom_k(df, "claim", k).count() == max(0, min(k, 3))
    assert bottom_k(df.limit(0), "claim", k).count() == 0


def test_rotating_pool_keeps_its_size(spark, tmp_path):
    rows = [f"claim {k},1" for k in range(604)] + ["claim 3,0"] * 600
    (tmp_path / "set.csv").write_text("title,label\n" + "\n".join(rows))
    got = datasets.rotating_pool(spark, str(tmp_path), "set", 5)
    assert got.count() == 500 == got.select("claim").distinct().count()


def test_two_readers_while_a_version_is_made(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    old = v.fresh(lambda: {"t": spark.range(3)}, 0, 10)
    reader = v.read("t", old)
    assert v.fresh(lambda: pytest.fail("served until it expires"), 9, 10) == old
    new = v.fresh(lambda: {"t": spark.range(5)}, 10, 10)
    assert new.number == old.number + 1
    assert reader.count() == 3 and v.read("t", old).count() == 3 and v.read("t").count() == 5
    assert v.vacuum(1, 5) == 1 and v.read("t").count() == 5
    assert [c.number for c in [v.current()]] == [new.number]


def test_one_of_two_writers_wins(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    first = v.commit({"t": spark.range(1)}, 0)
    v.commit({"t": spark.range(2)}, 1, after=first)
    with pytest.raises(Conflict):
        v.commit({"t": spark.range(9)}, 1, after=first)
    assert v.read("t").count() == 2
    # A refresh that loses serves what the other has made.
    assert v.fresh(lambda: {"t": spark.range(9)}, 5, 1) == v.current()


def test_failure_between_two_tables_changes_nothing(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    claims = spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string")
    evidence = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "claim_id long, k int")
    of = v.commit({"claims": claims, "evidence": evidence}, 0)
    fails = evidence.withColumn("k", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        v.commit({"claims": claims.where("id = 2"), "evidence": fails}, 1)
    assert v.current() == of and v.read("claims").count() == 2 and v.read("evidence").count() == 3
    now = v.delete_cascade("claims", "id", spark.createDataFrame([(1,), (1,), (7,)], "id long"), {"evidence": "claim_id"}, 2)
    assert [tuple(r) for r in v.read("evidence", now).collect()] == [(2, 0)] and v.read("evidence", of).count() == 3
    assert v.orphans("claims", "id", {"evidence": "claim_id"}, now).first().n == 0
    assert v.vacuum(1, 9e9) >= 1 and v.read("evidence").count() == 1


def test_old_version_serves_where_building_fails(spark, tmp_path):
    v = Versions(spark, str(tmp_path))
    broken = lambda: {"t": spark.range(2).select(F.raise_error(F.lit("lost")).cast("int").alias("id"))}
    with pytest.raises(Exception, match="lost"):
        v.fresh(broken, 0, 1)
    old = v.commit({"t": spark.range(4)}, 0, 1)
    assert v.fresh(broken, 5, 1) == old


def test_repeated_rows_stay_apart(spark):
    later = spark.createDataFrame([(1, T0), (1, T0), (2, T0)], "c long, ct timestamp")
    earlier = spark.createDataFrame([(5, T0 - dt.timedelta(minutes=1)), (4, T0 - dt.timedelta(minutes=1)), (9, T0)], "n long, nt timestamp")
    got = sorted((r.c, r.n, r.k) for r in asof_within(later, earlier, "ct", "nt", "n", 30, "k").collect())
    assert got == [(1, 4, 2), (1, 4, 2), (2, 4, 2)]


def test_one_half_hour_with_everything(spark):
    """All events in a few minutes: ranges share them, and each begins with what came before it."""
    rnd = random.Random(2)
    at = lambda: T0 + dt.timedelta(microseconds=rnd.randrange(600_000_000))
    crashes, articles = [(k, at()) for k in range(300)], [(k, at()) for k in range(400)]
    got = asof_within(spark.createDataFrame(crashes, "c long, ct timestamp"), spark.createDataFrame(articles, "n long, nt timestamp"), "ct", "nt", "n", 2, "k")
    want = []
    for c, t in crashes:
        near = [(t - u, n) for n, u in articles if dt.timedelta(0) < t - u <= dt.timedelta(minutes=2)]
        if near:
            want.append((c, min(near)[1], len(near)))
    assert sorted((r.c, r.n, r.k) for r in got.collect()) == sorted(want)


def test_one_user_takes_turns(spark, tmp_path):
    rows = [(k, T0, 1, "view", 1.0, "{}") for k in range(50)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.id: r.key_index for r in content.round_robin(spark, str(tmp_path)).collect()}
    assert got == {k: k % 3 for k in range(50)}


def test_bars(spark):
    rows = [("a", T0 + dt.timedelta(seconds=s), float(c), s) for s, c in [(0, 5), (59, 7), (60, 3), (240, 9), (360, 1)]]
    made = market.bars(spark.createDataFrame(rows, "ticker string, ts timestamp, close double, seq long"))
    got = {g: sorted((b.b.open, b.b.high, b.b.low, b.b.close, b.b.n) for b in df.collect()) for g, df in made.items()}
    assert got[60] == [(1, 1, 1, 1, 1), (3, 3, 3, 3, 1), (5, 7, 5, 7, 2), (9, 9, 9, 9, 1)]
    assert got[300] == [(1, 1, 1, 1, 1), (5, 9, 3, 9, 4)] and got[86400] == [(5, 9, 1, 1, 5)]


def test_ticks_move_once(spark, sf):
    df = market.price_bars(spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange hash") == 2


class Some:
    def __init__(self, answers):
        self.answers = answers

    def ask(self, prompts):
        return [self.answers.get(p) for p in prompts]


class Failing:
    """Counts its calls in the worker that has it."""

    def __init__(self, error):
        self.error, self.calls = error, 0

    def ask(self, prompts):
        self.calls += 1
        raise self.error(f"call {self.calls}")


def test_scorers_in_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id long, p string").coalesce(1)
    chain = [Failing(Gone), Some({"a": "A"}), Failing(RateLimited), Failing(ConnectionError), Some({"b": "B", "a": "no"})]
    got = {r.id: (r.raw, r.scorer, r.tries, r.error) for r in asked(df, "id", "p", chain, wait=0.0).collect()}
    assert got[1] == ("A", 1, 2, "call 1")
    assert got[2] == ("B", 4, 7, "call 3")  # gone, none, limited once, lost three times, answered
    assert got[3] == (None, None, 7, "call 3") and got[4] == (None, None, 0, None)


def test_gone_is_remembered(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        got = asked(spark.range(6).select("id", F.lit("x").alias("p")).coalesce(1), "id", "p", [Failing(Gone), Failing(RateLimited)], wait=0.0).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.tries for r in sorted(got)] == [2, 2, 1, 1, 1, 1]


FIELDS = [Field("v", default="U", allowed=("T", "F")), Field("c", "double", 0.5, low=0.0, high=1.0), Field("l", "array<string>"), Field("o", default="none", required=False, most=3)]


@pytest.mark.parametrize(
    ("raw", "want", "reason"),
    [
        ('{"v":"T","c":0.25,"l":["x"],"o":"abc"}', ("T", 0.25, ["x"], "abc"), "ok"),
        ('```json\n{"v":"T","c":1,"l":[]}\n```', ("T", 1.0, [], "none"), "ok"),
        ('Sure: {"v":"F","c":0,"l":[]} bye', ("F", 0.0, [], "none"), "recovered"),
        ('{"v":"X","c":7,"l":"no","o":"abcdef"}', ("U", 1.0, [], "abc"), "repaired v,c,l,o"),
        ('{"v":"T","c":"high","l":[]}', ("T", 0.5, [], "none"), "repaired c"),
        ('{"v":"T","c":null,"l":[]}', ("U", 0.5, [], "none"), "missing c"),
        ('{"c":1,"l":[]}', ("U", 0.5, [], "none"), "missing v"),
        ("[1, 2]", ("U", 0.5, [], "none"), "not an object"),
        ("no", ("U", 0.5, [], "none"), "not json"),
        ("", ("U", 0.5, [], "none"), "not json"),
        (None, ("U", 0.5, [], "none"), "no answer"),
    ],
)
def test_answers_are_checked(spark, raw, want, reason):
    s = structured(spark.createDataFrame([(1, raw)], "id long, raw string"), "raw", FIELDS)
    r = s.first()
    assert ((r.v, r.c, r.l, r.o), r.reason) == (want, reason)
    assert quarantine(s).count() == (not r.accepted) == (reason.split()[0] in ("missing", "not", "no"))


def test_sheets_hold_any_text(spark):
    texts = ["a\r\nb", "c\x0bd", "_x000D_", "<&>\"'", "tab\there", "é日😀", " spaces "]
    df = spark.createDataFrame([(t, 1) for t in texts] + [("a\r\nb", 0), (None, 1), ("", 1)], "title string, label int").coalesce(1)
    assert sorted((r.claim, r.label) for r in datasets.xlsx_rows(datasets.xlsx_packed(df)).collect()) == sorted((t, 1) for t in texts)
    assert sorted((r.claim, r.label) for r in datasets.zip_rows(datasets.zip_packed(df)).collect()) == sorted([(t, 1) for t in texts] + [("a\r\nb", 0)])
    assert json.dumps(texts)
