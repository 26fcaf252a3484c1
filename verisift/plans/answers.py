"""Model answers over the tables: research, verdicts, risks, explanations and crisis responses through injected scorers.

The scorers here stand for models: what they say depends on the prompt alone, and for some prompts they fail, talk, cut their JSON short or leave out or
spoil a field, so that each branch of the checks has rows.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from verisift.operators.answers import Field, Gone, asked, quarantine, structured
from verisift.operators.enrich import RateLimited
from verisift.plans.base import Plan
from verisift.plans.content import MENTIONS, mentions
from verisift.plans.correlate import ARCHIVE, gated, guns
from verisift.sources.views import CLAIMS, claims, table

P = Plan()
RESEARCH = [Field("supporting_evidence", "array<string>"), Field("refuting_evidence", "array<string>"), Field("overall_evidence_confidence", "double", 0.5, low=0.0, high=1.0)]
VERDICT = [
    Field("verdict", default="Unverified", allowed=("True", "False", "Misleading", "Unverified")), Field("confidence", "double", 0.5, low=0.0, high=1.0),
    Field("severity", default="Medium", required=False, allowed=("Low", "Medium", "High", "Critical")),
]
RISK = [Field("risk_level", default="LOW", allowed=("LOW", "MEDIUM", "HIGH")), Field("threat_type", default="GENERAL")]
#: What stands for an explanation that failed.
UNAVAILABLE = "Short explanation unavailable."
EXPLANATION = [Field("explanation", default=UNAVAILABLE, most=1000), Field("evidence_url", default="", most=500)]
#: The most that a reply to the source and a short message to the leadership may have.
REPLY, MESSAGE = 280, 160
RESPONSES = [Field("cease_desist", most=REPLY), Field("official_denial"), Field("ceo_alert", most=MESSAGE)]


def spoilt(n: int, good: dict, leave: str) -> str | None:
    """How a stand-in answers: by the prompt's length n."""
    whole = json.dumps(good)
    if n % 11 == 0:
        return None
    if n % 7 == 0:
        return "I cannot help with that."
    if n % 5 == 0:
        return whole[:-3]
    if n % 3 == 0:
        return f"Here you go:\n{whole}\nHope it helps."
    if n % 13 == 0:
        return json.dumps({k: v for k, v in good.items() if k != leave})
    return f"```json\n{whole}\n```"


def reason_sql(n: str, leave: str, repaired: str = "NULL", cut: str = "not json") -> str:
    """Reason of a stand-in's answer as SQL; repaired: a text or null; cut: what JSON that ends early is (of one with lists a list can be read)."""
    return f"""CASE WHEN {n} % 11 = 0 THEN 'no answer' WHEN {n} % 7 = 0 THEN 'not json' WHEN {n} % 5 = 0 THEN '{cut}' WHEN {n} % 3 <> 0 AND {n} % 13 = 0 THEN 'missing {leave}'
 ELSE coalesce({repaired}, CASE WHEN {n} % 3 = 0 THEN 'recovered' ELSE 'ok' END) END"""


def accepted_sql(n: str) -> str:
    return f"({n} % 11 <> 0 AND {n} % 7 <> 0 AND {n} % 5 <> 0 AND ({n} % 3 = 0 OR {n} % 13 <> 0))"


class Research:
    def ask(self, prompts):
        made = [(n := len(p), {"supporting_evidence": ["s"] * (n % 4), "refuting_evidence": "none" if n % 17 == 0 else ["r"] * (n % 2), "overall_evidence_confidence": (n % 13) / 10}) for p in prompts]
        return [spoilt(n, good, "overall_evidence_confidence") for n, good in made]


@P.query(f"""SELECT id, CASE WHEN a THEN n % 4 ELSE 0 END::INT AS n_supporting, CASE WHEN a AND n % 17 <> 0 THEN n % 2 ELSE 0 END::INT AS n_refuting, CASE WHEN a THEN least(1.0::DOUBLE, (n % 13)::DOUBLE / 10) ELSE 0.5::DOUBLE END AS confidence,
 a AS accepted, {reason_sql("n", "overall_evidence_confidence", "'repaired ' || nullif(concat_ws(',', CASE WHEN n % 17 = 0 THEN 'refuting_evidence' END, CASE WHEN n % 13 > 10 THEN 'overall_evidence_confidence' END), '')", "not an object")} AS reason
 FROM (SELECT *, {accepted_sql("n")} AS a FROM (SELECT doc_id AS id, length(text) AS n FROM documents))""")
def research_fallback(spark, d):
    """Evidence for each claim; an answer that is none, broken or incomplete becomes no evidence and confidence 0.5."""
    c = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    s = structured(asked(c, "id", "text", [Research()]), "raw", RESEARCH)
    n = lambda k: F.size(f"{k}_evidence")
    return s.select("id", n("supporting").alias("n_supporting"), n("refuting").alias("n_refuting"), F.col("overall_evidence_confidence").alias("confidence"), "accepted", "reason")


class Judge:
    def ask(self, prompts):
        said = lambda n: {"verdict": ("True", "False", "Misleading", "maybe")[n % 4], "confidence": "high" if n % 19 == 0 else n % 12 / 10, "severity": ("Low", "High", "extreme")[n % 3 - 1]}
        return [spoilt(len(p), said(len(p)), "verdict") for p in prompts]


@P.query(f"""SELECT id, CASE WHEN a THEN ['True', 'False', 'Misleading', 'Unverified'][n % 4 + 1] ELSE 'Unverified' END AS verdict, CASE WHEN a AND n % 19 <> 0 THEN least(1.0::DOUBLE, (n % 12)::DOUBLE / 10) ELSE 0.5::DOUBLE END AS confidence,
 CASE WHEN a THEN CASE n % 3 WHEN 1 THEN 'Low' WHEN 2 THEN 'High' ELSE 'Medium' END ELSE 'Medium' END AS severity,
 {reason_sql("n", "verdict", "'repaired ' || nullif(concat_ws(',', CASE WHEN n % 4 = 3 THEN 'verdict' END, CASE WHEN n % 19 = 0 OR n % 12 > 10 THEN 'confidence' END, CASE WHEN n % 3 = 0 THEN 'severity' END), '')")} AS reason
 FROM (SELECT *, {accepted_sql("n")} AS a FROM (SELECT doc_id AS id, length(text) AS n FROM documents))""")
def verdict_fallback(spark, d):
    """Verdicts with their confidence clamped and their words checked; rejected answers are Unverified."""
    c = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return structured(asked(c, "id", "text", [Judge()]), "raw", VERDICT).select("id", "verdict", "confidence", "severity", "reason")


class Limited:
    """Answers every third prompt and is limited whenever it is asked for long ones alone."""

    def ask(self, prompts):
        return [json.dumps({"risk_level": "HIGH", "threat_type": "IMPERSONATION"}) if len(p) % 3 == 0 else None for p in prompts]


class Missing:
    def ask(self, prompts):
        raise Gone("no such model")


class Second:
    def ask(self, prompts):
        return [json.dumps({"risk_level": "MEDIUM" if len(p) % 3 == 1 else "severe", "threat_type": "RUMOUR"}) if len(p) % 4 else None for p in prompts]


class Refusing:
    def ask(self, prompts):
        raise RateLimited("too many calls")


@P.query(f"""WITH {MENTIONS}, n AS (SELECT id, length(content) AS n FROM m) SELECT id, CASE WHEN n % 3 = 0 THEN 'HIGH' WHEN n % 3 = 1 AND n % 4 <> 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 CASE WHEN n % 3 = 0 THEN 'IMPERSONATION' WHEN n % 4 <> 0 THEN 'RUMOUR' ELSE 'GENERAL' END AS threat_type, n % 3 = 0 OR n % 4 <> 0 AS analyzed,
 CASE WHEN n % 3 = 0 THEN 1 WHEN n % 4 <> 0 THEN 2 END::INT AS scorer, CASE WHEN n % 3 = 0 OR n % 3 = 1 AND n % 4 <> 0 THEN 'ok' WHEN n % 4 <> 0 THEN 'repaired risk_level' ELSE 'no answer' END AS reason FROM n""")
def risk_defaults(spark, d):
    """Risks of mentions by a chain of scorers: the first does not exist, the second knows some, the third more, the last one refuses; what nobody
    answers is LOW and GENERAL and not analysed."""
    m = mentions(spark, d).select("id", "content")
    a = asked(m, "id", "content", [Missing(), Limited(), Second(), Refusing()])
    s = structured(a, "raw", RISK)
    return s.select("id", "risk_level", "threat_type", F.col("accepted").alias("analyzed"), "scorer", "reason")


class Explainer:
    def ask(self, prompts):
        made = [(n := len(p), {"explanation": "because " * (n % 200), "evidence_url": n if n % 23 == 0 else f"https://source.example/{n}"}) for p in prompts]
        return [spoilt(n, good, "evidence_url") for n, good in made]


@P.query(f"""WITH {CLAIMS}, n AS (SELECT id, verdict, length(claim_text) + length(verdict) + 1 AS n FROM claims_v WHERE status = 'completed'), a AS (SELECT *, {accepted_sql("n")} AS a FROM n)
SELECT id, CASE WHEN a THEN substr(repeat('because ', (n % 200)::INT), 1, 1000) ELSE '{UNAVAILABLE}' END AS explanation, CASE WHEN a THEN CASE WHEN n % 23 = 0 THEN n::VARCHAR ELSE 'https://source.example/' || n END ELSE '' END AS evidence_url,
 {reason_sql("n", "evidence_url", "CASE WHEN n % 200 > 125 THEN 'repaired explanation' END")} AS reason FROM a""")
def claim_explanations(spark, d):
    """A short explanation and a source for each claim with a verdict."""
    c = claims(spark, d).where("status = 'completed'").select("id", F.concat_ws("\n", "claim_text", "verdict").alias("prompt"))
    return structured(asked(c, "id", "prompt", [Explainer()]), "raw", EXPLANATION).select("id", "explanation", "evidence_url", "reason")


@P.query(f"""SELECT id, reason FROM (SELECT doc_id AS id, length(text) AS n, {reason_sql("length(text)", "overall_evidence_confidence", cut="not an object")} AS reason FROM documents) WHERE NOT {accepted_sql("n")}""")
def answer_quarantine(spark, d):
    """Claims whose research was rejected, with the reason, for another try."""
    c = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return quarantine(structured(asked(c, "id", "text", [Research()]), "raw", RESEARCH)).select("id", "reason")


class Officer:
    def ask(self, prompts):
        return [spoilt(len(p) + int(p.rsplit("|", 1)[1]), {"cease_desist": f"Retract {p}. " * 20, "official_denial": f"{p} is untrue.", "ceo_alert": f"Alert: {p}"}, "ceo_alert") for p in prompts]


@P.query(f"""WITH {ARCHIVE.split("SELECT concat(ticker")[0]}, cq AS (SELECT crash_id, title || '|' || panic_score AS p, length(title || '|' || panic_score) + panic_score AS n FROM x), cr AS (SELECT *, {accepted_sql("n")} AS a FROM cq)
SELECT crash_id, CASE WHEN a THEN 'success' ELSE 'failed' END AS status, CASE WHEN a THEN substr(repeat('Retract ' || p || '. ', 20), 1, {REPLY}) END AS cease_desist, CASE WHEN a THEN p || ' is untrue.' END AS official_denial,
 CASE WHEN a THEN 'Alert: ' || p END AS ceo_alert, {reason_sql("n", "ceo_alert", "'repaired cease_desist'")} AS reason FROM cr""")
def crisis_responses(spark, d):
    """Three texts for each attack: a reply to the source, a statement, a message to the leadership."""
    told = guns(spark, d).select("crash_id", F.concat_ws("|", "title", F.col("panic_score").cast("string")).alias("prompt"))
    attacks = gated(spark, d).where("status = 'ATTACK'").select("crash_id").join(told, "crash_id")
    s = structured(asked(attacks, "crash_id", "prompt", [Officer()]), "raw", RESPONSES)
    return s.select("crash_id", F.when(F.col("accepted"), "success").otherwise("failed").alias("status"), "cease_desist", "official_denial", "ceo_alert", "reason")
