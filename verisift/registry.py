"""Register of the engine's queries and their SQL."""

from __future__ import annotations

from verisift.plans import answers, claims, content, correlate, market, stored
from verisift.streaming import live
from verisift.streaming import queries as streams

PLANS = (claims.P, market.P, correlate.P, content.P, answers.P, stored.P, streams.P, live.P)


def queries() -> dict:
    return {k: f for p in PLANS for k, f in p.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in PLANS for k, s in p.sql.items()}
