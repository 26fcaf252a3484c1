"""Structured answers of text models: ask one scorer after another, parse what comes back, check it field by field, repair or replace it, and say why.

Asking is Python, in batches, and each worker remembers which scorers are gone; everything after it are expressions.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verisift.functions.text import bracket_span, fence_strip
from verisift.operators.enrich import RateLimited

ASKED = "raw string, scorer int, tries int, error string"


class Gone(ConnectionError):
    """What a scorer raises where its model does not exist: it is not asked again by this worker."""


class TextScorer(Protocol):
    def ask(self, prompts: list[str]) -> list[str | None]:
        """An answer for each prompt, None where it has none."""


def asked(df: DataFrame, key: str, prompt: str, scorers: list[TextScorer], tries: int = 3, wait: float = 2.0) -> DataFrame:
    """key, raw (the answer or null), scorer (its place in the list, or null), tries (calls in which the row took part) and error (of the last failed
    call). Each row goes to the first scorer; rows without an answer go on to the next one. A rate limit passes the rows on, any other lost connection
    is tried again after wait seconds times the number of tries, and a scorer that is gone is left out from then on."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gone: set[int] = set()
        for b in batches:
            n = len(b)
            raw, by, calls, errors = [None] * n, [None] * n, [0] * n, [None] * n
            prompts = b["_prompt"].tolist()
            for s, scorer in enumerate(scorers):
                open_ = [i for i in range(n) if raw[i] is None and prompts[i] is not None]
                if s in gone or not open_:
                    continue
                for k in range(1, tries + 1):
                    for i in open_:
                        calls[i] += 1
                    try:
                        got = list(scorer.ask([prompts[i] for i in open_]))[: len(open_)]
                    except Gone as e:
                        gone.add(s)
                        failed, again = e, False
                    except ConnectionError as e:
                        failed, again = e, not isinstance(e, RateLimited)
                    else:
                        for i, text in zip(open_, got, strict=False):
                            if text is not None:
                                raw[i], by[i] = text, s
                        break
                    for i in open_:
                        errors[i] = str(failed) or type(failed).__name__
                    if not again:
                        break
                    if k < tries:
                        time.sleep(wait * k)
            yield pd.DataFrame({key: b[key], "raw": pd.array(raw, "object"), "scorer": pd.array(by, "Int32"), "tries": pd.array(calls, "int32"), "error": pd.array(errors, "object")})

    return df.select(key, F.col(prompt).alias("_prompt")).mapInPandas(run, f"`{key}` {kind}, {ASKED}")


@dataclass(frozen=True)
class Field:
    """A field of an answer: text, number or list. A number outside low and high is clamped, a text that is not allowed and a value of the wrong kind
    become the default; a missing field rejects the answer unless it is optional."""

    name: str
    kind: str = "string"
    default: object = None
    required: bool = True
    allowed: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    most: int | None = None

    def other(self) -> Column:
        if self.kind.startswith("array"):
            return F.array().cast(self.kind)
        return F.lit(self.default).cast(self.kind)


def structured(df: DataFrame, raw: str, fields: list[Field]) -> DataFrame:
    """df with a column for each field, accepted (boolean) and reason.

    reason says the first of: no answer, not json, not an object, missing <field>; then the answer is rejected and all fields have their defaults.
    Otherwise repaired <fields> (in order, joined by comma), recovered (JSON amid other text), or ok.
    """
    cleaned = fence_strip(F.col(raw))
    direct, within = F.try_parse_json(cleaned), F.try_parse_json(bracket_span(cleaned))
    v = F.col("_v")
    x = df.withColumn("_direct", direct.isNotNull()).withColumn("_v", F.coalesce(direct, within))
    path = lambda f: f"$.{f.name}"
    object_ = F.schema_of_variant(v).startswith("OBJECT")
    # A field that is there, whatever its kind; JSON's null counts as missing.
    here = {f.name: F.try_variant_get(v, path(f), "variant").isNotNull() & ~F.coalesce(F.is_variant_null(F.try_variant_get(v, path(f), "variant")), F.lit(False)) for f in fields}
    bad = F.when(F.col(raw).isNull(), "no answer").when(v.isNull(), "not json").when(~object_, "not an object")
    for f in fields:
        if f.required:
            bad = bad.when(~here[f.name], f"missing {f.name}")
    x = x.withColumn("_bad", bad)
    repaired, out = [], {}
    for f in fields:
        got = F.try_variant_get(v, path(f), f.kind)
        value, wrong = got, here[f.name] & got.isNull()
        if f.allowed:
            wrong = wrong | ~got.isin(*f.allowed)
            value = F.when(got.isin(*f.allowed), got)
        if f.low is not None:
            wrong = wrong | (got < f.low) | (got > f.high)
            value = F.greatest(F.lit(f.low), F.least(F.lit(f.high), got)).cast(f.kind)
            value = F.when(got.isNotNull(), value)
        if f.most is not None:
            wrong = wrong | (F.char_length(got) > f.most)
            value = F.substring(got, 1, f.most)
        out[f.name] = F.when(F.col("_bad").isNull(), F.coalesce(value, f.other())).otherwise(f.other())
        repaired.append(F.when(F.coalesce(wrong, F.lit(False)), f.name))
    mended = F.array_join(F.array_compact(F.array(*repaired)), ",")
    reason = F.coalesce("_bad", F.when(mended != "", F.concat(F.lit("repaired "), mended)), F.when(~F.col("_direct"), "recovered"), F.lit("ok"))
    return x.select(*df.columns, *[c.alias(n) for n, c in out.items()], F.col("_bad").isNull().alias("accepted"), reason.alias("reason"))


def quarantine(df: DataFrame) -> DataFrame:
    """The rows of structured() whose answer was rejected."""
    return df.where(~F.col("accepted"))
