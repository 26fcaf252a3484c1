"""Row enrichment by an injected scorer, in batches that keep their order."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Scorer(Protocol):
    #: Columns that the scorer adds, as a schema string.
    schema: str

    def score(self, texts: list[str]) -> list[tuple]: ...


class RateLimited(ConnectionError):
    """What a scorer raises where its service asks for fewer calls."""


class NeutralSentiment:
    """What an engine without a model says."""

    schema = "sentiment_score int, is_threat boolean, summary string"

    def score(self, texts: list[str]) -> list[tuple]:
        return [(0, False, "Analysis skipped (no key)")] * len(texts)


def enrich(df: DataFrame, scorer: Scorer, key: str = "seq", text: str = "text", tries: int = 3, pad: tuple = (0, False, "Incomplete analysis"), wait: float = 2.0) -> DataFrame:
    """key and the scorer's columns for each row. A batch that fails is tried again, after wait seconds times the number of tries so far, and twice that
    where the scorer was asked for fewer calls; answers are padded or cut to its length."""
    names = [c.split()[0] for c in scorer.schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for k in range(1, tries + 1):
                try:
                    rows = scorer.score(b[text].tolist())
                    break
                except ConnectionError as failed:
                    if k < tries:
                        time.sleep(wait * k * (2 if isinstance(failed, RateLimited) else 1))
            rows = (list(rows) + [pad] * len(b))[: len(b)]
            out = pd.DataFrame(rows, columns=names, index=b.index)
            out.insert(0, key, b[key])
            yield out

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, {scorer.schema}")
