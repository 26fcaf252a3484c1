"""Toxic passages by maximum-scoring segments.

Training counts in how many labelled texts of each class a token occurs, and scores it by the log-odds of the
two classes under a Dirichlet prior centred on all texts. Tokens are runs of
letters in lower case; beside the whole word, its beginnings are counted, and each beginning is the prior
of the next longer one, so rare words lean on their stems. Every token drifts, so that ordinary text has a
negative expectation. One linear scan then finds all maximal segments of a text, each a passage whose score no
extension or part beats. Each is judged by an extreme-value law: the location of the
maximum grows with the logarithm of the text's length. All segments whose tail probability is at most LEVEL are passages. A logistic curve over
the greatest segment's surprise (minus the logarithm of its tail probability), the passages' evidence (the sum of theirs) and the length,
fitted on labelled rows, gives the score. The law and the curve see each labelled text as the model would if that text had not been counted: its own
share is taken out of the counts, so that they hold for texts that the counts do not know.
A word counts once in a passage: its repeats only drift until the running sum of scores has fallen back to zero.

The model is of fixed size: features are hashed into 2**BITS slots, so it is broadcast whatever the vocabulary.
Counts cover all labelled training rows; only the curve is fitted on a bounded sample (CURVE_ROWS).

Edge cases: null and empty texts have no token and get the score of an empty segment; a text without
letters likewise; rows that share a doc_id are scored one by one; labels that are null or repeated: null ones are
left out, the greatest counts; a very long text is scanned whole, in a batch of its own if need be; other columns, whatever their names, are not
read; an empty table gives an empty result; without labels of both classes every
score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.llm.common import rows_without, small_batches, small_side, staged, table, text_keys
from verisift.llm.spans import prefix_sums, span_hashes
from verisift.llm.tokens import chunks

BITS = 20
#: Lengths of the beginnings that are counted beside the word.
STEMS = (3, 4, 5, 6, 7)
#: Pseudo-texts of the prior, least log-odds that count, and downward drift of every token.
PRIOR = 8.0
LEAST = 1.5
DRIFT = 0.1
#: Labelled rows that the curve is fitted on, about, chosen by hash of the doc_id.
CURVE_ROWS = 40_000
#: Greatest p-value of a passage: the chance that a clean text of that length has a segment as great.
LEVEL = 0.01
#: Surprise beyond which a segment says no more about its text.
MOST = 30.0
PASSAGE = "struct<start: bigint, end: bigint, score: double, p_value: double>"
SCORED = f"doc_id long, held_out boolean, k1 long, k2 long, toxic int, n_tokens long, n_segments long, best double, best_start long, best_end long, surprise double, evidence double, passages array<{PASSAGE}>"


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter or mark, and its lower case."""
    letter = np.zeros(0x110001, bool)
    lower = np.arange(0x110001, dtype=np.uint32)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))
        if c[0] in "LM":
            letter[cp] = True
            if c[1] in "ut" and len(low := chr(cp).lower()) == 1:
                lower[cp] = ord(low)
    return letter, lower


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words of the texts in order: slots (words x features), first text's word at each
    text, and where each word begins and ends in its text."""
    letter, lower = _letters()
    joined = " ".join([*texts, ""])
    cp = lower[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    edge = np.diff(np.concatenate([[False], letter[cp], [False]]).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = prefix_sums(cp, a)
    h = np.empty((len(a), 1 + len(STEMS)), np.uint64)
    h[:, 0] = span_hashes(sums, a, b)
    for k, n in enumerate(STEMS, 1):
        # A word as short as the stem has no beginning of its own. The stem's length turns upper bits, which make the slot,
        # so a whole word and the beginning of a longer one are told apart.
        stem = span_hashes(sums, a, np.minimum(a + n, b)) ^ np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))
        h[:, k] = np.where(b - a > n, stem, h[:, 0])
    bounds = np.concatenate([[0], np.searchsorted(a, ends)])
    begin = np.repeat(ends - [len(t) + 1 for t in texts], np.diff(bounds))
    return (h >> np.uint64(64 - BITS)).astype(np.int64), bounds, a - begin, b - begin


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training texts with their label."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out())
    known = staged(known, "toxicity-labels")
    return rows.join(small_side(known, 2_000_000), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")


def class_counts(rows: DataFrame) -> DataFrame:
    """(slot, toxic, clean): texts of each class in which a feature slot occurs; slot 2**BITS: all texts."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        both = np.zeros((2, (1 << BITS) + 1), np.int64)
        n = both[:, -1]  # the slot behind the last holds the number of texts
        for batch in chunks(batches):
            y = np.array(batch.column("toxic").to_pylist())
            slots, bounds, _, _ = features([t or "" for t in batch.column("text").to_pylist()])
            for k, i, j in zip((y > 0).tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                both[int(k)][np.unique(slots[i:j])] += 1
            n += np.bincount(y > 0, minlength=2)
        at = np.flatnonzero(both.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[1][at]), pa.array(both[0][at])], names=["slot", "toxic", "clean"])

    return rows.mapInArrow(count, "slot long, toxic long, clean long").groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def segments(score: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last + 1) in one linear scan.

    Runs of scores that are not positive only lower the running sum, so the scan visits
    positive scores alone. The stack holds candidate segments with the sum before each (low)
    and at its end (high); a new one merges with the nearest earlier one of a lesser low
    unless that one's high is not below its own.
    """
    total = np.concatenate([[0.0], np.cumsum(score)])
    out: list[list] = []  # low, high, first, end, place of the nearest earlier segment with a lesser low
    for i in np.flatnonzero(score > 0).tolist():
        low, high, first = total[i], total[i + 1], i
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][0] >= low:
                j = out[j][4]
            if j < 0 or out[j][1] >= high:
                out.append([low, high, first, i + 1, j])
                break
            low, first = out[j][0], out[j][2]
            del out[j:]
            j = len(out) - 1
    return [(float(h - lo), a, b) for lo, h, a, b, _ in out]


@dataclass
class Model:
    toxic: np.ndarray  # texts by slot, float32
    every: np.ndarray
    share: float
    location: tuple[float, float] = (0.0, 0.0)  # of the greatest segment of clean texts, by log length
    scale: float = 1.0
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def log_odds(self, slots: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Log-odds of words beyond those of all texts. The prior of all texts passes down from the shortest
        beginning to the whole word: each is the Dirichlet prior of the next longer one. own: for words of texts that were counted, whether their
        text is toxic; it is left out of the counts then, in each of which it stands once."""
        p = np.full(len(slots), self.share)
        toxic, one = (0.0, 0.0) if own is None else (own.astype(float), 1.0)
        for k in [*range(1, slots.shape[1]), 0]:
            s = slots[:, k]
            new = (self.toxic[s] - toxic + PRIOR * p) / (self.every[s] - one + PRIOR)
            p = new if k == 0 else np.where(s == slots[:, 0], p, new)
        return np.log(p / (1 - p)) - np.log(self.share / (1 - self.share))

    def words(self, slots: np.ndarray, text: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """Score of each word; a word that stood before in its passage only drifts. A passage ends with its text, or where
        the running sum of scores falls back to zero."""
        if not 0 < self.share < 1 or not len(slots):
            return np.full(len(slots), -DRIFT)
        out = self.log_odds(slots, own)
        out[out < LEAST] = 0.0
        toxic = np.flatnonzero(out > 0)
        again, seen, sum_, before, last_text = [], set(), 0.0, -1, -1
        for i, w, t, word in zip(toxic.tolist(), out[toxic].tolist(), text[toxic].tolist(), slots[toxic, 0].tolist(), strict=True):
            sum_ -= DRIFT * (i - before - 1)
            if t != last_text or sum_ <= 0:
                seen, sum_ = set(), 0.0
            if word in seen:
                again.append(i)
                sum_ -= DRIFT
            else:
                seen.add(word)
                sum_ += w - DRIFT
            before, last_text = i, t
        out[again] = 0.0
        return out - DRIFT

    def excess(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Standardised excess of the greatest segment over what a clean text of that length has."""
        a, b = self.location
        return (best - a - b * np.log(n + 1.0)) / self.scale

    def p_value(self, scores: np.ndarray, n: int) -> np.ndarray:
        """Gumbel's chance of a maximum as great in a clean text of n words; its mean is the location plus Euler's constant times the scale."""
        return -np.expm1(-np.exp(-np.clip(self.excess(scores, n) + np.euler_gamma, -20, 700)))


def scan(docs: DataFrame, model: Model, label: str | None = None) -> DataFrame:
    """Segments of every text, one row for each row of docs (doc_id, text). label: the column that docs were counted by; each text is then left out of the
    counts that it is scored by, and the label is passed on as toxic."""
    kept = ["doc_id", "held_out", "k1", "k2", "toxic"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB whatever the input

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = sent.value
        for batch in chunks(batches):
            slots, bounds, begin, end = features([t or "" for t in batch.column("text").to_pylist()])
            text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            own = np.array([(y or 0) > 0 for y in batch.column("toxic").to_pylist()], bool)[text] if label else None
            w = m.words(slots, text, own)
            rows = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                found = segments(w[a:b])
                top = max(found, default=(0.0, 0, 0))
                place = lambda x: (int(begin[a + x[1]]), int(end[a + x[2] - 1]))  # noqa: B023, E731
                p = m.p_value(np.array([x[0] for x in found]), b - a).tolist()
                likely = float(m.p_value(np.array([top[0]]), b - a)[0])
                passages = [dict(zip(("start", "end", "score", "p_value"), (*place(x), x[0], q), strict=True)) for x, q in zip(found, p, strict=True) if q <= LEVEL]
                rows.append((b - a, len(passages), top[0], *(place(top) if found else (0, 0)), -math.log(likely), -sum(math.log(x["p_value"]) for x in passages), passages))
            cols = list(zip(*rows, strict=True))
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), spans)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                names=[*kept, "n_tokens", "n_segments", "best", "best_start", "best_end", "surprise", "evidence", "passages"],
            )

    toxic = F.col(label) if label else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(F.coalesce("text", F.lit(""))), toxic.cast("int").alias("toxic"), "text")
    return rows.withColumn("held_out", F.coalesce(held_out(), F.lit(False))).select(*kept, "text").mapInArrow(run, SCORED)


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, float]:
    """A model from the labelled rows that are not held out; and the share of toxic labels."""
    small_batches(docs.sparkSession)
    rows = _labelled(docs, labels)
    counts = np.zeros((2, (1 << BITS) + 1))
    for r in class_counts(rows).toLocalIterator():  # at most 2**BITS + 1 rows
        counts[:, r["slot"]] = r["toxic"], r["clean"]
    texts = counts[:, -1]
    share = float(texts[0] / max(texts.sum(), 1))
    model = Model(counts[0, :-1].astype(np.float32), counts[:, :-1].sum(0).astype(np.float32), share)
    if not 0 < share < 1:
        return model, share
    part = int(1_000_000 * min(1.0, CURVE_ROWS / texts.sum()))  # by hash, so that no task sorts or gathers texts
    # Rows that share id and text count once, so that no repeated row can swell the sample.
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1_000_000)) < part).dropDuplicates(["doc_id", "text"])
    y = staged(some.select("doc_id", "text", "toxic"), "toxicity-curve")
    seen = _scanned(y, model)
    if not 0 < (seen["toxic"] > 0).mean() < 1:
        return model, share
    n, best, is_toxic = seen["n_tokens"].to_numpy(float), seen["best"].to_numpy(float), seen["toxic"].to_numpy() > 0
    clean = ~is_toxic
    b, a = np.polyfit(np.log(n[clean] + 1), best[clean], 1) if clean.sum() > 2 else (0.0, 0.0)
    model.location = (float(a), float(b))
    # Gumbel: the standard deviation is scale * pi / sqrt(6).
    model.scale = float(max(np.std(best[clean] - a - b * np.log(n[clean] + 1)) * np.sqrt(6) / np.pi, 0.1))
    # Tail probabilities need the law: the sample is scanned once more with it.
    seen = _scanned(y, model)
    n, best, is_toxic = seen["n_tokens"].to_numpy(float), seen["best"].to_numpy(float), seen["toxic"].to_numpy() > 0
    x = np.stack([np.minimum(seen["surprise"].to_numpy(float), MOST), np.log1p(seen["evidence"].to_numpy(float)), np.log1p(n)], 1)
    model.curve = _logistic(x, is_toxic)
    return model, share


def _scanned(y: DataFrame, model: Model):
    return scan(y, model, "toxic").select("n_tokens", "best", "surprise", "evidence", "toxic").toPandas()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Intercept and slopes by Newton's method, with Platt's smoothed targets."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    c, keep = np.zeros(x.shape[1]), ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * w[:, None]).T @ x + keep + 1e-9 * np.eye(len(c)), x.T @ (p - t) + keep @ c)
        c = c - step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, c))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, the best segment and all passages (code points) of every row of docs."""
    model, share = train(docs, labels)
    if not 0 < share < 1:
        out = scan(docs, model).withColumn("score", F.lit(share))
    else:
        a, b, c, e = model.curve
        z = F.lit(a) + F.lit(b) * F.least(F.lit(MOST), F.col("surprise")) + F.lit(c) * F.log1p("evidence") + F.lit(e) * F.log1p(F.col("n_tokens").cast("double"))
        out = scan(docs, model).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z)))))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", "n_segments", "best", "best_start", "best_end", "passages", "k1", "k2")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text is not predicted toxic. A score follows from the text, so rows that share an id, or have none, are judged one by one."""
    bad = staged(scored(docs, labels).where("predicted = 1").select("k1", "k2").distinct(), "toxicity-rejected")
    return rows_without(docs, bad)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("k1", "k2")
