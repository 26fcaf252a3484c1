"""Whole queries without SQL against versions of their own: toxicity, packing and token output."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.helpers import docs
from tests.llm.test_models import all_segments
from verisift.llm import packing, token_output, toxicity
from verisift.llm.tokens import TokenIds, default_tokenizer


def beginnings(word):
    """Shortest first, the whole word last."""
    return [("stem", n, word[:n]) for n in toxicity.STEMS if len(word) > n] + [("word", word)]


def fitted(x, y):
    """Ridge logistic curve by Newton's method on smoothed targets."""
    x = np.column_stack([np.ones(len(x)), x])
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    c, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ c)))
        c = c - np.linalg.solve(x.T @ np.diag(p * (1 - p)) @ x + ridge, x.T @ (p - t) + ridge @ c)
    return c


def brute_toxicity(rows, labels):
    """(score, segments that are significant, greatest segment) of each (doc_id, text) row."""
    words = [re.findall(r"[a-z]+", (t or "").lower()) for _, t in rows]
    out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows]
    known = [labels.get(i) if i is not None and not o else None for (i, _), o in zip(rows, out, strict=True)]
    train = [k for k, y in enumerate(known) if y is not None]
    share = sum(known[k] > 0 for k in train) / len(train)
    toxic, every = {}, {}
    for k in train:
        for f in {f for w in words[k] for f in beginnings(w)}:
            every[f] = every.get(f, 0) + 1
            toxic[f] = toxic.get(f, 0) + (known[k] > 0)

    def log_odds(word, own):
        p = share
        for f in beginnings(word):
            # own: the label of a text that does not count for itself
            p = (toxic.get(f, 0) - (own or 0) + toxicity.PRIOR * p) / (every.get(f, 0) - (own is not None) + toxicity.PRIOR)
        return math.log(p / (1 - p)) - math.log(share / (1 - share))

    def scanned(ws, own=None):
        scores, seen, total = [], set(), 0.0
        for w in ws:
            v = log_odds(w, own)
            if v >= toxicity.LEAST:
                if total <= 0:
                    seen, total = set(), 0.0
                v = 0.0 if w in seen else v
                seen.add(w)
            else:
                v = 0.0
            scores.append(v - toxicity.DRIFT)
            total += v - toxicity.DRIFT
        return all_segments(scores)

    n = np.array([len(w) for w in words], float)
    greatest = lambda found: np.array([max((v for v, _, _ in s), default=0.0) for s in found])
    # The law and the curve: labelled rows, each without itself.
    distinct = list({rows[k]: k for k in train}.values())
    y = np.array([known[k] > 0 for k in distinct])
    left = [scanned(words[k], int(known[k] > 0)) for k in distinct]
    best, m = greatest(left), n[distinct]
    b, a = np.polyfit(np.log(m[~y] + 1), best[~y], 1)
    scale = max(np.std(best[~y] - a - b * np.log(m[~y] + 1)) * math.sqrt(6) / math.pi, 0.1)
    p_value = lambda v, m: 1 - math.exp(-math.exp(-((v - a - b * math.log(m + 1)) / scale + np.euler_gamma)))

    def inputs(found, n):
        tails = [[(p_value(v, m), i, j) for v, i, j in s] for s, m in zip(found, n, strict=True)]
        kept = [[x for x in t if x[0] <= toxicity.LEVEL] for t in tails]
        surprise = np.array([min(-math.log(p_value(v, m)), toxicity.MOST) for v, m in zip(greatest(found), n, strict=True)])
        evidence = np.array([-sum(math.log(p) for p, _, _ in k) for k in kept])
        return np.column_stack([surprise, np.log1p(evidence), np.log1p(n)]), kept

    curve = fitted(inputs(left, m)[0], y)
    found = [scanned(ws) for ws in words]
    x, kept = inputs(found, n)
    z = np.column_stack([np.ones(len(x)), x]) @ curve
    return list(zip((1 / (1 + np.exp(-z))).tolist(), [len(k) for k in kept], greatest(found).tolist(), strict=True))


def toxic_rows(seed):
    """Words of one stem are toxic or not by their ends, so a stem and a whole word of its letters differ."""
    r = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("bra", "stel", "mor", "cant") for b in ("", "do", "tiv") for c in ("", "ne", "ro", "lim")]
    bad = ["bras", "stelvile", "morfoul", "cantcrude", "brad", "canty"]
    rows, labels = [], {}
    for i in range(260):
        ws = [r.choice(plain) for _ in range(r.randint(8, 40))]
        if i % 5 == 0:
            at = r.randrange(len(ws))
            ws[at:at] = r.sample(bad, 3)
        if i % 7 == 0:
            ws.insert(0, r.choice(bad))
        rows.append((i, " ".join(ws).title() if i % 2 else ", ".join(ws)))
        labels[i] = int(i % 5 == 0)
    rows += [rows[11], rows[11], (11, "stel morfoul bras"), (None, rows[5][1]), (None, None), (400, None), (401, ""), (402, "12 . !")]
    labels |= {400: 0, 401: 0, 402: 1}
    return rows, labels


@pytest.mark.parametrize("seed", range(3))
def test_toxicity_whole_query(spark, seed):
    rows, labels = toxic_rows(seed)
    df = docs(spark, [(i, t, "en", "a") for i, t in rows])
    marks = spark.createDataFrame([(i, 1, y) for i, y in labels.items()] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((r.doc_id, round(r.score, 6), r.predicted, r.n_segments, round(r.best, 5)) for r in toxicity.scored(df, marks).collect()), key=order)
    want = brute_toxicity(rows, labels)
    want = sorted(((i, round(s, 6), int(s >= 0.5), n, round(b, 5)) for (i, _), (s, n, b) in zip(rows, want, strict=True)), key=order)
    assert [g[0] for g in got] == [w[0] for w in want]
    np.testing.assert_allclose([g[1:] for g in got], [w[1:] for w in want], atol=2e-5)


def library_ids(spark, sf):
    tok = TokenIds(default_tokenizer(), 2).library
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    coded = tok.encode_batch([t for _, t in rows], add_special_tokens=False)
    return {i: np.array([*c.ids, 2], "<u4") for (i, _), c in zip(rows, coded, strict=True)}


def test_token_output_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    ids = library_ids(spark, sf)
    at, want = 0, []
    for i in sorted(ids):
        want.append((i, at, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        at += len(ids[i])
    got = token_output.op10_token_output(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_packing_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    ids = library_ids(spark, sf)
    got = packing.op7_best_fit_packing(spark, sf).toPandas()
    for i, rows in got.groupby("doc_id"):
        rows = rows.sort_values("piece")
        x = ids.pop(i)
        assert rows.piece.tolist() == list(range(len(rows))) and rows.start.tolist() == [0, *rows.length.cumsum()[:-1]]
        assert rows.length.sum() == len(x) and (rows.length[1:] == 1024).all() and rows.length.between(1, 1024).all()
        assert [zlib.crc32(x[r.start : r.start + r.length].tobytes()) for r in rows.itertuples()] == rows.ids_crc32.tolist()
    assert not ids
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum()[:-1]] and rows.length.sum() <= 1024
    # Volume bound: fewer sequences cannot hold the pieces.
    assert got.sequence_id.nunique() <= -(-int(got.length.sum()) // 1024) + 2
