"""Removal of repeated byte strings against counting all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import EDGES, docs
from verisift.llm import suffix_dedup
from verisift.llm.columns import repeated_columns


def brute(rows, length=200):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for (doc_id, *_), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = 1
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((doc_id, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def got(spark, rows):
    return sorted(repr(tuple(r)) for r in suffix_dedup.remove_repeats(docs(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnoé") for _ in range(rnd.randint(1, 9))) for _ in range(n))


def some_documents(seed=1):
    """Shared passages of many lengths round 200 bytes in different places, copies, near copies, texts that repeat themselves."""
    rnd = random.Random(seed)
    passages = [prose(rnd, k) for k in (30, 34, 38, 42, 80, 200)]
    rows = [(k, " ".join([prose(rnd, rnd.randint(0, 60)), rnd.choice(passages), prose(rnd, rnd.randint(0, 60)), rnd.choice(passages)]), "en", "a") for k in range(60)]
    base = prose(rnd, 150)
    for k in range(60, 90):
        words = base.split(" ")
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words), "en", "b"))
    rows += [(90, "ab" * 400, "en", "c"), (91, "a" * 199, "en", "c"), (92, "a" * 200, "en", "c"), (93, "a" * 201, "en", "c"), (94, ("x" * 300 + "y") * 3, "en", "c"), (95, prose(rnd, 3000), "en", "c")]
    rows += [(96, rows[3][1], "en", "d"), (97, rows[3][1] + "!", "en", "d"), (98, "日本語" * 40 + "é" * 300, "ja", "d"), (99, passages[-1][1:], "en", "d")]
    return rows


def test_all_windows(spark):
    rows = some_documents()
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("limit", [2, 8])
def test_large_groups_are_split(spark, monkeypatch, limit):
    """Groups beyond the limit go by blocks of windows, then by single windows."""
    monkeypatch.setattr(suffix_dedup, "LIMIT", limit)
    rows = some_documents(2)
    assert got(spark, rows) == brute(rows)


def test_hot_anchors_are_spread(spark, monkeypatch):
    rows = some_documents(3)
    hot = suffix_dedup.hot_anchors(docs(spark, rows * 3))
    assert len(hot)  # the copies' anchors
    monkeypatch.setattr(suffix_dedup, "hot_anchors", lambda d: hot)
    assert got(spark, rows) == brute(rows)


def test_slices_cut_no_window(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    monkeypatch.setattr(suffix_dedup, "BATCH", 50)
    rows = some_documents(4)
    assert got(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(i, None if t is None else t[:2500], lang, s) for i, t, lang, s in EDGES]
    assert got(spark, rows) == brute(rows)
    assert got(spark, [(i, t, lang, s) for i, t, lang, s in EDGES if i is not None and t is not None and len(t) < 100]) == brute([r for r in EDGES if r[0] is not None and r[1] is not None and len(r[1]) < 100])


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_transform_of_each_column():
    """The transform and the common prefixes of each column are those of its sorted suffixes."""
    rnd = random.Random(5)
    strings, leads = [], []
    for _ in range(60):
        lead = rnd.randint(0, 6)
        strings.append("".join(rnd.choice("ab") for _ in range(lead + rnd.randint(4, 12))).encode())
        leads.append(lead)
    seen = {}
    data = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.array([len(s) for s in strings])
    i, w = repeated_columns(data, np.cumsum(lengths) - lengths, lengths, np.array(leads), 5, lambda c, t, p: seen.__setitem__(c, (bytes(t), list(p))))
    for column, (transform, prefixes) in seen.items():
        # What begins in the next column, of strings that have a symbol here.
        of = [(s[lead + column + 1 :], s[lead + column]) for s, lead in zip(strings, leads, strict=True) if lead + column >= 0 and lead + column < len(s)]
        ranked = sorted(s for s, _ in of)
        shared = [min(5, next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))) for x, y in zip(ranked, ranked[1:], strict=False)]
        assert prefixes[1:] == shared
        assert sorted(transform) == sorted(c for _, c in of)
        groups = {}
        for s, c in of:
            groups.setdefault(s, []).append(c)
        at = 0
        for s in sorted(groups):
            assert sorted(transform[at : at + len(groups[s])]) == sorted(groups[s])
            at += len(groups[s])
    windows = Counter((lead_at, s[o : o + 5]) for s, lead in zip(strings, leads, strict=True) for o in range(len(s) - 4) for lead_at in [o - lead])
    expected = {(k, o) for k, (s, lead) in enumerate(zip(strings, leads, strict=True)) for o in range(len(s) - 4) if windows[o - lead, s[o : o + 5]] > 1}
    assert set(zip(i.tolist(), w.tolist(), strict=True)) == expected
