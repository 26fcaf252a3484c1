"""Conversation repair and the prefix trie against SQL over edge cases, and against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from verisift.llm import conversation_repair, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, n long, chunk long, depth long"


def frame(spark, rows):
    """Rows of a conversation with columns whose names clash with ones used inside."""
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def by_sql(rows, sql):
    con = duckdb.connect()
    con.register("given", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"], dtype=object))
    con.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role::VARCHAR AS role, text::VARCHAR AS text FROM given")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return sorted(repr(sorted(zip(names, r, strict=True))) for r in cur.fetchall())


def collected(df):
    return sorted(repr(sorted(r.asDict().items())) for r in df.collect())


EDGES = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello there."), (1, 2, "assistant", "Hi!"), (1, 2, "assistant", "Hi!"), (1, 3, "user", "cut off"),
    (2, None, "user", "no turn."), (2, None, None, None), (2, 5, "tool", "other role."), (2, 5, "assistant", "tie."), (2, 5, "assistant", "another tie."),
    (None, 1, "user", "no id."), (None, 2, "assistant", ""), (3, 0, "", "no role."), (3, 1, "user", " \t\n\x0b\x0c\r "), (100, 0, "user", "first."), (100, 1, "assistant", "second."),
    (101, 0, "user", "third."), (142, 7, "assistant", "Ünï 日本 😀."), (142, 8, "user", "x" * 30000 + "."), (-5, 1, "user", "below zero."), (7, 3, "user", "q?  \n"),
]


def long_rows(n, conv=300, seed=5):
    rnd = random.Random(seed)
    return [(conv, t, rnd.choice(["user", "assistant", "system", "x"]), rnd.choice(["same.", "", f"t{t}.", f"t{t}", "cut"])) for t in range(n)]


@pytest.mark.parametrize("op", ["repair", "prefix_trie"])
def test_edges_as_sql(spark, op):
    module = conversation_repair if op == "repair" else prefix_trie
    df = getattr(module, op)(frame(spark, EDGES))
    assert collected(df) == by_sql(EDGES, module.SQL)


@pytest.mark.parametrize("op", ["repair", "prefix_trie"])
def test_empty_table(spark, op):
    module = conversation_repair if op == "repair" else prefix_trie
    assert getattr(module, op)(frame(spark, [])).count() == 0


def test_hot_conversation_is_repaired_in_chunks(spark, monkeypatch):
    """Several rounds of chunks, and equal rows of one turn that are counted."""
    monkeypatch.setattr(conversation_repair, "CHUNK", 4)
    rows = long_rows(150) + long_rows(9, 301, 1) + [(302, 1, "user", "again.")] * 40 + EDGES
    assert collected(conversation_repair.repair(frame(spark, rows))) == by_sql(rows, conversation_repair.SQL)


def test_hot_conversation_in_the_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    rows = long_rows(70) + [(c, t, "user", f"shared {t}") for c in range(400, 430) for t in range(3)] + [(500, 1, "user", "again.")] * 20 + EDGES
    assert collected(prefix_trie.prefix_trie(frame(spark, rows))) == by_sql(rows, prefix_trie.SQL)


def spoilt(rows):
    """Damage as the contract has it, in order."""
    out = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(t, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def brute_repair(rows):
    """All edits of a short conversation, one after another."""
    seen, faults = set(), []
    for _, role, text in rows:
        told = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else "")
        seen.add((role, text))
    inserted = [(), ("user",), ("assistant",), ("user", "assistant")]
    best = None
    for gaps in itertools.product(inserted, repeat=len(rows) + 1):
        for edits in itertools.product(["K", "user", "assistant", "D"], repeat=len(rows)):
            if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, edits, strict=True)):
                continue
            cost, audit, lines = 0, "", []
            for k in range(len(rows) + 1):
                cost += 5 * len(gaps[k])
                audit += "I" * len(gaps[k])
                lines += [(r, "") for r in gaps[k]]
                if k < len(rows):
                    e = edits[k]
                    audit += e if e in "KD" else "R"
                    cost += 2 if e == "D" else (e != "K") + 5 * (faults[k] == "truncated")
                    if e != "D":
                        lines.append((rows[k][1] if e == "K" else e, rows[k][2]))
            legal = all(r for r, _ in lines) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines))
            if legal and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def test_cheapest_edits_by_brute_force(spark):
    rnd = random.Random(3)
    rows = [
        (c, t, rnd.choice(["user", "assistant", "system", "user", "assistant", "bot"]), rnd.choice(["One.", "Two!", "three", "", "Why?"]))
        for c in range(60) for t in sorted(rnd.sample(range(9), rnd.randint(1, 3)))
    ]
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(frame(spark, rows)).collect()}
    for c in range(60):
        assert got[c] == brute_repair(spoilt([r for r in rows if r[0] == c])), c


def brute_trie(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c // 100 * 100, [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = lambda n: [m for m in members if m[: len(n)] == n]
    kids = {n: [m for m in members if len(m) == len(n) + 1 and m[:-1] == n] for n in members}
    return sorted(
        (min(cs), len(n), min(members[n[:-1]]) if n else None, len(cs), len(kids[n]), sum(not kids[m] for m in below(n)), sum((len(members[m]) - 1) * len(m[-1][1]) for m in below(n) if m),
         hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(n)).encode()).hexdigest()) for n, cs in members.items()
    )


def test_trie_by_brute_force(spark):
    rnd = random.Random(8)
    rows = [(c, t if rnd.random() < 0.9 else None, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bb", "ccc", None])) for c in range(90, 230, 3) for t in range(rnd.randint(1, 9))]
    rows += [(c, t, "user", f"base {t}") for c in (100, 200) for t in range(4)]
    got = sorted(map(tuple, prefix_trie.prefix_trie(frame(spark, rows)).collect()), key=repr)
    assert got == sorted(brute_trie(rows), key=repr)
