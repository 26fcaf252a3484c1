"""Repair of damaged conversations: the cheapest edits that give each one a legal order of roles (Spark, DuckDB in the tasks).

Roles have to read (s?(ua)+)? by their initials, so an edit leads from one of four states to another: nothing yet, after the system's turn, after
the user, after the assistant. A recursive DuckDB query inside hash-partitioned batches advances one turn of all conversations of the batch
in each recursion, and keeps the least cost, and of equal ones the least audit, for each state. Two audits of equal cost for the same turns are
never the beginning of one another (they would differ by inserts alone), so the least one stays least whatever follows.

A conversation may hold any share of the rows: turns are ordered by ranges and cut into chunks of 128; a chunk's result is kept for each state that it
may begin in, and the same query then runs over chunks as it did over turns, until one is left. Equal rows of a turn are one row with
a count. The digest of a repaired conversation is one SHA-256 over its text, which no task can share: chunks are put together in
parallel, and only conversations of several chunks are hashed by streaming over these.

Edge cases: null conv_id is a conversation of its own; null turns stand first; turns of equal number stand in the order of role, then of the text's
SHA-256; a role that is empty or begins with any other letter can only be reroled or deleted; a very long text is one row of a batch of 1,000 and is not cut; other columns are not read; no
conversations give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verisift.llm.common import SPACE, parts, small_batches, staged, table
from verisift.llm.prefix_trie import CRC32

#: Turns (or chunks) that one recursive query walks, and rows of a batch.
CHUNK, BATCH = 128, 8192
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of edits, and what an undeleted truncated turn adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Where a turn of this initial leads from a state, and what an inserted or reroled turn becomes there.
LEGAL = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}


def _inserts(q: int) -> list[tuple[str, int, str]]:
    """Ways to insert turns: edits, the state they lead to, and their lines. More would come back to a state that fewer reach."""
    out = [("", q, "")]
    while NEXT[out[-1][1]] not in {at for _, at, _ in out}:
        edits, at, lines = out[-1]
        out.append((edits + "I", NEXT[at], f"{lines}{NAMES[NEXT[at]]}:\n"))
    return out


def _closing() -> list[tuple]:
    """(state, edits, cost, lines): the cheapest inserts that end a conversation there."""
    return [(q, *min((e, INSERT * len(e), s) for e, at, s in _inserts(q) if at in (START, ASSISTANT))) for q in range(4)]


def _arcs() -> list[tuple]:
    """(state, initial or '*', edits, cost, next state, lines inserted before, new role): all edits of one turn."""
    out = []
    for q in range(4):
        for edits, at, lines in _inserts(q):
            cost = INSERT * len(edits)
            out += [(q, i, f"{edits}K", cost + KEEP, to, lines, "") for (q1, i), to in LEGAL.items() if q1 == at]
            out += [(q, "*", f"{edits}R", cost + REROLE, NEXT[at], lines, NAMES[NEXT[at]]), (q, "*", f"{edits}D", cost + DELETE, at, lines, "")]
    return out


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + v + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


ARCS = f"arcs(q, ini, edits, price, q2, lines, newrole) AS (VALUES {_values(_arcs())})".replace("\n", "' || chr(10) || '")
CLOSE = f"closing(q, edits, price, lines) AS (VALUES {_values(_closing())})".replace("\n", "' || chr(10) || '")
#: Edits of each turn: the cheapest for each pair of states. rows: unit, pos, ini, must, cut, n.
STEPS = f"""WITH {ARCS} SELECT unit, pos, q, q2, min(price + CASE WHEN cut AND suffix(edits, 'D') IS FALSE THEN {TRUNCATED} ELSE 0 END + {DELETE} * (n - 1)) AS cost,
 arg_min(edits || repeat('D', n - 1), (price + CASE WHEN cut AND suffix(edits, 'D') IS FALSE THEN {TRUNCATED} ELSE 0 END, edits)) AS edits
 FROM turns JOIN arcs ON arcs.ini IN ('*', turns.ini) AND (NOT must OR suffix(edits, 'D')) GROUP BY unit, pos, q, q2"""
#: One recursion a turn (or a chunk) for all units at once; a row for each unit, state to begin in and state reached.
WALK = """WITH RECURSIVE sizes AS (SELECT unit, max(pos) AS last FROM steps GROUP BY unit),
walk AS (SELECT unit, -1::BIGINT AS pos, q AS q0, q, 0::BIGINT AS cost, '' AS audit FROM sizes, range(4) s(q)
 UNION ALL SELECT w.unit, s.pos, w.q0, s.q2, min(w.cost + s.cost), arg_min(w.audit || s.edits, (w.cost + s.cost, w.audit || s.edits)) FROM walk w JOIN steps s ON s.unit = w.unit AND s.pos = w.pos + 1 AND s.q = w.q GROUP BY w.unit, s.pos, w.q0, s.q2)
SELECT w.unit, q0 AS q, w.q AS q2, cost, audit AS edits FROM walk w JOIN sizes z ON z.unit = w.unit AND z.last = w.pos"""


def initial(role: Column) -> Column:
    i = F.substring(role, 1, 1)
    return F.when(i.isin("s", "u", "a"), i).otherwise("?")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv (text; empty for null), turn, role, text and copies of the rows after the damage."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    role = F.when(kind == 4, "user").otherwise(one("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.where("copies > 0").withColumn("h", F.sha2(F.col("text").cast("binary"), 256)).withColumn("tk", F.coalesce(F.col("turn").cast("string"), F.lit("")))


def ordered(rows: DataFrame) -> DataFrame:
    """The distinct rows of each turn without their texts: conv, tk, turn, role, h, n (rows), ini, blank, dup, cut, chunk, pos (place in the
    chunk). Chunks ascend with the order of the conversation. Staged."""
    told = F.rtrim("text", F.lit(SPACE))
    last = F.substring(told, -1, 1)
    flat = rows.select("conv", "tk", "turn", "role", "h", "copies", (told == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    flat = flat.groupBy("conv", "tk", "turn", "role", "h").agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    flat = staged(flat, "repair-rows")
    # A struct with a null in it is less than any other.
    first = flat.groupBy("conv", "role", "h").agg(F.min(F.struct("turn", "tk")).alias("m")).select("conv", "role", "h", F.col("m.tk").alias("tk"), F.lit(True).alias("new"))
    x = flat.join(first, ["conv", "role", "h", "tk"], "left").withColumn("dup", F.col("new").isNull()).drop("new")
    n = parts(rows.sparkSession)
    x = x.repartitionByRange(n, "conv", "turn", "role", "h").sortWithinPartitions("conv", "turn", "role", "h").withColumn("at", F.monotonically_increasing_id())
    x = staged(x, "repair-order").withColumn("task", F.shiftright("at", 33))
    rank = F.col("at") - F.min("at").over(W.partitionBy("conv", "task"))
    x = x.withColumn("chunk", F.shiftleft("task", 26) + F.floor(rank / CHUNK)).withColumn("pos", rank % CHUNK)
    return x.select("conv", "tk", "turn", "role", "h", "n", initial(F.col("role")).alias("ini"), "blank", "dup", "cut", "chunk", "pos")


def _duck():
    import duckdb

    con = duckdb.connect(":memory:")
    con.execute("SET threads = 1; SET memory_limit = '700MB'; SET temp_directory = ''; SET preserve_insertion_order = false")
    return con


def _recurse(rows: DataFrame, prepare: str) -> DataFrame:
    """rows (conv, chunk, pos from 0, ...) to the best edits of each chunk: conv, chunk, q (begun in), q2 (reached), cost, edits. prepare: SQL that makes steps of turns."""
    names = ["conv", "chunk", "q", "q2", "cost", "edits"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        con = _duck()

        def solve(t: pa.Table):
            con.register("given", t)
            # A unit is a chunk: the rows of one come one after another.
            con.execute("CREATE OR REPLACE TEMP TABLE units AS SELECT row_number() OVER () AS unit, conv, chunk FROM (SELECT DISTINCT conv, chunk FROM given)")
            con.execute("CREATE OR REPLACE TEMP TABLE turns AS SELECT unit, g.* EXCLUDE (conv, chunk) FROM given g JOIN units u ON u.conv = g.conv AND u.chunk = g.chunk")
            con.execute(f"CREATE OR REPLACE TEMP TABLE steps AS {prepare}")
            out = con.sql(f"SELECT u.conv, u.chunk, w.q::INT AS q, w.q2::INT AS q2, w.cost::BIGINT AS cost, w.edits FROM ({WALK}) w JOIN units u ON u.unit = w.unit").to_arrow_table()
            con.unregister("given")
            return out.select(names).to_batches()

        held, size = [], 0
        for b in batches:
            t = pa.Table.from_batches([b])
            if size + len(b) > BATCH and size:
                whole = pa.concat_tables(held)
                # The last unit may go on in this batch: it waits.
                conv, chunk = whole.column("conv")[-1].as_py(), whole.column("chunk")[-1].as_py()
                stays = pc.and_(pc.equal(whole.column("conv"), conv), pc.equal(whole.column("chunk"), chunk))
                ready, rest = whole.filter(pc.invert(stays)), whole.filter(stays)
                if len(ready):
                    yield from solve(ready)
                held, size = [rest], len(rest)
            held.append(t)
            size += len(b)
        if size:
            yield from solve(pa.concat_tables(held))

    dealt = rows.repartition(parts(rows.sparkSession), "conv", "chunk").sortWithinPartitions("conv", "chunk", "pos")
    return dealt.mapInArrow(run, "conv string, chunk long, q int, q2 int, cost long, edits string")


def audits(x: DataFrame) -> DataFrame:
    """conv, cost and audit of the cheapest repair of each conversation of x (ordered())."""
    spark = x.sparkSession
    turns = x.select("conv", "chunk", "pos", "ini", (F.col("blank") | F.col("dup")).alias("must"), "cut", "n")
    best = staged(_recurse(turns, STEPS), "repair-chunks")
    done = None
    while True:
        per = best.groupBy("conv").agg(F.countDistinct("chunk").alias("chunks"))
        single = best.join(per.where("chunks = 1"), "conv").drop("chunks")
        done = single if done is None else done.unionByName(single)
        many = best.join(per.where("chunks > 1"), "conv").drop("chunks")
        if many.isEmpty():
            break
        # Chunks become the turns of the next round: numbered within the conversation, CHUNK of them to a unit.
        number = many.select("conv", "chunk").distinct().withColumn("k", F.row_number().over(W.partitionBy("conv").orderBy("chunk")) - 1)
        up = many.join(number, ["conv", "chunk"]).select("conv", F.floor(F.col("k") / CHUNK).alias("chunk"), (F.col("k") % CHUNK).alias("pos"), "q", "q2", "cost", "edits")
        best = staged(_recurse(up, "SELECT unit, pos, q, q2, cost, edits FROM turns"), "repair-chunks")
    close = spark.createDataFrame([r[:3] for r in _closing()], "q2 int, tail string, more int")
    ends = done.where(F.col("q") == START).join(F.broadcast(close), "q2").select("conv", (F.col("cost") + F.col("more")).alias("cost"), F.concat("edits", "tail").alias("audit"))
    return ends.groupBy("conv").agg(F.min(F.struct("cost", "audit")).alias("b")).select("conv", "b.cost", "b.audit")


def counts(x: DataFrame) -> DataFrame:
    """gaps, blank, duplicate, truncated and illegal of each conversation. Neighbours are compared inside chunks, then between their ends."""
    pair = lambda a, b: (~F.concat(a, b).isin("su", "ua", "au")).cast("long")
    here = W.partitionBy("conv", "chunk").orderBy("pos")
    bad = F.coalesce(pair(F.lag("ini").over(here), F.col("ini")), F.lit(0)) + F.col("n") - 1
    n = F.col("n")
    fault = lambda c: F.sum(F.when(c, n).otherwise(0))
    c = x.withColumn("bad", bad).groupBy("conv", "chunk").agg(
        F.sum("bad").alias("inner"), F.min_by("ini", "pos").alias("a"), F.max_by("ini", "pos").alias("z"),
        fault(F.col("blank")).alias("blank"), F.sum(F.when(F.col("blank"), 0).when(F.col("dup"), n).otherwise(n - 1)).alias("duplicate"), F.sum((~F.col("blank") & ~F.col("dup") & F.col("cut")).cast("long")).alias("truncated"),
    )
    between = F.coalesce(pair(F.lag("z").over(W.partitionBy("conv").orderBy("chunk")), F.col("a")), F.lit(0))
    c = c.withColumn("illegal", F.col("inner") + between).groupBy("conv").agg(*[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal")])
    g = x.select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    return c.join(g, "conv").withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long")))


def pieces(x: DataFrame, audit: DataFrame) -> DataFrame:
    """The audit cut by chunks: conv, chunk, edits, before (turns that stand in the repaired conversation before it), opened (whether the system's
    turn comes first), chunks (of the conversation)."""
    sizes = x.groupBy("conv", "chunk").agg(F.sum("n").alias("n")).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("chunk", "n"))).alias("sizes"))

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for b in batches:
            out = []
            for conv, audit_, of in zip(b["conv"], b["audit"], b["sizes"], strict=True):
                letters = np.frombuffer(audit_.encode(), np.uint8)
                stays = np.concatenate([[0], np.cumsum(letters != ord("D"))])
                rows = np.flatnonzero(letters != ord("I"))
                opened, start, seen = bool(stays[-1] % 2), 0, 0
                for k, c in enumerate(of):
                    seen += c["n"]
                    # Inserts at the very end belong to the last chunk.
                    end = len(letters) if k == len(of) - 1 else int(rows[seen - 1]) + 1
                    out.append((conv, c["chunk"], audit_[start:end], int(stays[start]), opened, len(of)))
                    start = end
            yield pd.DataFrame(out, columns=["conv", "chunk", "edits", "before", "opened", "chunks"])

    return audit.join(sizes, "conv").select("conv", "audit", "sizes").mapInPandas(cut, "conv string, chunk long, edits string, before long, opened boolean, chunks int")


def repaired_lines(edits: str, before: int, opened: bool, rows: list[tuple[str, str, int]]) -> list[str]:
    """The lines of a chunk: rows of (role, text, count) under their edits."""
    out, turns = [], iter([(r, t) for r, t, n in rows for _ in range(n)])
    for e in edits:
        role, text = ("", "") if e == "I" else next(turns)
        if e == "D":
            continue
        before += 1
        if e != "K":
            role = "user" if before % 2 != opened else "assistant"
        out.append(f"{role}:{text}")
    return out


def digests(rows: DataFrame, x: DataFrame, cuts: DataFrame) -> DataFrame:
    """conv and the SHA-256 of its repaired text."""
    spark = rows.sparkSession
    texts = rows.groupBy("conv", "tk", "role", "h").agg(F.first("text").alias("text"))
    held = x.join(texts, ["conv", "tk", "role", "h"]).select("conv", "chunk", "pos", "role", "text", "n", F.lit(0).cast("long").alias("before"), F.lit(False).alias("opened"), F.lit(0).alias("chunks"))
    heads = cuts.select("conv", "chunk", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("edits").alias("text"), F.lit(0).cast("long").alias("n"), "before", "opened", "chunks")
    dealt = held.unionByName(heads).repartition(parts(spark), "conv", "chunk").sortWithinPartitions("conv", "chunk", "pos")

    def build(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def told(head, rows):
            conv, chunk, edits, before, opened, chunks = head
            lines = repaired_lines(edits, before, opened, rows)
            body = "\n".join(lines).encode()
            return (conv, chunk, hashlib.sha256(body).hexdigest(), None) if chunks == 1 else (conv, chunk, None, body if lines else None)

        def batch(out):
            names = ["conv", "chunk", "sha", "body"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        head, rows = None, []
        for b in batches:
            out, size = [], 0
            for conv, chunk, pos, role, text, n, before, opened, chunks in zip(*(b.column(c).to_pylist() for c in ("conv", "chunk", "pos", "role", "text", "n", "before", "opened", "chunks")), strict=True):
                if pos < 0:
                    if head:
                        out.append(told(head, rows))
                    head, rows = (conv, chunk, text, before, opened, chunks), []
                else:
                    rows.append((role, text, n))
            if out:
                yield batch(out)
        if head:
            yield batch([told(head, rows)])

    built = staged(dealt.mapInArrow(build, "conv string, chunk long, sha string, body binary"), "repair-built")

    def stream(batches: Iterator) -> Iterator:
        import pyarrow as pa

        conv, sha, bare = None, None, True
        for b in batches:
            out = []
            for c, body in zip(b.column("conv").to_pylist(), b.column("body").to_pylist(), strict=True):
                if c != conv:
                    if conv is not None:
                        out.append((conv, sha.hexdigest()))
                    conv, sha, bare = c, hashlib.sha256(), True
                if body is not None:
                    sha.update(body if bare else b"\n" + body)
                    bare = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], names=["conv", "sha"])
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([sha.hexdigest()])], names=["conv", "sha"])

    rest = built.where("sha IS NULL").select("conv", "chunk", "body").repartition(parts(spark), "conv").sortWithinPartitions("conv", "chunk")
    return built.where("sha IS NOT NULL").select("conv", "sha").unionByName(rest.select("conv", "body").mapInArrow(stream, "conv string, sha string"))


def repair(conversations: DataFrame) -> DataFrame:
    """Each conversation with its faults, the cheapest repair's cost and audit, and the digest of the repaired text."""
    small_batches(conversations.sparkSession)
    rows = damaged(conversations)
    x = staged(ordered(rows), "repair-turns")
    a = staged(audits(x), "repair-audits")
    sha = digests(rows, x, pieces(x, a))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    j = ids.join(counts(x), "conv", "left").join(a, "conv", "left").join(sha, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return j.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


_GRAM = "CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE '?' END"
_CUT = f"CASE WHEN cut AND NOT suffix(edits, 'D') THEN {TRUNCATED} ELSE 0 END"
SQL = f"""WITH RECURSIVE {ARCS}, {CLOSE},
k AS MATERIALIZED (SELECT coalesce(conv_id::VARCHAR, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {CRC32.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
d AS (SELECT conv, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
t AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy) - 1 AS pos, {_GRAM} AS ini, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS told FROM d),
f AS MATERIALIZED (SELECT *, told = '' AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS dup, right(told, 1) NOT IN ('.', '!', '?') AS cut, lag(ini) OVER (PARTITION BY conv ORDER BY pos) || ini AS pair FROM t),
steps AS MATERIALIZED (SELECT conv, pos, q, q2, price + {_CUT} AS cost, edits, lines || CASE WHEN suffix(edits, 'K') THEN role || ':' || text || chr(10) WHEN suffix(edits, 'R') THEN newrole || ':' || text || chr(10) ELSE '' END AS said
  FROM f JOIN arcs ON arcs.ini IN ('*', f.ini) AND (NOT (blank OR dup) OR suffix(edits, 'D'))),
w AS (SELECT conv, -1::BIGINT AS pos, 0 AS q, 0::BIGINT AS cost, '' AS audit, '' AS said FROM (SELECT DISTINCT conv FROM k)
  UNION ALL SELECT w.conv, s.pos, s.q2, min(w.cost + s.cost), arg_min(w.audit || s.edits, (w.cost + s.cost, w.audit || s.edits)), arg_min(w.said || s.said, (w.cost + s.cost, w.audit || s.edits))
  FROM w JOIN steps s ON s.conv = w.conv AND s.pos = w.pos + 1 AND s.q = w.q GROUP BY w.conv, s.pos, s.q2),
z AS (SELECT conv, max(pos) AS last FROM w GROUP BY conv),
b AS (SELECT w.conv, min(cost + price)::BIGINT AS cost, arg_min(audit || c.edits, (cost + price, audit || c.edits)) AS audit, arg_min(said || c.lines, (cost + price, audit || c.edits)) AS said FROM w JOIN z ON z.conv = w.conv AND z.last = w.pos JOIN closing c ON c.q = w.q GROUP BY w.conv),
n AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND dup) AS duplicate, count(*) FILTER (WHERE NOT blank AND NOT dup AND cut) AS truncated,
  count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv)
SELECT nullif(b.conv, '')::BIGINT AS conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
 sha256(regexp_replace(said, chr(10) || '$', '')) AS repaired_sha256 FROM b LEFT JOIN n USING (conv)"""
