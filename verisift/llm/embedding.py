"""Near-duplicate embeddings by range search on a robust-pruned flat graph.

1. Vectors with equal bytes are one class. Medoids come from a bounded sample (SAMPLE vectors); every class
   goes to its OVERLAP nearest medoids' shards. A shard beyond BLOCK classes gets medoids of its own, again from a bounded sample, and is
   split by them, as often as that helps; what no medoid can split is cut into blocks, and each pair of blocks is a task.
2. Each task links every class to its nearest ones and prunes the candidates robustly (one that is
   much closer to a kept neighbour than to the node goes); a few random neighbours keep tight groups reachable.
3. The lists of all shards and the reverse edges are united by class.
4. Every class is a query once, in its nearest shard, on the united lists: greedy search walks from the shard's medoid and the query's own node,
   then the range expands: neighbours of everything within reach are tried until nothing new is found. Hits are verified by cosine
   in double precision. Links that a list holds to classes outside of that shard are added from the lists.
5. Tasks return counts and a spanning forest of their links, never the pairs of a group.
6. Recall is audited: classes are compared with all vectors, half of them drawn from those whose lists hold anything near the limit and half from all, until
   ENOUGH links are met or MOST_AUDIT classes are drawn. Each class with a true link counts alike, so that one hot group hides no other. Below TARGET, the build is
   repeated with more overlap, and in the end fails; what was measured is logged, and without a measured link no recall is claimed.

Edge cases: null, zero and empty vectors and vectors with null or non-finite components link with nothing (n_links 0,
component their own id); vectors of different lengths do not link; rows that share a vec_id are rows of their
own, the component's id is the least; null ids take part but name no component that has another; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.llm.common import drop_staged, small_side, staged, table
from verisift.llm.components import components

LOG = logging.getLogger(__name__)
LEAST = 0.95
ROUTES = "key long, blob binary, copies long, shard long, home boolean"
SAMPLE = 20_000
#: Classes of a shard on average, at most (beyond, it is split), and rows of a task that splits one.
SHARD, BLOCK, ROUTED = 300, 2400, 20_000
OVERLAP, MOST_OVERLAP = 4, 12
#: Nearest ones that stay whatever the pruning says, kept candidates, candidates, and random neighbours of a node.
NEAREST, DEGREE, CANDIDATES, ALPHA, FAR = 4, 10, 24, 1.2, 6
BEAM, SLACK = 4, 0.03
#: Classes that the audit draws first and at most, links that it wants to meet, and how far below the limit a neighbour makes a class worth drawing.
AUDIT, MOST_AUDIT, ENOUGH, HINT, TARGET = 128, 2048, 200, 0.05, 0.98
MOST_CENTRES = 4096
#: Medoids have a cosine below this.
APART = 0.85


def unit(data: bytes) -> np.ndarray:
    """A row vector of unit length from the bytes of float64 values."""
    x = np.frombuffer(data, "<f8")
    x = x / np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def _matrix(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    dims = np.array([len(b) // 8 for b in blobs])
    out = np.zeros((len(blobs), int(dims.max()) if len(dims) else 1))
    for i, b in enumerate(blobs):
        out[i, : dims[i]] = unit(b)
    return out, dims


def classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, blob): blob null and key null for vectors that link with nothing."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            keys, blobs = [], []
            for v in batch.column("embedding").to_pylist():
                x = np.array([np.nan if c is None else c for c in v], "<f8") if v else np.empty(0)
                ok = len(x) and np.isfinite(x).all() and x.any()
                b = (x + 0.0).tobytes() if ok else None  # one zero, not two
                blobs.append(b)
                keys.append(xxhash.xxh64_intdigest(b) - (1 << 63) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["vec_id", "key", "blob"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(read, "vec_id long, key long, blob binary")


def medoids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Sample rows that stand for k clusters."""
    rng = np.random.default_rng(5)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 2000] @ c.T).argmax(1) for i in range(0, len(x), 2000)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    best = np.unique(np.concatenate([(x @ c[i : i + 500].T).argmax(0) for i in range(0, len(c), 500)]))
    # Medoids close to one another would cut a group of near-duplicates apart: one of them stays.
    kept: list[int] = []
    for i in best.tolist():
        if not kept or (x[kept] @ x[i]).max() < APART:
            kept.append(i)
    return x[kept]


def _nearest(x: np.ndarray, centres: np.ndarray, overlap: int) -> np.ndarray:
    """The overlap nearest centres of each row, nearest first."""
    d = min(x.shape[1], centres.shape[1])
    s = x[:, :d] @ centres[:, :d].T
    k = min(overlap, s.shape[1])
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)


def route(one: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """(key, blob, copies, shard, home): a row for each of the overlap nearest shards; home: the nearest one."""

    def near(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x, _ = _matrix(batch.column("blob").to_pylist())
            top = _nearest(x, centres, overlap)
            at = np.repeat(np.arange(len(x)), top.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(at)) for c in ("key", "blob", "copies")), pa.array(top.ravel().astype(np.int64)), pa.array(np.tile(np.arange(top.shape[1]) == 0, len(x)))],
                names=["key", "blob", "copies", "shard", "home"],
            )

    return one.select("key", "blob", "copies").mapInArrow(near, ROUTES)


def split_large(rows: DataFrame, overlap: int) -> DataFrame:
    """rows, with each shard of more than BLOCK classes split by medoids of its own as often as that helps. A class goes to the two nearest
    parts, and is at home in the nearest part of the shard where it was at home."""
    import pandas as pd

    done = rows.limit(0)
    for level in range(8):
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("m"))
        large = staged(sizes.where(F.col("m") > BLOCK), "graph-large")
        if large.isEmpty():
            break
        some = rows.join(small_side(large), "shard").where(F.pmod(F.xxhash64("key", F.lit(level)), F.lit(1_000_000)) * F.col("m") < 1_000_000 * SAMPLE // 4)

        def centres(pdf):
            x, _ = _matrix(pdf["blob"].tolist())
            m = int(pdf["m"].iloc[0])
            c = medoids(x, min(len(x), MOST_CENTRES, max(2, -(-m * overlap // SHARD))))
            return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "m": [m], "centres": [c.astype("<f8").tobytes()], "k": [len(c)]})

        found = staged(some.select("shard", "m", "blob").groupBy("shard").applyInPandas(centres, "shard long, m long, centres binary, k int"), "graph-centres")
        able = found.where("k > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / ROUTED).cast("int") - 1)))
        salts = found.where("k > 1").select("shard", "m").select("shard", F.ceil(F.col("m") / ROUTED).cast("int").alias("salts"))
        moved = rows.join(small_side(staged(salts, "graph-salts")), "shard").withColumn("salt", F.pmod(F.xxhash64("key", F.lit(level + 100)), F.col("salts")).cast("int")).drop("salts")

        def part(left, right):
            if left.empty or right.empty:
                return pd.DataFrame(columns=["key", "blob", "copies", "shard", "home", "old"])
            x, _ = _matrix(left["blob"].tolist())
            c = np.frombuffer(right["centres"].iloc[0], "<f8").reshape(int(right["k"].iloc[0]), -1)
            top = _nearest(x, c, 2)
            out = left.loc[left.index.repeat(top.shape[1])].reset_index(drop=True)
            first = np.tile(np.arange(top.shape[1]) == 0, len(x))
            # Ids of parts are spread over the longs, so that they meet no other shard's.
            new = np.array([hash((int(s), int(t))) for s, t in zip(out["shard"], top.ravel(), strict=True)], np.int64)
            return pd.DataFrame({"key": out["key"], "blob": out["blob"], "copies": out["copies"], "shard": new, "home": out["home"].to_numpy() & first, "old": out["shard"]})

        parts_ = staged(moved.groupBy("shard", "salt").cogroup(able.groupBy("shard", "salt")).applyInPandas(part, f"{ROUTES}, old long"), "graph-parts")
        # A split helps if no part keeps most of its shard.
        most = parts_.groupBy("old", "shard").agg(F.count(F.lit(1)).alias("n")).groupBy("old").agg(F.max("n").alias("n"))
        split = most.join(large.withColumnRenamed("shard", "old"), "old").where("10 * n <= 7 * m").select("old")
        split = small_side(staged(split, "graph-split"))
        done = staged(done.union(rows.join(split.withColumnRenamed("old", "shard"), "shard", "left_anti").select(rows.columns)), "graph-routes")
        rows = parts_.join(split, "old", "left_semi").select(done.columns)
        if rows.isEmpty():
            break
    return done.union(rows)


def prune(x: np.ndarray, cand: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Robust pruning of candidate lists (nearest first): at most DEGREE neighbours each, -1 where there are fewer."""
    m, k = cand.shape
    out = np.full((m, min(DEGREE, k)), -1)
    for a in range(0, m, 256):
        c, d = cand[a : a + 256], 2 - 2 * sim[a : a + 256]
        alive = np.isfinite(sim[a : a + 256])
        v = x[c]
        rows = np.arange(len(c))
        for r in range(out.shape[1]):
            any_ = alive.any(1)
            if not any_.any():
                break
            first = alive.argmax(1)
            out[a + rows[any_], r] = c[rows, first][any_]
            between = 2 - 2 * np.einsum("ijk,ik->ij", v, v[rows, first])
            alive &= ALPHA * between > d
            alive[rows, first] = False
    return out


def graph(x: np.ndarray, same: np.ndarray | None, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (from, to, cosine) of each node to its nearest ones, to those that pruning keeps, and to random ones."""
    m = len(x)
    k = min(CANDIDATES, m - 1)
    cand, sims = np.empty((m, k), np.int64), np.empty((m, k))
    for a in range(0, m, block):
        s = x[a : a + block] @ x.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        if same is not None:
            s[same[a : a + block, None] != same[None]] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        v = np.take_along_axis(s, top, 1)
        by = np.argsort(-v, axis=1, kind="stable")
        cand[a : a + block], sims[a : a + block] = np.take_along_axis(top, by, 1), np.take_along_axis(v, by, 1)
    near = np.where(np.isfinite(sims), cand, -1)[:, :NEAREST]
    far = np.random.default_rng(7).integers(0, m, (m, FAR))
    to = np.concatenate([near, prune(x, cand, sims), far], 1)
    u, v = np.repeat(np.arange(m), to.shape[1]), to.ravel()
    edge = np.unique((u * m + v)[(v >= 0) & (u != v)])
    u, v = edge // m, edge % m
    return u, v, np.einsum("ij,ij->i", x[u], x[v])


def _expand(off: np.ndarray, to: np.ndarray, q: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = off[node + 1] - off[node]
    total = np.cumsum(n)
    return np.repeat(q, n), to[np.repeat(off[node] - (total - n), n) + np.arange(total[-1] if len(total) else 0)]


def range_search(x: np.ndarray, off: np.ndarray, to: np.ndarray, start: int, queries: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For batches of queries: (query, node) of every node found with a cosine of least or more."""
    m = len(x)
    for a in range(0, len(queries), 512):
        qs = queries[a : a + 512]
        n = len(qs)
        seen = np.zeros((n, m), bool)
        rows = np.arange(n)
        hits_q, hits_v = [], []
        # Greedy: each step goes on from the best nodes that were not expanded yet.
        beam = np.full((n, BEAM), start)
        score = np.full((n, BEAM), -np.inf)
        score[:, 0] = x[qs] @ x[start]
        # A query is a node itself, so the walk goes on from there too.
        beam[:, 1], score[:, 1] = qs, np.where(qs == start, -np.inf, 1.0)
        done = ~np.isfinite(score)
        seen[:, start] = True
        seen[rows, qs] = True
        found_q, found_v, found_s = [rows], [np.full(n, start)], [score[:, 0].copy()]
        own = qs != start
        found_q.append(rows[own])
        found_v.append(qs[own])
        found_s.append(np.ones(int(own.sum())))
        active = rows
        while len(active):
            open_ = np.where(done[active], -np.inf, score[active])
            best = open_.argmax(1)
            go = np.isfinite(open_[np.arange(len(active)), best])
            active, best = active[go], best[go]
            if not len(active):
                break
            node = beam[active, best]
            done[active, best] = True
            q, v = _expand(off, to, active, node)
            new = ~seen[q, v]
            q, v = q[new], v[new]
            seen[q, v] = True
            s = np.einsum("ij,ij->i", x[qs[q]], x[v])
            found_q.append(q)
            found_v.append(v)
            found_s.append(s)
            # Each query's beam takes the best of what it held and what it met.
            if len(q):
                order = np.lexsort((-s, q))
                q, v, s = q[order], v[order], s[order]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                top = rank < BEAM
                more = np.full((n, BEAM), -np.inf)
                node2 = np.zeros((n, BEAM), np.int64)
                more[q[top], rank[top]], node2[q[top], rank[top]] = s[top], v[top]
                changed = np.unique(q)
                both = np.concatenate([score[changed], more[changed]], 1)
                keep = np.argsort(-both, axis=1, kind="stable")[:, :BEAM]
                score[changed] = np.take_along_axis(both, keep, 1)
                beam[changed] = np.take_along_axis(np.concatenate([beam[changed], node2[changed]], 1), keep, 1)
                done[changed] = np.take_along_axis(np.concatenate([done[changed], np.zeros((len(changed), BEAM), bool)], 1), keep, 1) | ~np.isfinite(score[changed])
        # Range: everything within reach is expanded until nothing new comes.
        fq, fv, fs = np.concatenate(found_q), np.concatenate(found_v), np.concatenate(found_s)
        while len(fq):
            hit = fs >= least
            hits_q.append(fq[hit])
            hits_v.append(fv[hit])
            near = fs >= least - SLACK
            fq, fv = fq[near], fv[near]
            nq, nv, ns = [], [], []
            for b in range(0, len(fq), 20_000):
                q, v = _expand(off, to, fq[b : b + 20_000], fv[b : b + 20_000])
                key = np.unique((q * m + v)[~seen[q, v]])
                q, v = key // m, key % m
                seen[q, v] = True
                nq.append(q)
                nv.append(v)
                ns.append(np.einsum("ij,ij->i", x[qs[q]], x[v]))
            fq, fv, fs = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (nq, nv, ns))
        q, v = np.concatenate(hits_q), np.concatenate(hits_v)
        yield qs[q], v


def _lists(pdf, least: float):
    """Adjacency lists of one pair of blocks of one shard, which of the neighbours are links, and whether any is near that: rows (key, nbrs, near, hint)."""
    import pandas as pd

    if len(pdf) < 2:
        return pd.DataFrame({"key": pdf["key"], "nbrs": [[]] * len(pdf), "near": [[]] * len(pdf), "hint": [False] * len(pdf)})
    x, dims = _matrix(pdf["blob"].tolist())
    keys = pdf["key"].to_numpy()
    u, v, s = graph(x, dims if (dims != dims[0]).any() else None)
    # Reverse edges: each edge stands in both lists.
    u, v, s = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([s, s])
    edge, at = np.unique(u * len(x) + v, return_index=True)
    u, v = edge // len(x), edge % len(x)
    hit = (s[at] >= least) & (dims[u] == dims[v])
    cuts = np.searchsorted(u, np.arange(1, len(x)))
    close = np.searchsorted(u[hit], np.arange(1, len(x)))
    hint = np.zeros(len(x), bool)
    hint[u[s[at] >= least - HINT]] = True
    return pd.DataFrame({"key": keys, "nbrs": np.split(keys[v], cuts), "near": np.split(keys[v[hit]], close), "hint": hint})


def _hooked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component under the links a - b."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (root != root[root]).any():
            root = root[root]


def _search(pdf, least: float):
    """Links of the queries that are at home in one pair of blocks of one shard: rows (key, links, root)."""
    import pandas as pd

    pdf = pdf.sort_values("key").reset_index(drop=True)
    lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
    m, home = len(pdf), np.flatnonzero(pdf["home"].to_numpy())
    none = pd.DataFrame({"key": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
    if m < 2 or not len(home):
        return none
    x, dims = _matrix(pdf["blob"].tolist())
    keys, copies, block = pdf["key"].to_numpy(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
    # The united lists, as far as they lead to classes of this task.
    count = np.array([len(n) for n in pdf["nbrs"]])
    u, to = np.repeat(np.arange(m), count), np.concatenate([*pdf["nbrs"], np.empty(0, np.int64)]).astype(np.int64)
    v = np.minimum(np.searchsorted(keys, to), m - 1)
    here = keys[v] == to
    u, v = u[here], v[here]
    off = np.searchsorted(u, np.arange(m + 1))
    start = int((x @ x.mean(0)).argmax())
    links, root = np.zeros(m, np.int64), np.arange(m)
    for q, w in range_search(x, off, v, start, home, least):
        ok = (q != w) & (dims[q] == dims[w]) & (np.minimum(block[q], block[w]) == lo) & (np.maximum(block[q], block[w]) == hi)
        q, w = q[ok], w[ok]
        np.add.at(links, q, copies[w])
        # What this batch links is hooked onto what the earlier ones did.
        root = _hooked(m, np.concatenate([np.arange(m), q]), np.concatenate([root, w]))
    at = np.flatnonzero((links > 0) | (root != np.arange(m)) | np.isin(np.arange(m), root[root != np.arange(m)]))
    return pd.DataFrame({"key": keys[at], "links": links[at], "root": keys[root[at]]}) if len(at) else none


def linked(routed: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(key, links, root) from every task and from the lists; a class has a row for each that found links of it. And (key, near: number of links in its list) of
    the classes whose lists hold anything near the limit."""
    size = staged(routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")), "graph-shards")
    rows = routed.join(small_side(size), "shard").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, F.col("block")).alias("lo"), F.greatest(i, F.col("block")).alias("hi")))
    rows = rows.withColumn("p", F.explode(pairs)).select("key", "blob", "copies", "shard", "home", "block", "p.lo", "p.hi")
    lists = rows.select("key", "blob", "shard", "lo", "hi").groupBy("shard", "lo", "hi").applyInPandas(lambda pdf: _lists(pdf[["key", "blob"]], least), "key long, nbrs array<long>, near array<long>, hint boolean")
    united = lists.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.max("hint").alias("hint"))
    united = staged(united, "graph-lists")
    found = rows.join(united.select("key", "nbrs"), "key").groupBy("shard", "lo", "hi").applyInPandas(lambda pdf: _search(pdf, least), "key long, links long, root long")
    # Links of the lists that lead out of the query's shard.
    at_home = routed.where("home").select("key", F.col("shard").alias("s"))
    near = united.where(F.size("near") > 0).select("key", F.explode("near").alias("to")).join(at_home, "key")
    out = near.join(routed.select(F.col("key").alias("to"), F.col("shard").alias("s")), ["to", "s"], "left_anti")
    out = out.join(routed.where("home").select(F.col("key").alias("to"), "copies"), "to").select("key", F.col("copies").alias("links"), F.col("to").alias("root"))
    return found.union(out), united.where("hint").select("key", F.size("near").alias("near"))


@dataclass(frozen=True)
class Audit:
    """queries: classes that were compared with all; classes: those of them with a true link; links: their true links; recall: mean share of a class's links that
    were found, None if no link was met."""

    queries: int
    classes: int
    links: int
    recall: float | None


def audit(one: DataFrame, links: DataFrame, hinted: DataFrame, least: float) -> Audit:
    """Compare classes with all vectors until ENOUGH links are met. Half of them are drawn from hinted (key, near), half from all; by hash."""
    drawn = AUDIT
    while True:
        by = lambda df, seed, n: df.orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(n).select("key")
        keys_ = by(hinted, 5, drawn // 2).union(by(one, 3, drawn - drawn // 2)).distinct()
        asked = one.join(F.broadcast(keys_), "key").select("key", "blob").toPandas()  # MOST_AUDIT rows at most
        if asked.empty:
            return Audit(0, 0, 0, None)
        q, qd = _matrix(asked["blob"].tolist())
        keys = asked["key"].to_numpy()

        def count(batches: Iterator, q=q, qd=qd, keys=keys) -> Iterator:
            import pyarrow as pa

            total = np.zeros(len(keys), np.int64)
            for batch in batches:
                x, d = _matrix(batch.column("blob").to_pylist())
                w = min(x.shape[1], q.shape[1])
                ok = (q[:, :w] @ x[:, :w].T >= least) & (qd[:, None] == d[None]) & (keys[:, None] != batch.column("key").to_numpy()[None])
                total += ok @ batch.column("copies").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total)], names=["key", "n"])

        true = one.select("key", "blob", "copies").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")
        share = F.least(F.lit(1.0), F.coalesce("links", F.lit(0)) / F.col("n"))
        classes_, met, recall = true.join(links, "key", "left").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.avg(share)).first()
        if met >= ENOUGH or drawn >= MOST_AUDIT or len(asked) < drawn // 2:
            return Audit(len(asked), classes_, met, recall)
        drawn = min(4 * drawn, MOST_AUDIT)


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding)."""
    rows = staged(classes(vectors), "vectors")
    one = staged(rows.where("key IS NOT NULL").groupBy("key").agg(F.first("blob").alias("blob"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")), "vector-classes")
    n = one.count()
    part = int(1_000_000 * min(1.0, SAMPLE / max(n, 1)))  # by hash, so that no task sorts vectors
    x, _ = _matrix(one.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < part).select("key", "blob").toPandas().sort_values("key")["blob"].tolist())
    overlap = OVERLAP
    while True:
        k = max(1, min(MOST_CENTRES, -(-n * overlap // SHARD)))
        centres = medoids(x, min(k, len(x))) if len(x) else np.zeros((1, 1))
        routed = split_large(staged(route(one, centres, overlap), "graph-routes"), overlap)
        found, hinted = linked(routed, least)
        found = staged(found, "graph-links")
        links = staged(found.groupBy("key").agg(F.sum("links").alias("links")), "graph-counts")
        seen = audit(one, links, hinted, least)
        LOG.info("overlap %d: %d classes compared with all, %d of them with %d links, recall %s", overlap, seen.queries, seen.classes, seen.links, seen.recall)
        if seen.recall is None and hinted.where("near > 0").isEmpty():
            LOG.warning("no link was met: nothing is said about recall")
            break
        if seen.recall is not None and seen.recall >= TARGET:
            break
        if overlap >= MOST_OVERLAP:
            raise RuntimeError(f"recall {seen.recall} of {seen.links} audited links is below {TARGET} at an overlap of {overlap}")
        overlap *= 2
        drop_staged(found, links)
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    label = one.select("key", "copies", "least").join(links, "key", "left").join(roots.withColumnRenamed("v", "key"), "key", "left")
    label = staged(label.select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("g")), "vector-labels")
    least_id = staged(label.groupBy("g").agg(F.min("least").alias("component_id")), "vector-components")
    label = staged(label.join(least_id, "g").select("key", "n_links", "component_id"), "vector-labels")
    ids = rows.select("vec_id", "key")
    out = ids.where("key IS NOT NULL").join(label, "key").select("vec_id", "n_links", "component_id")
    rest = ids.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = out.union(rest)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
o AS (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
p AS (SELECT a.rid AS a, b.rid AS b FROM o a JOIN o b ON a.rid <> b.rid AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r(v, u) AS (SELECT rid, rid FROM v UNION SELECT r.v, p.b FROM r JOIN p ON p.a = r.u),
g AS (SELECT v, min(vec_id) AS component_id FROM r JOIN v w ON w.rid = r.u GROUP BY r.v),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v JOIN g ON g.v = v.rid LEFT JOIN n ON n.a = v.rid"""
