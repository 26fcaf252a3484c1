"""N-gram Jaccard join of whole texts: rare-first prefix filter, length, positional and suffix
filters, each surviving pair verified once on the full sets, then components of the links.

1. Every text gives the set of its distinct 5-word shingles (64-bit hashes) and the set's key. Texts with
   equal sets are one class from here on. Each task also counts its shingles in a fixed number of
   buckets; the summed counts order all shingles rare-first (by bucket count, then hash).
2. A set of n shingles can only reach similarity t with a set that shares k of its first n - ceil(t n) + k
   shingles, so these prefixes are what is joined, with k a twentieth of the least overlap. Within a task
   a set is emitted once, so copies do not pile up on their shingles.
3. In a few rounds each class tries one partner: the set that leads most of its prefix shingles, where a shingle's leader is the most
   central set that has it. Most sets of a near-copy group find the same pivot, and those that link with it are settled.
4. From here on a pivot stands for its cluster: the sets that link with it, and those near it that do not. A set meets a cluster, not
   its members, when it shares k prefix shingles with them and passes length and positional filters. Every such pair is verified by the suffix filter
   and the exact intersection.
5. Within a cluster, and for the sets that met it, what remains are pairs of which one does not link with the pivot. They are found by a
   second prefix filter, on the sets' differences to the pivot (see differences), and verified. Nothing is capped.

Edge cases: null and empty texts have an empty set and link with nothing; texts of fewer than five words are one
shingle; null doc_ids take part, but never name a component that has another id; rows that share a doc_id
are rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.llm.common import drop_staged, small_batches, small_side, staged, table
from verisift.llm.components import components
from verisift.llm.spans import mix, prefix_sums, span_hashes
from verisift.llm.tokens import chunks

WORDS = 5
#: Similarity as a fraction: links have NUM / DEN or more.
NUM, DEN = 75, 100
#: Buckets of the frequency counts that order shingles: 256 Ki counters, the same for any input.
BITS = 18
#: Prefixes are longer by 1 / MORE of the least overlap, and a pair must share so many more of their shingles.
MORE = 20
#: Most rounds of single partners before the pass over clusters.
ROUNDS = 3
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_STEP = mix(np.arange(1, WORDS + 2, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes | None], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text."""
    low = [(t or b"").lower() for t in texts]
    data = np.frombuffer(b" ".join([*low, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in low])
    word = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = span_hashes(prefix_sums(data, a), a, b)
    bounds = np.concatenate([[0], np.searchsorted(a, ends)])
    n = len(h)
    with np.errstate(over="ignore"):
        full = np.zeros(max(n - k + 1, 0), np.uint64)
        for j in range(k):
            full += h[j : n - k + 1 + j] * _STEP[j]
        full = mix(full)
        out = []
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if j - i >= k:
                out.append(np.unique(full[i : j - k + 1]))
            elif j > i:
                out.append(mix(np.array([(h[i:j] * _STEP[: j - i]).sum() + _STEP[k] * np.uint64(j - i)], np.uint64)))
            else:
                out.append(h[:0])
    return out


def set_key(s: np.ndarray) -> int:
    """Key of a set: equal for equal sets."""
    with np.errstate(over="ignore"):
        m = mix(s + np.uint64(0x632BE59BD9B4E019))
        return int(mix(np.array([m.sum() * np.uint64(3) ^ np.bitwise_xor.reduce(mix(m)) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def shared_least(n):
    """Prefix shingles that a set of n shares with any partner of its size or larger. Works on ints and arrays."""
    return -(-(-(-NUM * n // DEN)) // MORE)


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + shared_least(n)


def _binary(batch, column: str = "text") -> list:
    import pyarrow as pa

    return batch.column(column).cast(pa.binary()).to_pylist()


def signatures(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tkey, n, vid) of every row, and the shingle counts by bucket."""

    def signed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = np.zeros(1 << BITS, np.int64)
        for batch in chunks(batches):
            sets = shingle_sets(_binary(batch))
            counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS) if sets else 0
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tkey"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
                names=["doc_id", "tkey", "n", "vid", "counts"],
            )
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.array([counts], pa.list_(pa.int64()))],
            names=["doc_id", "tkey", "n", "vid", "counts"],
        )

    got = staged(docs.mapInArrow(signed, "doc_id long, tkey long, n long, vid long, counts array<long>"), "jaccard-signatures")
    summed = got.where("n < 0").select(F.posexplode("counts").alias("bucket", "c")).where("c > 0").groupBy("bucket").agg(F.sum("c").alias("c"))
    return got.where("n >= 0").drop("counts"), staged(summed, "jaccard-counts")


def prefixes(docs: DataFrame, order: np.ndarray) -> DataFrame:
    """(tok, vid, n, pos): the prefix shingles of every set, once for each task."""

    def emit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for batch in chunks(batches):
            toks, vids, sizes, places = [], [], [], []
            for s in shingle_sets(_binary(batch)):
                n = len(s)
                if not n or (vid := set_key(s)) in seen:
                    continue
                seen.add(vid)
                p = prefix_length(n)
                first = np.lexsort((s, order[(s >> np.uint64(64 - BITS)).astype(np.int64)]))[:p]
                toks.append(s[first])
                vids.append(np.full(p, vid))
                sizes.append(np.full(p, n, np.int32))
                places.append(np.arange(p, dtype=np.int32))
            if toks:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(toks).view(np.int64)), pa.array(np.concatenate(vids)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))],
                    names=["tok", "vid", "n", "pos"],
                )

    return docs.select("text").mapInArrow(emit, "tok long, vid long, n int, pos int")


def shared_postings(raw: DataFrame) -> DataFrame:
    """(tok, vid, n, pos, c): postings of shingles that stand in the prefix of two sets or more, one for each set, with the
    number of these sets. raw should be staged. Counts combine before they are shuffled, and a hot shingle's rows meet its count in
    a join, which the engine can split."""
    some = raw.groupBy("tok").agg(F.min("vid").alias("lo"), F.max("vid").alias("hi")).where("lo < hi").select("tok")
    # One set may come from several tasks.
    posts = staged(raw.join(some, "tok", "left_semi").groupBy("tok", "vid").agg(F.first("n").alias("n"), F.first("pos").alias("pos")), "jaccard-shared")
    return posts.join(posts.groupBy("tok").agg(F.count(F.lit(1)).alias("c")), "tok")


def sets_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(vid, hashes) of the texts whose key is in needed (tkey)."""

    def emit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for batch in chunks(batches):
            vids, data = [], []
            for s in shingle_sets(_binary(batch)):
                if len(s) and (vid := set_key(s)) not in seen:
                    seen.add(vid)
                    vids.append(vid)
                    data.append(s.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(vids, pa.int64()), pa.array(data, pa.binary())], names=["vid", "hashes"])

    texts = docs.select("tkey", "text").join(small_side(needed, 200_000), "tkey", "left_semi").select("text")
    return texts.mapInArrow(emit, "vid long, hashes binary").groupBy("vid").agg(F.first("hashes").alias("hashes"))


def _measure(x: np.ndarray, y: np.ndarray) -> tuple[int, bool]:
    """Shared hashes (-1: too few, by the suffix filter) of sorted distinct hashes, and whether the sets link."""
    n = len(x) + len(y)
    cuts = x[len(x) // 8 :: max(1, len(x) // 8)]
    px = np.diff(np.searchsorted(x, cuts), prepend=0, append=len(x))
    py = np.diff(np.searchsorted(y, cuts), prepend=0, append=len(y))
    most = int(np.minimum(px, py).sum())
    if (NUM + DEN) * most < NUM * n and most < len(x) // 2:
        return -1, False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both, DEN * both >= NUM * (n - both)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x = sets.select(F.col("vid").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("vid").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(x, "a").join(y, "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, ok) of the pairs (a, b)."""

    def test(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            xs, ys = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            got = [_measure(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(xs, ys, strict=True)]
            both, ok = pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), both, ok], names=["a", "b", "both", "ok"])

    return _with_sets(pairs.select("a", "b"), sets).select("a", "b", "x", "y").mapInArrow(test, "a long, b long, both int, ok boolean")


def votes(posts: DataFrame, score: DataFrame) -> DataFrame:
    """(a, b, k): the set b that leads most of a's prefix shingles, and how many. A shingle's leader is the set with the highest
    score among those that have it in their prefix. posts: tok, vid, n, prio; score: vid, n, prio."""
    lead = posts.groupBy("tok").agg(F.max("prio").alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1").select("tok", "lead")
    each = posts.join(lead, "tok").groupBy("vid", "n", "prio", "lead").agg(F.count(F.lit(1)).alias("k"))
    best = each.groupBy("vid", "n", "prio").agg(F.max(F.struct("k", "lead")).alias("m")).where("m.lead <> prio")
    b = score.dropDuplicates(["prio"]).select(F.col("vid").alias("b"), F.col("n").alias("nb"), F.col("prio").alias("lead"))
    best = best.select(F.col("vid").alias("a"), "n", F.col("m.k").alias("k"), F.col("m.lead").alias("lead")).join(b, "lead")
    return best.where((DEN * F.least("n", "nb") >= NUM * F.greatest("n", "nb")) & (F.col("k") >= _shared_least(F.least("n", "nb")))).select("a", "b")


def _shared_least(n: Column) -> Column:
    return F.ceil(F.ceil(n * NUM / DEN) / MORE)


def crossings(posts: DataFrame, cl: DataFrame) -> DataFrame:
    """(a, b, multi): sets a and clusters b (named by their pivot) that a is not in, of which some member may link with a. Of two clusters the
    sets of the smaller one are tried. posts: tok, vid, n, pos; cl: vid, cl, size."""
    p = posts.join(cl, "vid", "left").select("tok", "vid", "n", "pos", F.coalesce("cl", "vid").alias("cl"), F.coalesce("size", F.lit(1)).alias("size"))
    p = staged(p, "jaccard-clustered")
    # All members of a cluster that have a shingle are one row from here on.
    g = p.groupBy("tok", "cl", "size").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("pos").alias("ph"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    g = g.select("tok", F.col("cl").alias("q"), F.col("size").alias("qsize"), "lo", "hi", "ph", "rest")
    larger = (F.col("qsize") > F.col("size")) | ((F.col("qsize") == F.col("size")) & (F.col("q") > F.col("cl")))
    fits = (DEN * F.col("hi") >= NUM * F.col("n")) & (NUM * F.col("lo") <= DEN * F.col("n"))
    # Positional filter: what can be shared before, at and after this shingle, against the least overlap that the similarity needs.
    most = F.least("pos", "ph") + F.least(F.col("n") - F.col("pos"), F.col("rest"))
    hits = p.join(g, "tok").where(larger & fits & ((NUM + DEN) * most >= NUM * (F.col("n") + F.greatest(F.col("lo"), F.ceil(F.col("n") * NUM / DEN)))))
    found = hits.groupBy("vid", "n", "q", "qsize").agg(F.count(F.lit(1)).alias("k"), F.min("lo").alias("lo"))
    least = _shared_least(F.least("n", F.greatest(F.col("lo"), F.ceil(F.col("n") * NUM / DEN))))
    return found.where(F.col("k") >= least).select(F.col("vid").alias("a"), F.col("q").alias("b"), (F.col("qsize") > 1).alias("multi"))


def differences(pairs: DataFrame, sets: DataFrame, order: np.ndarray) -> DataFrame:
    """Each set a against the pivot b of a cluster. The pair's own row has (both, ok). If the cluster has more members (multi), further rows hold the
    prefix of a's difference to b, rare-first: (tok, pos), the cost c, the difference's size d, and the lengths of the prefix as the lighter and as the heavier
    of two sets.

    With D = b without a, A = a without b, two sets share |b| - |D| - |D'| + |D and D'| + |A| shared with A', so they link only if their differences
    share (c + c' - |b|) / 7 or more, where c = 4|D| + 3|A|; c <= |b| exactly if a links with b. Sets that both link with b are of one component, so a linked set
    needs partners of c > |b| alone, and its prefix holds little but its own additions, however many sets stand round one pivot."""

    def delta(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int32()), ("ok", pa.bool_()), ("own", pa.bool_()), ("n", pa.int32()), ("nb", pa.int32()), ("c", pa.int32()), ("d", pa.int32()), ("light", pa.int32()), ("heavy", pa.int32()), ("tok", pa.int64()), ("pos", pa.int32())])
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in kind}
            for a, b, own, multi, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "own", "multi", "x", "y")), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if not multi:
                    both, ok = _measure(x, y)
                    toks, rest = np.empty(0, np.uint64), (0, 0, 0, 0)
                else:
                    add, gone = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
                    both = len(x) - len(add)
                    ok = DEN * both >= NUM * (len(y) + len(add))
                    c, d = 4 * len(gone) + 3 * len(add), len(gone) + len(add)
                    over = c - len(y)
                    light = max(0, d + 1 - (-(-(c + 1) // 7) if over <= 0 else -(-(c + over) // 7)))
                    heavy = max(0, d + 1 - -(-over // 4)) if over > 0 else 0
                    all_ = np.concatenate([add, gone])
                    often = order[(all_ >> np.uint64(64 - BITS)).astype(np.int64)]
                    often[len(add) :] = (1 << 62) - often[len(add) :]  # what many sets have, few lack
                    toks = all_[np.lexsort((all_, often))[: max(light, heavy)]]
                    rest = (c, d, light, heavy)
                for name, v in zip(("a", "b", "both", "ok", "own", "n", "nb", "c", "d", "light", "heavy"), (a, b, both, ok, own, len(x), len(y), *rest), strict=True):
                    out[name] += [v] * (1 + len(toks))
                out["tok"] += [None, *toks.view(np.int64).tolist()]
                out["pos"] += range(-1, len(toks))
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in kind], schema=kind)

    cols = "a long, b long, both int, ok boolean, own boolean, n int, nb int, c int, d int, light int, heavy int, tok long, pos int"
    return _with_sets(pairs, sets).select("a", "b", "own", "multi", "x", "y").mapInArrow(delta, cols)


def near_differences(deltas: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): pairs of different components whose differences to one pivot pass the prefix, positional and length filters."""
    names = ["vid", "own", "n", "c", "d", "pos"]
    r = roots.select(F.col("v").alias("vid"), "root")
    rows = deltas.where("tok IS NOT NULL").withColumnRenamed("a", "vid").join(small_side(r, 200_000), "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    heavy = rows.where("pos < heavy").select("b", "tok", "nb", *[F.col(x).alias(f"{x}1") for x in [*names, "root"]])
    light = rows.where("pos < light").select("b", "tok", *[F.col(x).alias(f"{x}2") for x in [*names, "root"]])
    j = heavy.join(light, ["b", "tok"]).where(
        "root1 <> root2 AND (own1 OR own2) AND (c2 < c1 OR (c2 = c1 AND vid2 < vid1))"
        f" AND {DEN} * least(n1, n2) >= {NUM} * greatest(n1, n2)"
        " AND 7 * (least(pos1, pos2) + least(d1 - pos1, d2 - pos2)) >= c1 + c2 - nb"
    )
    return j.select(F.least("vid1", "vid2").alias("a"), F.greatest("vid1", "vid2").alias("b")).distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, n, vid, component_id, group_id of every row (group_id: the component's own key, null without words)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")
    sig, counts = signatures(docs)
    order = np.zeros(1 << BITS, np.int64)
    for r in counts.toLocalIterator():  # at most 2**BITS rows
        order[r["bucket"]] = r["c"]
    raw = staged(prefixes(docs, order), "jaccard-prefixes")
    posts = staged(shared_postings(raw), "jaccard-postings")
    # A set that stands amid others has many shingles that many have; the low bits tell sets apart.
    weight = F.least(F.lit((1 << 20) - 1), F.round(16 * F.sum(F.log2("c")))).cast("long")
    score = staged(posts.groupBy("vid", "n").agg((F.shiftleft(weight, 43) + F.pmod("vid", F.lit(1 << 43))).alias("prio")), "jaccard-scores")
    live = staged(posts.select("tok", "vid", "n", "pos").join(score.select("vid", "prio"), "vid"), "jaccard-live")
    drop_staged(raw, posts)

    held: list[DataFrame] = []

    def sets(ends: DataFrame) -> DataFrame:
        """The sets of the classes in ends (vid); those that were fetched before are not made again."""
        ends = ends.distinct()
        for h in held:
            ends = ends.join(h.select("vid"), "vid", "left_anti")
        needed = staged(sig.where("n > 0").join(ends, "vid", "left_semi").groupBy("vid").agg(F.min("tkey").alias("tkey")).select("tkey"), "jaccard-needed")
        if not held or not needed.isEmpty():
            held.append(staged(sets_of(docs, needed), "jaccard-sets"))
        drop_staged(needed)
        return functools.reduce(DataFrame.union, held)

    # Rounds of one partner for each set: first all sets, then those that found no link and led none.
    now, tests = live, []
    for _ in range(ROUNDS):
        pairs = staged(votes(now, score), "jaccard-votes")
        done = staged(verified(pairs, sets(pairs.select(F.col("a").alias("vid")).union(pairs.select("b")))), "jaccard-tested")
        n, hits = done.agg(F.count(F.lit(1)), F.count_if("ok")).first()
        tests.append(done)
        if hits * 20 <= n:
            break
        linked = done.where("ok")
        now = now.join(linked.select(F.col("a").alias("vid")).union(linked.select("b")).distinct(), "vid", "left_anti")
    tested = functools.reduce(DataFrame.union, [t.withColumn("turn", F.lit(i)) for i, t in enumerate(tests)])

    # Clusters: a pivot, the sets that link with it, and those that share half of their shingles with it and found no better place.
    near = staged(tested.join(score.select(F.col("vid").alias("a"), "n"), "a").where("ok OR 2 * both >= n"), "jaccard-near")
    pivots = near.select(F.col("b").alias("vid")).distinct()
    placed = near.groupBy(F.col("a").alias("vid")).agg(F.min(F.struct((~F.col("ok")).alias("z"), "turn", "b")).alias("m"))
    placed = placed.select("vid", F.col("m.b").alias("cl"), F.col("m.z").alias("z")).join(pivots, "vid", "left_anti")
    placed = staged(placed, "jaccard-placed")
    size = placed.groupBy("cl").agg((F.count(F.lit(1)) + 1).alias("size"), F.max("z").alias("z"))
    size = staged(size, "jaccard-sizes")
    cl = placed.join(size.drop("z"), "cl").select("vid", "cl", "size").union(size.select("cl", "cl", "size"))
    cross = staged(crossings(live, staged(cl, "jaccard-clusters")), "jaccard-crossings")
    once = tested.select("a", "b", F.lit(False).alias("multi"))
    fresh = cross.join(once, ["a", "b", "multi"], "left_anti").select("a", "b", "multi", F.lit(False).alias("own"))
    # Members are compared with their pivot where another set may link with some of them.
    open_ = size.where("z").select("cl").union(cross.where("multi").select("b")).distinct()
    own = placed.join(open_, "cl", "left_semi").select(F.col("vid").alias("a"), F.col("cl").alias("b"), F.lit(True).alias("multi"), F.lit(True).alias("own"))
    todo = staged(fresh.union(own), "jaccard-todo")
    deltas = staged(differences(todo, sets(todo.select(F.col("a").alias("vid")).union(todo.select("b"))), order), "jaccard-differences")
    links = tested.where("ok").select("a", "b").union(deltas.where("ok AND tok IS NULL").select("a", "b"))
    roots = components(links)
    more = staged(near_differences(deltas, roots), "jaccard-more")
    second = staged(verified(more, sets(more.select(F.col("a").alias("vid")).union(more.select("b")))), "jaccard-tested")
    roots = components(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).union(second.where("ok").select("a", "b")))
    drop_staged(live, score, near, cross, todo, deltas, more, second, placed, size, *tests, *held)

    each = staged(sig.where("n > 0").groupBy("vid").agg(F.min("doc_id").alias("least")), "jaccard-classes")
    g = each.join(roots.withColumnRenamed("v", "vid"), "vid", "left").select("vid", "least", F.coalesce("root", "vid").alias("group_id"))
    g = staged(g, "jaccard-groups")
    least = g.groupBy("group_id").agg(F.min("least").alias("component_id"))
    label = staged(g.select("vid", "group_id").join(least, "group_id"), "jaccard-labels")
    linked = sig.where("n > 0").join(label, "vid").select("doc_id", "tkey", "n", "vid", "component_id", "group_id")
    alone = sig.where("n = 0").select("doc_id", "tkey", "n", "vid", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group_id"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, one of each group: that with the least doc_id (then text key). Rows without words all stay."""
    got = staged(classes(docs), "jaccard-rows")
    best = got.where("group_id IS NOT NULL").groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tkey")).alias("m"))
    null = F.lit(-(1 << 63)).cast("long")
    key = [F.coalesce("doc_id", null).alias("_d"), F.col("tkey").alias("_t")]
    mine = best.select("group_id", F.coalesce("m.doc_id", null).alias("d"), F.col("m.tkey").alias("t"))
    rows = got.where("group_id IS NOT NULL").select("group_id", *key).join(mine, "group_id")
    gone = staged(rows.where("_d <> d OR _t <> t").select("_d", "_t").distinct(), "jaccard-gone")
    # The rows of a kept text that repeats under its own id.
    twice = staged(rows.where("_d = d AND _t = t").groupBy("_d", "_t").count().where("count > 1").select("_d", "_t"), "jaccard-twice")
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), null).alias("_d"), F.xxhash64("text").alias("_t"))
    held = held.join(small_side(gone, 1_000_000), ["_d", "_t"], "left_anti")
    if twice.isEmpty():
        return held.select("_row.*")
    again = small_side(twice, 1_000_000)
    single = held.join(again, ["_d", "_t"], "left_anti").select("_row")
    return single.union(held.join(again, ["_d", "_t"], "left_semi").dropDuplicates(["_d", "_t"]).select("_row")).select("_row.*")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = classes(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, x FROM (SELECT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d)),
k AS (SELECT rid, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY x)) AS cls FROM s GROUP BY rid),
c AS (SELECT cls, min(rid) AS rep, min(n) AS n FROM k GROUP BY cls),
t AS (SELECT rep, n, x FROM c JOIN s ON s.rid = c.rep),
p AS (SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 175 * count(*) >= 75 * (a.n + b.n)),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(v, u) AS (SELECT rep, rep FROM c UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
g AS (SELECT v, min(u) AS root FROM r GROUP BY v),
m AS (SELECT k.rid, k.n, g.root FROM k JOIN c USING (cls) JOIN g ON g.v = c.rep),
l AS (SELECT root, min(doc_id) AS component_id FROM m JOIN d USING (rid) GROUP BY root)
SELECT d.doc_id, coalesce(m.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id FROM d LEFT JOIN m USING (rid) LEFT JOIN l USING (root)"""
