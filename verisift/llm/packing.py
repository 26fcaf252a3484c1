"""Best-fit packing of documents into sequences, with Martello-Toth dominance reduction.

Pieces of one length are interchangeable, so the instance is a histogram with one count for each
length up to the sequence's size; it stays that small however many documents there are. The driver
plans on that histogram: sets of pieces that provably dominate every alternative are fixed first,
the remainder is packed best-fit, longest first. A plan is a list of patterns (lengths in one
sequence) with multiplicities. Every piece then finds its sequence by its rank among the pieces of its
length: a local rank in its task plus the counts of the tasks before it.

Edge cases: null and empty texts are one piece with the end id; rows that share a doc_id are packed
each on its own; a text longer than a sequence is cut into full pieces, a shorter piece
first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verisift.llm.common import small_batches, small_side, staged, table
from verisift.llm.tokens import chunks, default_tokenizer, token_ids

PIECES = "part int, doc_id long, piece int, start long, length int, ids_crc32 long, local long"


def reduce_dominated(h: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets; h[s] pieces of length s (changed in place), len(h) - 1 the size of a sequence.

    For the longest piece j and the room c beside it, a set holding j dominates all others if
    it is {j} and nothing fits; {j, k} where k fills c exactly; {j, k} where k is the longest that
    fits and no two pieces fit together; {j, k} where k is at least as long as any two that fit and no three fit, or
    all others that fit are no longer than k together, since they could then stand in its place. Pieces that no rule fixes are left for best fit.
    """
    size = len(h) - 1
    fixed = []
    for j in range(size, 0, -1):
        while h[j]:
            c = size - j
            h[j] -= 1  # one j is set aside while looking for its partners
            fits = np.flatnonzero(h[: c + 1])
            if not fits.size:
                n, found = h[j] + 1, (j,)
            else:
                k = int(fits[-1])
                two = _best_two(h, fits, c)
                if k == c or two is None or (two <= k and _no_more(h, fits, c)):
                    n = (h[j] + 1) // 2 if k == j else min(h[j] + 1, h[k])
                    found = (j, k)
                    if k != j and h[k] <= 2 and k < c and two is not None:
                        n = 1  # the two longest may have used both: look again each time
                else:
                    h[j] += 1
                    break
            h[j] += 1
            n = int(n)
            for s in found:
                h[s] -= n
            fixed.append((found, n))
    return fixed


def _no_more(h: np.ndarray, fits: np.ndarray, c: int) -> bool:
    """Whether no three pieces fit into c, or all that fit but the longest are no longer than it together."""
    least = np.repeat(fits[:3], np.minimum(h[fits[:3]], 3))[:3]
    k = int(fits[-1])
    return len(least) < 3 or int(least.sum()) > c or int((fits * h[fits]).sum()) - k <= k


def _best_two(h: np.ndarray, fits: np.ndarray, c: int) -> int | None:
    """The greatest sum of two pieces that is at most c; None if no two fit."""
    lo, hi, best = 0, len(fits) - 1, None
    while lo <= hi:
        a, b = int(fits[lo]), int(fits[hi])
        if a + b > c:
            hi -= 1
        elif lo == hi and h[a] < 2:
            break
        else:
            best = max(best or 0, a + b)
            lo += 1
    return best


def best_fit(h: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: equal open sequences are handled together."""
    size = len(h) - 1
    done: list[tuple[tuple[int, ...], int]] = []
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # room left -> pattern -> sequences

    def put(room: int, pattern: tuple[int, ...], n: int) -> None:
        if n:
            d = open_[room]
            d[pattern] = d.get(pattern, 0) + n

    for s in range(size, 0, -1):
        left = int(h[s])
        if not left:
            continue
        for room in sorted(r for r in open_ if r >= s and open_[r]):
            if not left:
                break
            for pattern in list(open_[room]):
                if not left:
                    break
                n = open_[room].pop(pattern)
                q = room // s  # best fit stays with a sequence until nothing more fits
                full = min(n, left // q)
                put(room - q * s, pattern + (s,) * q, full)
                left -= full * q
                n -= full
                if n and left:
                    put(room - left * s, pattern + (s,) * left, 1)
                    left, n = 0, n - 1
                put(room, pattern, n)
        if left:
            q = size // s
            full, rest = divmod(left, q)
            put(size - q * s, (s,) * q, full)
            if rest:
                put(size - rest * s, (s,) * rest, 1)
        done += open_.pop(0, {}).items()
    return done + [x for d in open_.values() for x in d.items()]


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    h = np.zeros(size + 1, np.int64)
    for s, n in counts.items():
        h[s] = n
    return reduce_dominated(h) + best_fit(h)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the runs of its pieces: first rank, first sequence, offset."""
    out: dict[int, list] = defaultdict(list)
    seen: dict[int, int] = defaultdict(int)
    first = 0
    for pattern, n in patterns:
        offset = 0
        for s in pattern:
            out[s].append((seen[s], first, offset))
            seen[s] += n
            offset += s
        first += n
    return {s: np.array(x, np.int64) for s, x in out.items()}


def cut(docs: DataFrame, size: int, tokenizer: str, end_id: int) -> DataFrame:
    """The pieces of all documents with their rank among this task's pieces of the same length."""

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids = token_ids(tokenizer, end_id)
        seen = [0] * (size + 1)
        for batch in chunks(batches):
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for d, x in zip(batch.column("doc_id").to_pylist(), ids.encode(texts), strict=True):
                x = x.astype("<u4")
                head = (len(x) - 1) % size + 1
                a, b, k = 0, head, 0
                while a < len(x):
                    rows.append((part, d, k, a, b - a, zlib.crc32(x[a:b].tobytes()), seen[b - a]))
                    seen[b - a] += 1
                    a, b, k = b, b + size, k + 1
            cols = zip(*rows, strict=True)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            names = ["part", "doc_id", "piece", "start", "length", "ids_crc32", "local"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def pack_documents(docs: DataFrame, size: int = 1024, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    made = staged(cut(docs, size, tokenizer or default_tokenizer(), end_id), "pieces")
    per_task = made.groupBy("part", "length").agg(F.max("local").alias("n")).withColumn("n", F.col("n") + 1)
    before = staged(
        per_task.select("part", "length", "n", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")), "piece-ranks"
    )
    # One row for each length, of which there are `size` at most.
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = slots(plan(counts, size))
    ranked = made.join(small_side(before.select("part", "length", "before")), ["part", "length"])

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for s in np.unique(length).tolist():
                m = np.flatnonzero(length == s)
                runs = where[s]
                at = np.searchsorted(runs[:, 0], rank[m], side="right") - 1
                seq[m] = runs[at, 1] + rank[m] - runs[at, 0]
                off[m] = runs[at, 2]
            cols = [batch.column(c) for c in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(length, pa.int64()), batch.column("ids_crc32"), pa.array(seq), pa.array(off)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank")).mapInArrow(place, out)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
