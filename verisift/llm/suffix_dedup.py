"""Removal of byte strings that stand anywhere else, by column-wise suffix construction (Spark).

Every 200-byte window of every text has an anchor: its 32-byte gram of least hash, the leftmost of equal ones. The windows of a text that share
an anchor form a piece, and windows of equal content have anchors of equal content at an equal place. So pieces are dealt by
their anchor's hash, and a window's repeats are all in its group, in the same column before the anchor:

1. A piece that occurs twice is repeated as a whole. A group of one piece that occurs once has no repeats.
2. The distinct pieces of any other group are sorted column by column (columns.py): one symbol of each piece is inserted a round, which
   updates the transform and the common prefixes; neighbours that share 200 bytes are repeated there.
3. A group with more than LIMIT distinct pieces is not brought into one task. Its pieces fall into blocks of 16 windows, grouped by the content which all windows of
   a block have in common; groups that are still too large fall into single windows, where equality is all that is left to
   count. Groups that hold a share of the corpus are known from a sample of rows before anything is dealt; the sample decides where rows go and nothing else.

Text is cut out of the documents only for pieces that are compared. Spans of a text are united, and the rest is hashed.

Edge cases: null and empty texts have no bytes; texts under 200 bytes lose nothing; texts that occur twice are removed whole; repeated rows
and null doc_ids count as rows of their own; empty tables give no rows; other columns are not read. Long texts are handled in slices, whose ends cut pieces
but no windows. Pieces are told apart by two 64-bit hashes, of the anchor and of the content; texts by two of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.llm.columns import repeated_columns
from verisift.llm.common import drop_staged, parts, small_batches, small_side, staged, table, text_keys

LENGTH, GRAM = 200, 32
#: Distinct pieces of a group that one task compares, and pieces of a batch there.
LIMIT, BATCH = 4096, 20_000
#: Windows of a block, by round of splitting.
BLOCKS = (16, 1)
#: Rows that the sample takes at most, and the share of them which makes an anchor a hot one.
SAMPLE, SHARE = 4000, 0.01
#: Window starts that are anchored together.
SLICE = 1 << 19
#: A piece's place in one number: start, whether it stands for several, windows, bytes before the anchor.
REPEAT, COMPARE, HOT = range(3)
ROWS = "key long, spread int, h long, k1 long, k2 long, at long"
_EMPTY = hashlib.sha256().hexdigest()


def _at(start, many, windows, lead):
    return (start << 17) | (many << 16) | (windows << 8) | lead


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def _grams(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    h, span = _BYTES[b], 1
    with np.errstate(over="ignore"):
        while span < GRAM:
            m = np.uint64((0xBF58476D1CE4E5B9 * (span + 2)) % (1 << 64) | 1)
            h = h[:-span] * m + h[span:]
            span *= 2
    return _mix(h)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each run of width places."""
    span = 1
    while 2 * span <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (width - span)], keys[width - span :]) if span < width else keys


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of texts data[offsets[i]:offsets[i + 1]]: text, start in data, windows, bytes before the anchor, hash of the anchor."""
    n, out = len(data), []
    for s in range(0, max(n - LENGTH + 1, 0), SLICE):
        b = data[s : s + SLICE + LENGTH - 1]
        count = len(b) - LENGTH + 1
        g = _grams(b)
        keys = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
        anchor = (_least(keys, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)[:count]
        # Windows lie within their text: begins of texts count up, the first start that no window fits behind counts down.
        edge = np.zeros(count + 1, np.int32)
        low = np.searchsorted(offsets, s, "right") - 1
        high = np.searchsorted(offsets, s + count, "left")
        a, z = offsets[low:high] - s, np.maximum(offsets[low + 1 : high + 1] - LENGTH + 1, offsets[low:high]) - s
        fits = z > a
        np.add.at(edge, np.clip(a[fits], 0, count), 1)
        np.add.at(edge, np.clip(z[fits], 0, count), -1)
        valid = np.cumsum(edge[:-1]) > 0
        new = np.ones(count, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], count)
        keep = valid[starts]
        starts, ends = starts[keep], ends[keep]
        out.append((np.searchsorted(offsets, starts + s, "right") - 1, starts + s, ends - starts, anchor[starts] - starts, g[anchor[starts]].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _content(data: memoryview, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as digest

    return np.array([digest(data[s:e]) for s, e in zip(starts.tolist(), (starts + lengths).tolist(), strict=True)], np.uint64).view(np.int64)


def _buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow column of binaries without nulls."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _batch(**columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def texts(docs: DataFrame) -> DataFrame:
    """k1, k2 and the bytes of each text that a window fits into."""
    t = F.coalesce("text", F.lit(""))
    return docs.where(F.octet_length(t) >= LENGTH).select(*text_keys(t), t.cast("binary").alias("body"))


def pieces(of: DataFrame, hot: np.ndarray) -> DataFrame:
    """ROWS of all pieces of texts (k1, k2, body). Texts that come again in a batch are taken once and marked as many. Pieces of hot anchors
    are spread by their text."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            k = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2")])
            _, first, count = np.unique(k, axis=0, return_index=True, return_counts=True)
            data, offsets = _buffers(b.column("body").take(_indices(first)))
            who, start, windows, lead, key = anchored(data, offsets)
            h = _content(memoryview(data), start, windows + LENGTH - 1)
            k = k[first][who]
            spread = np.where(np.isin(key, hot), 1 + k[:, 0] % 64, 0).astype(np.int32)
            yield _batch(key=key, spread=spread, h=h, k1=k[:, 0], k2=k[:, 1], at=_at(start - offsets[who], (count[who] > 1).astype(np.int64), windows, lead))

    return of.mapInArrow(run, ROWS)


def _indices(a: np.ndarray):
    import pyarrow as pa

    return pa.array(a)


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Hashes of anchors that a share of the sampled rows holds. Sampled are SAMPLE rows at most, by hash."""
    rows = docs.count()
    part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(rows, 1))) < SAMPLE)
    seen = pieces(texts(part.withColumn("text", F.coalesce("text", F.lit("")))), np.zeros(0, np.int64))
    # A repeated text counts once a task.
    found = seen.groupBy("key").agg(F.sum(F.lit(1) + F.shiftright("at", 16).bitwiseAND(F.lit(1))).alias("n")).where(F.col("n") >= max(SHARE * min(rows, SAMPLE), 32))
    return np.sort(np.array([r[0] for r in found.select("key").collect()], np.int64))


def settled(rows: DataFrame) -> DataFrame:
    """ROWS to (status, key, h, k1, k2, at): REPEAT for each occurrence of a piece that occurs twice; COMPARE for the first one of each distinct piece of a
    group of several, unless all are repeated; HOT for all of a group that is too large. Staged."""
    dealt = rows.repartition(parts(rows.sparkSession), "key", "spread").sortWithinPartitions("key", "spread", "h", "at")

    def run(batches: Iterator) -> Iterator:
        names = ("key", "spread", "h", "k1", "k2", "at")
        held, hot = None, None

        def told(c, status):
            return _batch(status=status.astype(np.int32), **{n: c[n] for n in names if n != "spread"})

        def groups(c):
            new = np.ones(len(c["key"]), bool)
            new[1:] = (c["key"][1:] != c["key"][:-1]) | (c["spread"][1:] != c["spread"][:-1])
            run = new.copy()
            run[1:] |= c["h"][1:] != c["h"][:-1]
            group, piece = np.cumsum(new) - 1, np.cumsum(run) - 1
            heads = np.flatnonzero(run)
            n = np.bincount(piece, weights=1 + ((c["at"] >> 16) & 1)) >= 2
            kinds = np.bincount(group[heads])
            large = (kinds > LIMIT) | (c["spread"][new] > 0)
            once = np.bincount(group[heads], weights=~n) > 0
            yes = np.flatnonzero(n[piece] & ~large[group])
            compare = heads[(kinds > 1)[group[heads]] & once[group[heads]] & ~large[group[heads]]]
            marked = {m: c[m][compare] for m in names}
            marked["at"] = np.where(n[piece[compare]], marked["at"] | (1 << 16), marked["at"])
            big = np.flatnonzero(large[group])
            for at, status in ((yes, REPEAT), (big, HOT)):
                if len(at):
                    yield told({m: c[m][at] for m in names}, np.full(len(at), status))
            if len(compare):
                yield told(marked, np.full(len(compare), COMPARE))

        for b in batches:
            c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
            if not len(c["key"]):
                continue
            if hot is not None:
                # The rest of a group that was too large to wait for.
                rest = int(np.argmin(np.append((c["key"] == hot[0]) & (c["spread"] == hot[1]), False)))
                if rest:
                    yield told({n: v[:rest] for n, v in c.items()}, np.full(rest, HOT))
                    c = {n: v[rest:] for n, v in c.items()}
                if not len(c["key"]):
                    continue
                hot = None
            if held is not None:
                c = {n: np.concatenate([held[n], c[n]]) for n in names}
            last = (c["key"][-1], c["spread"][-1])
            cut = len(c["key"]) - int(np.argmin(np.append(((c["key"] == last[0]) & (c["spread"] == last[1]))[::-1], False)))
            yield from groups({n: v[:cut] for n, v in c.items()}) if cut else ()
            held = {n: v[cut:] for n, v in c.items()}
            if len(held["key"]) > 16 * LIMIT:
                yield told(held, np.full(len(held["key"]), HOT))
                held, hot = None, last
        if held is not None:
            yield from groups(held)

    return staged(dealt.mapInArrow(run, "status int, key long, h long, k1 long, k2 long, at long"), "suffix-settled")


def fetched(needles: DataFrame, of: DataFrame, held: list[DataFrame]) -> DataFrame:
    """needles (status, key, h, k1, k2, at) with the bytes of their pieces, cut out of the texts. Each text is cut once, however often it occurs."""
    wanted = staged(needles.groupBy("k1", "k2").agg(F.collect_list(F.struct("status", "key", "h", "at")).alias("of")), "suffix-needles")
    held.append(wanted)
    keys = small_side(wanted.select("k1", "k2"), 1_000_000)
    bodies = of.join(keys, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("body").alias("body"))

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            lists = b.column("of")
            who = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
            n = lists.flatten()
            c = {f: n.field(f).to_numpy(zero_copy_only=False) for f in ("status", "key", "h", "at")}
            bodies = [memoryview(x.as_buffer()) for x in b.column("body")]
            cut = [bytes(bodies[w][a >> 17 : (a >> 17) + ((a >> 8) & 255) + LENGTH - 1]) for w, a in zip(who.tolist(), c["at"].tolist(), strict=True)]
            yield _batch(status=c["status"], key=c["key"], h=c["h"], k1=b.column("k1").to_numpy()[who], k2=b.column("k2").to_numpy()[who], at=c["at"], piece=cut)

    return wanted.join(bodies, ["k1", "k2"]).select("k1", "k2", "of", "body").mapInArrow(run, "status int, key long, h long, k1 long, k2 long, at long, piece binary")


def compared(rows: DataFrame) -> DataFrame:
    """k1, k2, from, to (window starts) of the windows of pieces (key, k1, k2, at, piece) that another piece of the group has too."""
    dealt = rows.repartition(parts(rows.sparkSession), "key").sortWithinPartitions("key").select("key", "k1", "k2", "at", "piece")

    def solve(t):
        data, offsets = _buffers(t.column("piece").combine_chunks())
        at = t.column("at").to_numpy()
        lead, begin = at & 255, at >> 17
        i, w = repeated_columns(data, offsets[:-1], np.diff(offsets), lead, LENGTH)
        once = ((at >> 16) & 1)[i] == 0
        i, w = i[once], w[once]
        sort = np.lexsort((w, i))
        i, w = i[sort], w[sort]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1]) | (w[1:] != w[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(i)) - 1
        if len(first):
            o = i[first]
            yield _batch(k1=t.column("k1").to_numpy()[o], k2=t.column("k2").to_numpy()[o], **{"from": begin[o] + w[first], "to": begin[o] + w[last] + 1})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size = [], 0
        for b in batches:
            held.append(pa.Table.from_batches([b]))
            size += len(b)
            if size >= BATCH:
                t = pa.concat_tables(held).combine_chunks()
                keys = t.column("key").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                if cut:
                    yield from solve(t.slice(0, cut).combine_chunks())
                held, size = [t.slice(cut)], size - cut
        if size:
            yield from solve(pa.concat_tables(held).combine_chunks())

    return dealt.mapInArrow(run, "k1 long, k2 long, from long, to long")


def split(rows: DataFrame, width: int) -> DataFrame:
    """ROWS of blocks of `width` windows of pieces (k1, k2, at, piece), keyed by what the windows of a block have in common. Blocks are counted from the
    anchor, so that they are the same in all pieces of a group."""

    def run(batches: Iterator) -> Iterator:
        from xxhash import xxh3_64_intdigest as digest

        for b in batches:
            at = b.column("at").to_numpy()
            out = []
            for r, (a, piece) in enumerate(zip(at.tolist(), b.column("piece"), strict=True)):
                body = memoryview(piece.as_buffer())
                start, many, windows, lead = a >> 17, (a >> 16) & 1, (a >> 8) & 255, a & 255
                for block in range((lead - windows + 1) // width, lead // width + 1):
                    # Windows of the block begin at these places of the piece; the anchor lies block * width to block * width + width - 1 bytes behind.
                    low, high = lead - block * width - width + 1, lead - block * width
                    first, last = max(low, 0), min(high, windows - 1)
                    key = digest(body[max(high, 0) : low + LENGTH], seed=block)
                    out.append((r, key, digest(body[first : last + LENGTH]), _at(start + first, many, last - first + 1, lead - first)))
            if out:
                who, key, h, place = (np.array(c, np.uint64).view(np.int64) for c in zip(*out, strict=True))
                yield _batch(key=key, spread=np.zeros(len(who), np.int32), h=h, k1=b.column("k1").to_numpy()[who], k2=b.column("k2").to_numpy()[who], at=place)

    return rows.select("k1", "k2", "at", "piece").mapInArrow(run, ROWS)


def _windows(rows: DataFrame) -> DataFrame:
    start = F.shiftright("at", 17)
    return rows.select("k1", "k2", start.alias("from"), (start + F.shiftright("at", 8).bitwiseAND(F.lit(255))).alias("to"))


def repeated_windows(docs: DataFrame, held: list[DataFrame]) -> DataFrame:
    """k1, k2, from, to: ranges of window starts of each text at which a string begins that begins anywhere else too. Ranges may meet and come again. held
    takes the staged tables that the result is read from."""
    of = texts(docs)
    rows, found = pieces(of, hot_anchors(docs)), []
    for width in (*BLOCKS, None):
        s = settled(rows)
        held.append(s)
        found.append(_windows(s.where(F.col("status") == REPEAT)))
        needles, hot = s.where(F.col("status") == COMPARE), s.where(F.col("status") == HOT)
        more = width is not None and not hot.isEmpty()
        if not hot.isEmpty():
            many = F.col("at").bitwiseAND(F.lit(1 << 16)) != 0
            kinds = staged(hot.groupBy("key", "h").agg((F.sum(F.when(many, 2).otherwise(1)) > 1).alias("again"), F.min(F.struct("k1", "k2", "at")).alias("e")), "suffix-hot")
            held.append(kinds)
            twice = small_side(kinds.where("again").select("key", "h"), 1_000_000)
            found.append(_windows(hot.join(twice, ["key", "h"], "left_semi")))
            at = F.col("e.at").bitwiseAND(F.lit(~(1 << 16))).bitwiseOR(F.when(F.col("again"), 1 << 16).otherwise(0).cast("long"))
            if more:
                needles = needles.unionByName(kinds.select(F.lit(HOT).alias("status"), "key", "h", "e.k1", "e.k2", at.alias("at")))
        if needles.isEmpty():
            break
        cut = staged(fetched(needles, of, held), "suffix-pieces")
        same = staged(compared(cut.where(F.col("status") == COMPARE)), "suffix-compared")
        held += [cut, same]
        found.append(same)
        if not more:
            break
        rows = split(cut.where(F.col("status") == HOT), width)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    t = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(t), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t.cast("binary"), 256).alias("sha"))
    held: list[DataFrame] = []
    ranges = repeated_windows(docs, held)
    again = staged(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2"), "suffix-copies")
    # Texts that occur twice go whole; for the rest each range of windows covers LENGTH - 1 bytes more.
    cover = F.sort_array(F.collect_set(F.struct("from", "to")))
    spans = staged(ranges.join(small_side(again, 1_000_000), ["k1", "k2"], "left_anti").groupBy("k1", "k2").agg(cover.alias("spans")), "suffix-spans")
    bodies = texts(docs).join(small_side(spans.select("k1", "k2"), 1_000_000), ["k1", "k2"], "left_semi")

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            out = []
            lists = b.column("spans")
            bounds, flat = lists.offsets.to_numpy(), lists.flatten()
            low, high = flat.field("from").to_numpy(zero_copy_only=False), flat.field("to").to_numpy(zero_copy_only=False) + LENGTH - 1
            bounds = bounds - bounds[0]
            for k, body in enumerate(b.column("body")):
                body = memoryview(body.as_buffer())
                a, z = low[bounds[k] : bounds[k + 1]], np.maximum.accumulate(high[bounds[k] : bounds[k + 1]])
                new = np.ones(len(a), bool)
                new[1:] = a[1:] > z[:-1]
                a, z = a[new], z[np.append(np.flatnonzero(new)[1:], len(z)) - 1]
                sha, at = hashlib.sha256(), 0
                for s, e in zip(a.tolist(), z.tolist(), strict=True):
                    sha.update(body[at:s])
                    at = e
                sha.update(body[at:])
                out.append((int((z - a).sum()), len(a), sha.hexdigest()))
            if out:
                removed, n, sha = zip(*out, strict=True)
                yield _batch(k1=b.column("k1").to_numpy(), k2=b.column("k2").to_numpy(), removed=list(removed), spans=list(n), kept=list(sha))

    cut = bodies.join(spans, ["k1", "k2"]).select("k1", "k2", "body", "spans").mapInArrow(run, "k1 long, k2 long, removed long, spans long, kept string")
    cut = staged(cut, "suffix-kept").select("k1", "k2", "removed", F.col("spans").alias("parts"), "kept")
    drop_staged(*held, spans)
    j = rows.join(small_side(cut, 1_000_000), ["k1", "k2"], "left").join(small_side(again.withColumn("whole", F.lit(True)), 1_000_000), ["k1", "k2"], "left")
    whole = F.coalesce("whole", F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    return j.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"), F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("parts", zero)).alias("n_spans"),
        F.when(whole, _EMPTY).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: All 200-byte strings of all texts, as hexadecimal digits; ranges of repeated ones are united and cut out.
SQL = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, unnest(range(0, (length(x) // 2 - {LENGTH - 1})::BIGINT)) AS i, x FROM d WHERE length(x) >= {2 * LENGTH}),
s AS MATERIALIZED (SELECT r, i, md5_number(substr(x, 2 * i + 1, {2 * LENGTH})) AS k FROM w),
dup AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
m AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) > {LENGTH} IS NOT FALSE AS fresh FROM s SEMI JOIN dup USING (k)),
g AS (SELECT r, i, sum(fresh::INT) OVER (PARTITION BY r ORDER BY i) AS g FROM m),
p AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS z FROM g GROUP BY r, g),
q AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS prev FROM p),
o AS (SELECT d.r, count(*) AS n, sum(z - a)::BIGINT AS gone, string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS kept FROM q JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN o USING (r)"""
