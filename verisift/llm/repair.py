"""Re-Pair grammars over token ids, and a file format with random access to documents.

A shard's ids are compressed by rounds: each round counts all neighbouring pairs, makes a
rule for every pair that is frequent enough, most frequent first, and replaces its
occurrences. Rounds go on, with lower and lower counts, until no pair is left whose rule would save more bytes than
it takes; that count is the same for every size of shard. Where 16 bits run out, rounds go on with wide symbols, and the
shorter form is kept. Rules never reach over the end of a document. The shard stores the rules,
their expansion lengths, the compressed symbols and, for each document, where its symbols and
its ids begin, so that one document (or a span of it) is decoded without the others.

Layout (little-endian): magic "RPG1", u8 bytes per symbol (2 or 4), u32 first nonterminal, u32
rules, u32 documents, u64 symbols, u64 ids; then left and right of the rules (u32 each), their
expansion lengths (u32), document ids (i64) with a null mask (u8), symbol offsets and id offsets
(u64, one more than documents), symbols.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"RPG1"
HEAD = struct.Struct("<4sBIIIQQ")
#: Buckets of the counting filter in front of the exact counts.
_BINS = 19
#: A first round's rules occur at least so often for each million symbols; then half as often from round to round.
ROUNDS = (2000, 500, 150, 60)
#: Bytes of a rule: left, right and expansion length.
RULE = 12
#: Symbols stay below this as long as the ids do, so that they fit 16 bits.
NARROW = 1 << 16


def _frequent_places(s: np.ndarray, least: int) -> np.ndarray:
    """Positions of all pairs that occur at least so often, and of some that share a bucket with others."""
    h = s[:-1] * np.uint32(0x9E3779B1)
    h += s[1:]
    h *= np.uint32(0x85EBCA77)
    h >>= np.uint32(32 - _BINS)
    bins = h.astype(np.int64)
    return np.flatnonzero((np.bincount(bins, minlength=1 << _BINS) >= least)[bins])


def _pairs_to_replace(s: np.ndarray, ends: np.ndarray, at: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the most frequent pairs (descending), the positions of these pairs with the rank of each, and the positions of all pairs that are
    frequent enough. at: ascending, with all positions of such pairs. In a run of one symbol every other position counts, so occurrences of a pair
    never overlap; a pair does not begin at the end of a document."""
    import pandas as pd

    ended = np.zeros(len(s), bool)
    ended[ends] = True
    at = at[~ended[at]]
    left, right = s[at], s[at + 1]
    twin = np.flatnonzero(left == right)
    if twin.size:
        begins = np.concatenate([[True], np.diff(at[twin]) > 1])
        place = np.arange(len(twin)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        ok = np.ones(len(at), bool)
        ok[twin[place % 2 == 1]] = False
        at, left, right = at[ok], left[ok], right[ok]
    codes, keys = pd.factorize((left.astype(np.uint64) << np.uint64(32)) | right)
    count = np.bincount(codes, minlength=len(keys))
    order = np.lexsort((keys, -count))  # ties by key: the same shard gives the same grammar
    order = order[count[order] >= least]
    place = np.full(len(keys), -1, np.int32)
    place[order] = np.arange(len(order))
    rank = place[codes]
    often = at[rank >= 0]
    if len(order) > most:
        order = order[:most]
        rank[rank >= most] = -1
    some = np.flatnonzero(rank >= 0)
    return keys[order], at[some], rank[some], often


def _rounds(s: np.ndarray, ends: np.ndarray, first: int, rules: list[np.ndarray], room: int, lowest: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], bool]:
    """Symbols, document ends and rules after all rounds down to the lowest count; and whether the room ran out first.

    All positions are looked at when the count falls. At the same count, a pair can only be frequent if it was so before or is new: rounds then look
    at these positions alone, and at runs of one symbol, where the places that count may move."""
    made = sum(map(len, rules))
    steps = [max(lowest, len(s) * x // 1_000_000) for x in ROUNDS]
    least = lowest if rules else steps.pop(0)
    active = None
    while len(s) > 1:
        if made >= room:
            return s, ends, rules, True
        at = _frequent_places(s, least) if active is None else active
        keys, at, rank, often = _pairs_to_replace(s, ends, at, least, room - made)
        take = np.empty(0, np.int64)
        if len(keys):
            # An occurrence is replaced if no overlapping one has a better rank.
            big = np.int32(2**31 - 1)
            near = np.diff(at) == 1
            left, right = np.full(len(at), big), np.full(len(at), big)
            left[1:][near] = rank[:-1][near]
            right[:-1][near] = rank[1:][near]
            won = (rank < left) & (rank <= right)
            take, rank = at[won], rank[won]
            # A pair that lost too many occurrences to better ones waits for the next round. The best pair loses none.
            used = np.bincount(rank, minlength=len(keys)) >= least
            won = used[rank]
            take, rank = take[won], rank[won]
        before = least
        if not len(take) and least == lowest:
            break
        least = steps.pop(0) if steps else max(lowest, least // 2)
        if len(take):
            active = None
            keep = np.ones(len(s), bool)
            keep[take + 1] = False
            number = np.cumsum(used) - 1
            s[take] = first + made + number[rank]
            if least == before:
                fresh = np.zeros(len(s), bool)
                fresh[often] = True
                fresh[take] = True
                fresh[np.maximum(take - 1, 0)] = True
                fresh = fresh[keep][:-1]
            s = s[keep]
            if least == before:
                active = np.flatnonzero(fresh | (s[:-1] == s[1:]))
            ends = ends - np.searchsorted(take + 1, ends, side="right")
            keys = keys[used]
            rules = [*rules, np.stack([keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)]
            made += len(keys)
        elif least != before:
            active = None
    return s, ends, rules, False


def compress(ids: np.ndarray, doc_starts: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """First nonterminal, rules (left, right), symbols, and each document's first symbol."""
    s = ids.astype(np.uint32)
    ends = np.append(doc_starts[1:], len(s))
    ends = np.unique(ends[ends > 0] - 1)
    first = int(s.max()) + 1 if len(s) else 0
    rules: list[np.ndarray] = []
    room, full = NARROW - first, True
    if room > 0:
        s, ends, rules, full = _rounds(s, ends, first, rules, room, RULE // 2 + 1)
    if full:
        # Symbols of four bytes: a rule pays sooner, but all symbols grow.
        wide = _rounds(s.copy(), ends, first, rules, 2**32 - 1 - first, RULE // 4 + 1)
        if room <= 0 or _bytes(wide[0], wide[2], 4) < _bytes(s, rules, 2):
            s, ends, rules, _ = wide
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    sym_starts = np.concatenate([[0], ends + 1])[: len(doc_starts)] if len(doc_starts) else np.empty(0, np.int64)
    return first, table, s, sym_starts


def _bytes(s: np.ndarray, rules: list[np.ndarray], wide: int) -> int:
    return wide * len(s) + RULE * sum(map(len, rules))


def _blocks(first: int, rules: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rules that rest on ids and rules before the stretch only."""
    top = rules.max(axis=1).astype(np.int64) - first
    a = 0
    while a < len(top):
        b, step = a + 1, 64
        # A stretch ends at the first rule that rests on it.
        while b < len(top):
            own = np.flatnonzero(top[b : b + step] >= a)
            if own.size:
                b += int(own[0])
                break
            b, step = min(b + step, len(top)), step * 2
        yield a, b
        a = b


def lengths(first: int, rules: np.ndarray) -> np.ndarray:
    """Expansion length of every rule."""
    out = np.ones(len(rules), np.int64)
    for a, b in _blocks(first, rules):
        pair = rules[a:b].astype(np.int64) - first
        out[a:b] = np.where(pair < 0, 1, out[np.maximum(pair, 0)]).sum(axis=1)
    return out


def expansions(first: int, rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, lengths and flat ids of all symbols that are rules."""
    length = lengths(first, rules)
    off = np.cumsum(length) - length
    flat = np.empty(int(length.sum()), np.uint32)
    for a, b in _blocks(first, rules):
        symbols = rules[a:b].ravel()
        pair = symbols.astype(np.int64) - first
        low = pair < 0
        pair = np.maximum(pair, 0)
        n = np.where(low, 1, length[pair])
        total = np.cumsum(n)
        begin = total - n
        ids = flat[np.repeat(np.where(low, 0, off[pair]) - begin, n) + np.arange(total[-1])]
        ids[begin[low]] = symbols[low]
        flat[off[a] : off[a] + total[-1]] = ids
    return off, length, flat


def pack(doc_ids: list, docs: list[np.ndarray]) -> bytes:
    """A shard of documents, each with at least one id."""
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.cumsum(sizes) - sizes
    ids = np.concatenate(docs) if docs else np.empty(0, np.uint32)
    first, rules, symbols, sym_starts = compress(ids, starts)
    length = lengths(first, rules)
    wide = 4 if first + len(rules) > NARROW else 2
    head = HEAD.pack(MAGIC, wide, first, len(rules), len(docs), len(symbols), len(ids))
    return b"".join([
        head, rules[:, 0].astype("<u4").tobytes(), rules[:, 1].astype("<u4").tobytes(), length.astype("<u4").tobytes(),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.append(sym_starts, len(symbols)).astype("<u8").tobytes(), np.append(starts, len(ids)).astype("<u8").tobytes(),
        symbols.astype(f"<u{wide}").tobytes(),
    ])


class Shard:
    """Reader of a shard."""

    def __init__(self, blob: bytes):
        magic, self.wide, self.first, n_rules, n_docs, n_symbols, self.n_ids = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(blob, kind, n, at)
            at += x.nbytes
            return x

        left, right = take("<u4", n_rules), take("<u4", n_rules)
        self.length = take("<u4", n_rules).astype(np.int64)
        self.rules = np.stack([left, right], 1) if n_rules else np.empty((0, 2), np.uint32)
        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.sym_starts = take("<u8", n_docs + 1).astype(np.int64)
        self.starts = take("<u8", n_docs + 1).astype(np.int64)
        self.symbols = take(f"<u{self.wide}", n_symbols)
        self._table = None

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        if self._table is None:
            off, length, flat = expansions(self.first, self.rules)
            # One table for ids and rules: an id stands for itself.
            self._table = (
                np.concatenate([np.arange(self.first), self.first + off]), np.concatenate([np.ones(self.first, np.int64), length]),
                np.concatenate([np.arange(self.first, dtype=np.uint32), flat]),
            )
        off, length, flat = self._table
        n = length[symbols]
        total = np.cumsum(n)
        return flat[np.repeat(off[symbols] - (total - n), n) + np.arange(total[-1] if len(total) else 0)]

    def document(self, i: int) -> np.ndarray:
        return self._expand(self.symbols[self.sym_starts[i] : self.sym_starts[i + 1]])

    def span(self, i: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of a document: only symbols that reach into the span are expanded."""
        sym = self.symbols[self.sym_starts[i] : self.sym_starts[i + 1]].astype(np.int64)
        n = np.ones(len(sym), np.int64)
        rule = sym >= self.first
        n[rule] = self.length[sym[rule] - self.first]
        end = np.cumsum(n)
        a, b = np.searchsorted(end, start, side="right"), np.searchsorted(end, max(stop, start), side="left") + 1
        return self._expand(sym[a:b])[start - int(end[a - 1] if a else 0) :][: max(0, stop - start)]

    def all_ids(self) -> np.ndarray:
        return self._expand(self.symbols)


def digests(blob: bytes) -> list[tuple]:
    """doc_id, first id in the shard, ids, crc32 of the ids, for each document."""
    shard = Shard(blob)
    ids = shard.all_ids().astype("<u4")
    b = shard.starts.tolist()
    return [(d, b[i], b[i + 1] - b[i], zlib.crc32(ids[b[i] : b[i + 1]].tobytes())) for i, d in enumerate(shard.doc_ids)]
