"""Token ids of whole texts, equal to encoding each text with the tokenizers library.

A byte-level BPE splits a text into pre-tokens and encodes each of them on its own.
Here numpy finds the pre-tokens of many texts at once, the library encodes each distinct
pre-token once, and the ids of a text are gathered from that table. New words that begin with a
blank go to the library as one text, which it splits before each blank; others go one by one. Texts that hold a
special token's string or characters that the split cannot place are encoded by the library
as they are. TokenIds.check() says whether a tokenizer file has this split; for any
other file all texts go to the library.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

from verisift.llm.spans import prefix_sums, span_hashes

#: Classes of code points: letters, numbers, others, white space, end of a text, unknown.
L, N, O, S, D, X = range(6)  # noqa: E741
#: White space of the split's \s, fixed by Unicode's White_Space.
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_END = 0x110000
#: Code points of texts that are handled together, and pre-tokens kept by a worker.
CHUNK = 1 << 19
KEPT = 1 << 20
#: Bits of a hash that choose a pre-token's slot; where that is taken, the bits next to them choose another, and what stood there goes: it is encoded
#: again when it is met.
_SLOT_BITS = 22


@functools.cache
def _classes() -> np.ndarray:
    out = np.full(_END + 1, X, np.uint8)
    old = unicodedata.ucd_3_2_0.category
    for cp in range(_END):
        c = unicodedata.category(chr(cp))
        if c[0] == "L":
            k = L
        elif c[0] == "N":
            k = N
        else:
            k = O
        # Characters that newer Unicode versions added may be unknown to the library: those texts take the slow way.
        out[cp] = k if old(chr(cp)) != "Cn" and c != "Cs" and old(chr(cp))[0] == c[0] else X
    out[_WHITE] = S
    out[_END] = D
    return out


def default_tokenizer() -> str:
    """Path of the public 50k byte-level BPE file; VERISIFT_TOKENIZER overrides it."""
    if found := os.environ.get("VERISIFT_TOKENIZER"):
        return found
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TokenIds:
    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.end_id = end_id
        spec = json.loads(self.library.to_str())
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        self.splits = (
            spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in spec.get("added_tokens") or [])
        )
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # a byte-level token has one character for each byte
        self.forget()

    def forget(self) -> None:
        self.slots = np.zeros(1 << _SLOT_BITS, np.int32)  # entries, 0 where free
        self.known, self.filled = 1, 1  # entries and ids; the arrays below have room for more
        self.keys = np.zeros(1 << 12, np.uint64)  # hashes of pre-tokens
        self.off, self.len = np.zeros(1 << 12, np.int64), np.ones(1 << 12, np.int64)
        self.flat = np.full(1 << 14, self.end_id, np.uint32)  # entry 0: the end of a text

    def plain(self, text: str) -> np.ndarray:
        return np.array([*self.library.encode(text, add_special_tokens=False).ids, self.end_id], np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with the end id."""
        out: list = [None] * len(texts)
        batch: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if not self.splits or any(x in t for x in self.special):
                out[i] = self.plain(t)
                continue
            batch.append(i)
            size += len(t)
            if size >= CHUNK:
                self._some(texts, batch, out)
                batch, size = [], 0
        if batch:
            self._some(texts, batch, out)
        return out

    def _some(self, texts: list[str], which: list[int], out: list) -> None:
        joined = "\0".join(texts[i] for i in which) + "\0"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        ends = np.cumsum([len(texts[i]) + 1 for i in which]) - 1
        cp[ends] = _END
        kind = np.take(_classes(), cp)
        if (bad := np.flatnonzero(kind == X)).size:
            slow = np.unique(np.searchsorted(ends, bad))
            for j in slow:
                out[which[j]] = self.plain(texts[which[j]])
            rest = [i for j, i in enumerate(which) if j not in set(slow.tolist())]
            if rest:
                self._some(texts, rest, out)
            return
        starts = self._starts(cp, kind)
        stops = np.append(starts[1:], len(cp))
        hashes = span_hashes(prefix_sums(cp, starts), starts, stops)
        is_end = kind[starts] == D
        hashes[is_end] = 0
        spaced = (cp[starts] == 32) & (kind[np.minimum(starts + 1, len(cp) - 1)] == L)
        entries = self._entries(joined, starts, stops, hashes, spaced)
        n = self.len[entries]
        total = np.cumsum(n)
        ids = self.flat[np.repeat(self.off[entries] - (total - n), n) + np.arange(total[-1])]
        bounds = total[is_end]
        for j, i in enumerate(which):
            out[i] = ids[bounds[j - 1] if j else 0 : bounds[j]]

    @staticmethod
    def _starts(cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where the pre-tokens begin. A run of one class is a pre-token; one blank before it
        belongs to it; other white space before it forms one of its own, whose last character
        stands alone unless that blank; an apostrophe that begins a pre-token takes a
        following s, t, m, d, re, ve or ll and nothing more."""
        n = len(cp)
        prev = np.empty_like(kind)
        prev[0], prev[1:] = D, kind[:-1]
        after = np.empty_like(kind)
        after[-1], after[:-1] = D, kind[1:]
        start = kind != prev
        start |= kind == D
        word = kind < S
        blank = np.zeros(n, bool)
        blank[1:] = cp[:-1] == 32
        start &= ~(word & blank)
        start |= (kind == S) & (after < S)
        quote = np.flatnonzero((cp == 39) & start)
        if quote.size:
            a = cp[np.minimum(quote + 1, n - 1)]
            b = cp[np.minimum(quote + 2, n - 1)]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            for q, k in ((quote[one], 1), (quote[two & ~one], 2)):
                start[q + 1] = False
                start[q + 1 + k] = True  # the end of the text stands there at the latest
        return np.flatnonzero(start)

    def _entries(self, joined: str, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray, spaced: np.ndarray) -> np.ndarray:
        """Entry of each pre-token. spaced: those of a blank and letters."""
        import pandas as pd

        if self.known > KEPT:
            self.forget()
        home = (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        entries = self.slots[home]
        new = np.flatnonzero(self.keys[entries] != hashes)
        if new.size:
            entries[new] = self.slots[self._other(hashes[new])]
            new = new[self.keys[entries[new]] != hashes[new]]
        if new.size:
            codes, distinct = pd.factorize(hashes[new])
            first = np.empty(len(distinct), np.int64)
            first[codes[::-1]] = new[::-1]
            order = np.argsort(~spaced[first], kind="stable")
            first = first[order]
            words = [joined[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
            got, count = self._encoded(words, int(spaced[first].sum()), stops[first] - starts[first])
            known, filled = self.known + len(words), self.filled + len(got)
            self.keys, self.off, self.len = (_room(x, known) for x in (self.keys, self.off, self.len))
            self.flat = _room(self.flat, filled)
            self.flat[self.filled : filled] = got
            self.off[self.known : known] = self.filled + np.cumsum(count) - count
            self.len[self.known : known] = count
            self.keys[self.known : known] = distinct[order]
            own = np.empty(len(words), np.int32)
            own[order] = np.arange(self.known, known)
            home = home[first]
            self.slots[np.where(self.slots[home] == 0, home, self._other(hashes[first]))] = np.arange(self.known, known)
            self.slots[0] = 0  # the end's, whose hash is 0
            self.known, self.filled = known, filled
            entries[new] = own[codes]
        return entries

    @staticmethod
    def _other(hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(64 - 2 * _SLOT_BITS)) & np.uint64((1 << _SLOT_BITS) - 1)).astype(np.int64)

    def _encoded(self, words: list[str], spaced: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (the first ones `spaced`, of so many code points) and how many each has."""
        # The ids of a pre-token hold its bytes exactly, so byte lengths say where each one ends.
        text = "".join(words)
        letters = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        begins = np.append(np.flatnonzero((letters & 0xC0) != 0x80), len(letters))
        stop = begins[np.cumsum(size)]
        line = text[: int(size[:spaced].sum())]
        if any(x in line for x in self.special):
            line, spaced = "", 0
        one = self.library.encode_batch_fast([line], add_special_tokens=False)[0].ids if spaced else []
        rest = self.library.encode_batch_fast([words[spaced:]], is_pretokenized=True, add_special_tokens=False)[0].ids if spaced < len(words) else []
        got = np.array(one + rest, np.uint32)
        last = np.searchsorted(np.cumsum(self.n_bytes[got]), stop) + 1
        return got, np.diff(last, prepend=0)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """x, twice as long or longer if it has no room for n."""
    return x if n <= len(x) else np.concatenate([x, np.empty(max(n - len(x), len(x)), x.dtype)])


@functools.lru_cache(maxsize=2)
def token_ids(path: str, end_id: int) -> TokenIds:
    """One per worker process, with what it has learnt about pre-tokens."""
    return TokenIds(path, end_id)


def chunks(batches: Iterable, column: str = "text") -> Iterator[tuple]:
    """Slices of Arrow batches with about CHUNK code points of text each, or a single longer text."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        group = np.cumsum(sizes) // CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
