"""Column-wise construction of the Burrows-Wheeler transform and the common prefixes of many short byte strings (numpy).

The strings stand side by side, aligned at an anchor, and each round inserts one symbol of every string, from the last column to the
first. Of all suffixes only those that begin in the same column can share LENGTH bytes (the caller's anchors see to that), so symbols count as tagged
with their column: the transform's part of a column is settled in the round of that column, and only the part of the last column is needed for
the next. A round sorts the strings stably by the symbols that the transform has for them, and takes common prefixes from range minima
of those before.
"""

from __future__ import annotations

import numpy as np

#: Floor of the binary logarithm, for range minima.
_LOG = np.zeros(1 << 16, np.uint8)
for _i in range(2, 1 << 16):
    _LOG[_i] = _LOG[_i >> 1] + 1


def _logs(n: np.ndarray) -> np.ndarray:
    return np.where(n < 1 << 16, _LOG[np.minimum(n, (1 << 16) - 1)], _LOG[np.minimum(n >> 15, (1 << 16) - 1)] + 15)


def _range_min(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of values[a..b] for each pair, ends included; a <= b."""
    if not len(a):
        return np.zeros(0, values.dtype)
    logs = _logs(b - a + 1)
    table = [values]
    for level in range(int(logs.max())):
        t = table[-1].copy()
        half = 1 << level
        np.minimum(t[:-half], table[-1][half:], out=t[:-half])
        table.append(t)
    table = np.concatenate(table)
    row = logs.astype(np.int64) * len(values)
    return np.minimum(table[row + a], table[row + b - (1 << logs.astype(np.int64)) + 1])


def repeated_columns(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, leads: np.ndarray, length: int, each=None) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of each place whose next `length` bytes also follow in the same column of another string.

    String i is data[starts[i]:starts[i] + lengths[i]], its anchor leads[i] bytes behind its start. each(column, transform, prefixes) is called for
    the transform's part of each column, from the last one to the first, if given. length is at most 255.
    """
    ends, found = lengths - leads, ([], [])
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    coming = np.argsort(-ends, kind="stable")
    next_ = 0
    order, prefix = np.zeros(0, np.int64), np.zeros(0, np.uint8)
    place = starts + leads
    for column in range(int(ends.max()) - 1, -int(leads.max()) - 1, -1):
        # Strings that end here enter with the empty suffix, before all others.
        upto = next_
        while upto < len(coming) and ends[coming[upto]] == column + 1:
            upto += 1
        if upto > next_:
            order, prefix = np.concatenate([coming[next_:upto], order]), np.concatenate([np.zeros(upto - next_, np.uint8), prefix])
            if len(prefix) > upto - next_:
                prefix[upto - next_] = 0
            next_ = upto
        # Strings that begin right of this column leave; what stands between their neighbours is the least prefix over them.
        stays = leads[order] >= -column
        if not stays.all():
            at = np.flatnonzero(stays)
            if len(at):
                prefix = np.minimum.reduceat(prefix[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
            else:
                prefix = prefix[:0]
            order = order[at]
        if not len(order):
            continue
        symbols = data[place[order] + column]
        if each:
            each(column, symbols, prefix)
        sort = np.argsort(symbols, kind="stable")
        symbols = symbols[sort]
        same = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
        new = np.zeros(len(order), np.uint8)
        new[same] = np.minimum(_range_min(prefix, sort[same - 1] + 1, sort[same]), length - 1) + 1
        order, prefix = order[sort], new
        hit = prefix >= length
        if hit.any():
            hit[:-1] |= hit[1:]
            found[0].append(order[hit])
            found[1].append(leads[order[hit]] + column)
    return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)
