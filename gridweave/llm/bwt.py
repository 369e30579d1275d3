"""Repeated strings by breadth-first backward extension on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

UNSET = 255


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``symbols`` (0..511) sorted by at least the next ``depth`` symbols; zeros follow the end.

    The first seven symbols are packed into one key; ranks of twice the length
    follow from pairs of ranks until ``depth`` is reached or all differ.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(7, symbols.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | padded[j : j + n]
    order = np.argsort(key)
    got = 7
    while True:
        ordered = key[order]
        new = np.concatenate([[False], ordered[1:] != ordered[:-1]])
        ranks = np.cumsum(new)
        if got >= depth or ranks[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = ranks
        key = rank * (n + 1)
        key[: n - got] += rank[got:] + 1
        got *= 2
        order = np.argsort(key)


def bounded_lcp(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each suffix with the one sorted before it, as far as it is under ``least``; else UNSET.

    Intervals of suffixes that share a prefix of l symbols are extended to the
    left by every symbol that precedes them in the transform.  The end of an
    extended interval that no shorter prefix has marked gets the value l, and the
    interval goes on to level l + 1.  Values so come up in increasing order, and
    level ``least`` is never computed.  The separator 0 is extended from, so that
    prefixes ending at one are told apart, but never extended by.
    """
    n = len(symbols)
    before = symbols[order - 1]
    last_first = np.empty(n, np.int64)
    last_first[np.argsort(before, kind="stable")] = np.arange(n)
    lcp = np.full(n + 1, UNSET, np.uint8)
    lcp[0] = lcp[n] = 0
    low, high = np.array([0]), np.array([n])  # half open
    mark = np.zeros(n, np.int32)
    for level in range(least):
        sizes = high - low
        total = int(sizes.sum())
        if not total:
            break
        ids = np.repeat(np.arange(1, len(low) + 1, dtype=np.int32), sizes)
        at = np.arange(total) + np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        c = before[at]
        if level:
            at, ids, c = (x[c > 0] for x in (at, ids, c))
        to = last_first[at]
        if len(to) * 16 > n:  # many: mark and sweep, else sort
            mark[to] = ids
            to = np.flatnonzero(mark)
            ids = mark[to]
            mark[to] = 0
        else:
            o = np.argsort(to, kind="stable")
            to, ids = to[o], ids[o]
        if not len(to):
            break
        first = np.concatenate([[True], (to[1:] != to[:-1] + 1) | (ids[1:] != ids[:-1]) | (symbols[order[to[1:]]] != symbols[order[to[:-1]]])])
        begin = np.flatnonzero(first)
        lo, hi = to[begin], to[np.append(begin[1:], len(to)) - 1] + 1
        fresh = lcp[hi] == UNSET
        lcp[hi[fresh]] = level
        low, high = lo[fresh], hi[fresh]
    return lcp[:n]


def later_windows(parts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Which windows of ``length`` bytes occur earlier among ``parts``.

    Part i begins at byte ``start[i]`` of document ``doc[i]``.  A window is later
    if an equal one begins at a smaller (document, byte).  Returns, for each run of
    later windows of a part, the part's index and the run's first offset and
    end, as an array of three columns.
    """
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer(b"\0".join([*parts, b""]), np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols = flat.astype(np.int16) + 1
    symbols[begins + sizes] = 0
    order = suffix_order(symbols, length)
    lcp = bounded_lcp(symbols, order, length)
    group = np.cumsum(lcp != UNSET)  # suffixes with one prefix of ``length`` symbols
    of = np.repeat(np.arange(len(parts)), sizes + 1)[order]
    offset = order - begins[of]
    whole = offset + length <= sizes[of]
    many = np.bincount(group[whole], minlength=group[-1] + 1)[group] > 1
    take = np.flatnonzero(whole & many)
    of, offset, group = of[take], offset[take], group[take]
    place = np.lexsort((offset + start[of], doc[of], group))
    of, offset, group = of[place], offset[place], group[place]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, int)
    lead = np.repeat(head, np.diff(np.append(head, len(group))))
    later = (doc[of] != doc[of[lead]]) | (start[of] + offset != start[of[lead]] + offset[lead])
    of, offset = of[later], offset[later]
    o = np.lexsort((offset, of))
    of, offset = of[o], offset[o]
    if not len(of):
        return np.empty((0, 3), np.int64)
    cut = np.concatenate([[True], (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1)])
    a = np.flatnonzero(cut)
    z = np.append(a[1:], len(of)) - 1
    return np.stack([of[a], offset[a], offset[z] + 1], 1)
