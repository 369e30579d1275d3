"""Anchored segments of byte strings: the distribution scheme under the suffix-array operator."""

from __future__ import annotations

import numpy as np

#: Length of the anchoring grams.
GRAM = 20
MASK = np.uint64((1 << 24) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position of ``data`` (uint8, with 32 spare bytes behind)."""
    n = len(data) - 32
    words = np.empty(n + 16, np.uint64)
    for r in range(8):
        part = data[r : r + (len(data) - r) // 8 * 8].view(np.uint64)
        put = words[r::8]
        put[:] = part[: len(put)]
    a, b = words[:n].copy(), words[8 : n + 8].copy()
    c = words[12 : n + 12] >> np.uint64(32)
    a *= np.uint64(0x9E3779B97F4A7C15)
    a ^= a >> np.uint64(29)
    b += a
    b *= np.uint64(0xBF58476D1CE4E5B9)
    b ^= b >> np.uint64(32)
    c += b
    c *= np.uint64(0x94D049BB133111EB)
    c ^= c >> np.uint64(31)
    c *= np.uint64(0xD6E8FEB86659FD93)
    c ^= c >> np.uint64(32)
    return c


def segments(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int):
    """Cut documents into segments so that equal strings of ``length`` bytes fall under equal anchors.

    ``data`` holds the documents one after the other.  Each window of ``length``
    bytes is anchored at the gram with the least hash in it (the first of equals);
    runs of windows with one anchor form a segment.  Every window is in exactly
    one segment, and equal windows have equal anchors at equal offsets.  Returns
    arrays: the document's index, the segment's first byte in ``data``, its size,
    and the anchor's hash.
    """
    span = length - GRAM + 1
    hashes = gram_hashes(data)
    if len(hashes) > MASK:
        raise ValueError("at most 16 MB at once")
    key = (hashes & ~MASK) | (np.arange(len(hashes), dtype=np.uint64) & MASK)
    low, reach = key, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    place = low & MASK
    doc = np.flatnonzero(sizes >= length)
    n = sizes[doc] - length + 1
    # windows of the documents, one after the other
    new = np.ones(len(place) + 1, bool)
    new[1:-1] = place[1:] != place[:-1]
    new[starts[doc]] = True
    ok = np.zeros(len(place) + 1, np.int8)
    np.add.at(ok, starts[doc], 1)
    np.add.at(ok, np.minimum(starts[doc] + n, len(place)), -1)
    inside = np.cumsum(ok[:-1], dtype=np.int8) > 0
    begin = np.flatnonzero(new[:-1] & inside)
    if not len(begin):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    of = doc[np.searchsorted(starts[doc], begin, side="right") - 1]
    limit = starts[of] + sizes[of] - length + 1
    end = np.minimum(np.append(begin[1:], len(place)), limit)
    size = end - begin + length - 1
    at = place[begin].astype(np.int64)
    return of, begin, size, hashes[at]


#: Classes of windows by where the anchor stands in them.
CLASSES = 6


def core_runs(segs: list[bytes], anchors: np.ndarray, length: int, classes: int):
    """Runs of windows by where the anchor stands in them, and the hash of what all such windows share.

    All windows in which the anchor stands ``lo`` to ``hi`` bytes from the start hold
    the same core around it, so equal windows have equal cores.  Yields, class by
    class, arrays: the segment, the first window, the last, and the core's hash.
    """
    sizes = np.fromiter(map(len, segs), np.int64, len(segs))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    data = np.frombuffer(b"".join([*segs, bytes(32)]), np.uint8)
    hashes = gram_hashes(data)
    of = np.repeat(np.arange(len(segs)), sizes)
    hits = np.flatnonzero(hashes == anchors[of])
    inside = hits - starts[of[hits]] + GRAM <= sizes[of[hits]]
    anchor = np.zeros(len(segs), np.int64)
    # a segment begins with a window in which its anchor is the first of equal grams
    hits = hits[inside][::-1]
    anchor[of[hits]] = hits
    local, last = anchor - starts, sizes - length
    span = length - GRAM + 1
    for q in range(classes):
        lo, hi = span * q // classes, span * (q + 1) // classes - 1
        a, z = np.maximum(0, local - hi), np.minimum(last, local - lo)
        own = np.flatnonzero(a <= z)
        core, end = anchor[own] - lo, anchor[own] + length - hi - GRAM
        key = anchors[own] + np.uint64((q + 1) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)
        for step in range(0, length - hi + lo, GRAM):
            key = (key ^ hashes[np.minimum(core + step, end)]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        yield own, a[own], z[own], key


def shared_runs(segs: list[bytes], anchors: np.ndarray, length: int) -> np.ndarray:
    """Runs of windows that may occur in two segments of one anchor.

    A window whose core (by its hash) no other segment of the anchor has occurs
    nowhere else.  Returns rows of segment, first byte and end: what is left, each
    run by itself.
    """
    if not len(segs):
        return np.empty((0, 3), np.int64)
    found = []
    for own, a, z, key in core_runs(segs, anchors, length, CLASSES):
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        many = np.zeros(len(own), bool)
        many[order[1:]] |= same
        many[order[:-1]] |= same
        found.append(np.stack([own[many], a[many], z[many]], 1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    if not len(rows):
        return rows
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 2] + 1)
    begin = np.flatnonzero(new)
    return np.stack([rows[begin, 0], rows[begin, 1], rows[np.append(begin[1:], len(rows)) - 1, 2] + length], 1)
