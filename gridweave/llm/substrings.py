"""Operator 1: removal of repeated byte strings by suffix sorting."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import later_windows
from .common import LAST_ID, id_text, written
from .windows import CLASSES, core_runs, segments, shared_runs

#: Bytes of a repeated string.
LENGTH = 100
#: Bytes cut into segments at once; bytes indexed at once; contents under one anchor that are indexed together.
PIECE, INDEX_BYTES, ANCHOR_CONTENTS = 1 << 21, 1 << 20, 20_000
#: Rows of segments compared at once; an anchor with more is taken in pieces.
COMPARE_ROWS = 1 << 18
#: Contents found repeated that a task remembers, so that of their later copies none asks again.
KNOWN = 1 << 17
MARK, INDEX, SPLIT = 0, 1, 2
CLAIMS = "h long, c long, c2 int, id long, tag long, at long"
TOLD = "id long, tag long, start long, size int, h long, kind int"


def _names(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(n).to_numpy(zero_copy_only=False) for n in names]


class Claims:
    """Rows that ask whether a content stands earlier, of one task.

    A content is told by 96 bits of its BLAKE2b digest.  Of equal contents only the
    earliest that this task has met asks; the others are later for sure, whatever
    other tasks hold, and go anywhere.  What is repeated within a piece is
    remembered for the next ones (``KNOWN`` contents at most, which changes only how
    many rows ask).  So a content that a third of all documents hold reaches its
    place as a few rows a task.
    """

    def __init__(self) -> None:
        self.c, self.c2 = np.empty(0, np.int64), np.empty(0, np.int32)
        self.doc, self.start = np.empty(0, np.int64), np.empty(0, np.int64)

    def rows(self, anchor: np.ndarray, contents: list[bytes], doc, tag, start, size) -> pa.RecordBatch:
        digests = b"".join([hashlib.blake2b(x, digest_size=12).digest() for x in contents])
        both = np.frombuffer(digests, np.dtype([("c", "<i8"), ("c2", "<i4")]))
        order = np.lexsort((start, doc, both["c"]))
        a, c, c2, d, s, g, n = (x[order] for x in (anchor.view(np.int64), both["c"], both["c2"], doc, start, tag, size))
        new = np.ones(len(order), bool)
        new[1:] = (c[1:] != c[:-1]) | (c2[1:] != c2[:-1]) | (a[1:] != a[:-1])
        begin = np.flatnonzero(new)
        head = np.repeat(begin, np.diff(np.append(begin, len(order))))
        later = (d != d[head]) | (s != s[head])
        at, met = self._look(c[begin], c2[begin])
        kd, ks = self.doc[at], self.start[at]
        sure = met & ((kd < d[begin]) | ((kd == d[begin]) & (ks < s[begin])))
        later |= np.repeat(sure, np.diff(np.append(begin, len(order))))
        # what is later needs no answer: it goes anywhere
        a = np.where(later, c ^ (d * np.int64(-7046029254386353131)), a)
        self._keep(met, at, sure, np.diff(np.append(begin, len(order))) > 1, c[begin], c2[begin], d[begin], s[begin])
        cols = [a, c, c2, d, g, s * 512 + n * 2 + later]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "c", "c2", "id", "tag", "at"])

    def _look(self, c: np.ndarray, c2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.c):
            self.c, self.c2, self.doc, self.start = np.zeros(1, np.int64), np.zeros(1, np.int32), np.full(1, -(1 << 63)), np.full(1, 1 << 62)
            self.c2 -= 1
            return np.zeros(len(c), np.int64), np.zeros(len(c), bool)
        at = np.minimum(np.searchsorted(self.c, c), len(self.c) - 1)
        return at, (self.c[at] == c) & (self.c2[at] == c2) & (self.start[at] < 1 << 62)

    def _keep(self, met, at, sure, many, c, c2, d, s) -> None:
        lower = met & ~sure
        self.doc[at[lower]], self.start[at[lower]] = d[lower], s[lower]
        fresh = np.flatnonzero(many & ~met)[:KNOWN]
        if len(fresh):
            room = slice(max(0, len(self.c) + len(fresh) - KNOWN), None)
            parts = [np.concatenate([x[room], y[fresh]]) for x, y in ((self.c, c), (self.c2, c2), (self.doc, d), (self.start, s))]
            order = np.argsort(parts[0], kind="stable")
            self.c, self.c2, self.doc, self.start = (x[order] for x in parts)


def _cut_batch(claims: Claims, ids: np.ndarray, tags: np.ndarray, texts: list[bytes], length: int) -> Iterator[pa.RecordBatch]:
    """Segments of texts taken together."""
    if len(texts) == 1 and len(texts[0]) > PIECE:
        # piece by piece: windows begin in one piece each, and a segment cut in two leaves both parts under its anchor
        for a in range(0, len(texts[0]) - length + 1, PIECE):
            piece = texts[0][a : a + PIECE + length - 1]
            yield _segment_rows(claims, ids, tags, [piece], np.array([a]), length)
    else:
        yield _segment_rows(claims, ids, tags, texts, np.zeros(len(texts), np.int64), length)


def _segment_rows(claims: Claims, ids: np.ndarray, tags: np.ndarray, pieces: list[bytes], shift: np.ndarray, length: int) -> pa.RecordBatch:
    """Rows of the pieces' segments."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    whole = b"".join([*pieces, bytes(32)])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    part, begin, size, anchor = segments(np.frombuffer(whole, np.uint8), starts, sizes, length)
    contents = [whole[a:z] for a, z in zip(begin.tolist(), (begin + size).tolist())]
    return claims.rows(anchor, contents, ids[part], tags[part], begin - starts[part] + shift[part], size)


def _cut_documents(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claims = Claims()
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            ids, tags = _names(b, "id", "tag")
            a = held = 0
            for i, t in enumerate(texts):
                if a < i and held + len(t) > PIECE:
                    yield from _cut_batch(claims, ids[a:i], tags[a:i], texts[a:i], length)
                    a, held = i, 0
                held += len(t)
            if len(texts) > a:
                yield from _cut_batch(claims, ids[a:], tags[a:], texts[a:], length)

    return run


def _by_key(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Rows sorted by ``key``, in tables of at least ``most`` rows that end where a key does."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= most:
            t = pa.Table.from_batches(held)
            k = t.column(key).to_numpy()
            last = int(np.searchsorted(k, k[-1]))
            if last:
                yield t.slice(0, last)
                held, rows = t.slice(last).to_batches(), t.num_rows - last
            most = max(most, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held)


def _told(t: pa.Table, last: bool, large: bool, before: tuple | None) -> tuple[pa.RecordBatch, tuple]:
    """What rows sorted by anchor, content, document and place say, and the last content's earliest row.

    ``large``: all rows are of one anchor, which goes on; ``before`` is the content
    that its rows so far ended with.
    """
    h, c, c2, doc, tag, at = (t.column(n).to_numpy() for n in ("h", "c", "c2", "id", "tag", "at"))
    start, size, sure = at >> 9, (at >> 1) & 255, (at & 1).astype(bool)
    new_h = np.ones(len(h), bool)
    new_h[1:] = h[1:] != h[:-1]
    # rows known to be later have no part in their group
    ask = np.flatnonzero(~sure)
    new = np.zeros(len(h), bool)
    differ = (h[ask][1:] != h[ask][:-1]) | (c[ask][1:] != c[ask][:-1]) | (c2[ask][1:] != c2[ask][:-1])
    new[ask] = np.concatenate([[True], differ])[: len(ask)]
    head = np.zeros(len(h), np.int64)
    head[ask] = np.maximum.accumulate(np.where(new[ask], ask, 0))
    later = sure | (doc != doc[head]) | (start != start[head])
    own = lambda i: (c[i], c2[i], doc[head[i]], start[head[i]])
    if before is not None and len(ask) and before[:2] == (c[ask[0]], c2[ask[0]]):
        first = ask[head[ask] == ask[0]]
        later[first] = (doc[first] != before[2]) | (start[first] != before[3])
        new[ask[0]] = False
        end = before if head[ask[-1]] == ask[0] else own(ask[-1])
    else:
        end = own(ask[-1]) if len(ask) else before
    contents = np.bincount(np.cumsum(new_h) - 1, weights=new)[np.cumsum(new_h) - 1]
    kind = np.where(later, MARK, np.where((contents > ANCHOR_CONTENTS) | large, SPLIT, INDEX))
    emit = later | (new & ((contents > 1) | large) & (not last))
    cols = [doc, tag, start, size.astype(np.int32), h, kind.astype(np.int32)]
    names = ["id", "tag", "start", "size", "h", "kind"]
    return pa.RecordBatch.from_arrays([pa.array(x[emit]) for x in cols], names), end


def _compare(last: bool):
    """Tell segments that stand earlier elsewhere from those whose anchor has other contents too.

    Rows come sorted.  An anchor with more than ``COMPARE_ROWS`` rows is taken as it
    comes, in pieces, and counts as one with too many contents to be indexed together.
    ``last``: anchors are whole windows, which have one content each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, open_h, before = 0, None, None
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b)
                rows += b.num_rows
            if not rows or (b is not None and rows < COMPARE_ROWS):
                continue
            t = pa.Table.from_batches(held)
            h = t.column("h").to_numpy()
            a = int(np.searchsorted(h, h[0], side="right")) if h[0] == open_h else 0
            if a:
                out, before = _told(t.slice(0, a), last, True, before)
                yield out
            z = len(h) if b is None else int(np.searchsorted(h, h[-1]))
            if z > a:
                yield _told(t.slice(a, z - a), last, False, None)[0]
            a = max(a, z)
            if len(h) - a >= COMPARE_ROWS:
                out, before = _told(t.slice(a), last, True, None)
                yield out
                open_h, a = h[-1], len(h)
            held, rows = t.slice(a).to_batches(), len(h) - a

    return run


def _asked(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[tuple]:
    """The asked segments of documents: ids, tags, starts, anchors, whether the anchor is a core, and the bytes."""
    for b in batches:
        texts = b.column("text").cast(pa.binary()).to_pylist()
        ids, tags = _names(b, "id", "tag")
        lists = b.column("segs")
        flat, ends = lists.flatten(), lists.value_lengths().to_numpy()
        start, size, h, core = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        row = np.repeat(np.arange(len(texts)), ends)
        for a in range(0, len(row), most):
            p = slice(a, a + most)
            own = [texts[r][s : s + n] for r, s, n in zip(row[p].tolist(), start[p].tolist(), size[p].tolist())]
            yield ids[row[p]], tags[row[p]], start[p], h[p], core[p], own


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of segments from their documents' texts."""
    for ids, tags, start, h, core, own in _asked(batches):
        cols = [pa.array(x) for x in (h, ids, tags, start, core)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(own, pa.binary())], ["h", "id", "tag", "start", "core", "seg"])


def _split(length: int, classes: int, of_cores: bool):
    """Segments of anchors with too many contents, cut by class of window, under longer anchors: the classes' cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claims = Claims()
        for ids, tags, start, h, _, segs in _asked(batches, 1 << 13):
            if of_cores:  # single windows
                runs = [(i, k, k) for i, s in enumerate(segs) for k in range(len(s) - length + 1)]
                own, a, z = np.array(runs, np.int64).reshape(-1, 3).T
                parts = [segs[i][k : k + length] for i, k, _ in runs]
                key = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=8).digest() for x in parts]), np.uint64)
                yield claims.rows(key, parts, ids[own], tags[own], start[own] + a, np.full(len(own), length))
            else:
                for own, a, z, key in core_runs(segs, h.view(np.uint64), length, classes):
                    if len(own):
                        parts = [segs[i][x : y + length] for i, x, y in zip(own.tolist(), a.tolist(), z.tolist())]
                        yield claims.rows(key, parts, ids[own], tags[own], start[own] + a, z - a + length)

    return run


def _index(length: int):
    """Index the segments of whole anchors together and mark what stands earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, "h", INDEX_BYTES // length):
            h, doc, tag, start, core = (t.column(n).to_numpy() for n in ("h", "id", "tag", "start", "core"))
            segs = t.column("seg").to_pylist()
            plain = np.flatnonzero(~core)
            runs = shared_runs([segs[i] for i in plain], h[plain].view(np.uint64), length)
            runs[:, 0] = plain[runs[:, 0]]
            whole = [(i, 0, len(segs[i])) for i in np.flatnonzero(core).tolist()]
            of, a, z = np.concatenate([runs, np.array(whole, np.int64).reshape(-1, 3)]).T
            doc, tag, start = doc[of], tag[of], start[of] + a
            parts = [segs[i][x:y] for i, x, y in zip(of.tolist(), a.tolist(), z.tolist())]
            if not parts:
                continue
            runs = later_windows(parts, doc, start, length)
            of, a, z = runs[:, 0], runs[:, 1], runs[:, 2]
            cols = [doc[of], tag[of], start[of] + a, (z - a + length - 1).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["id", "tag", "start", "size"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, out = b.column("text").cast(pa.binary()).to_pylist(), []
        for t, marks in zip(texts, b.column("segs")):
            spans = []
            if marks.is_valid and len(marks):
                lo, n = marks.values.field(0).to_numpy(), marks.values.field(1).to_numpy()
                o = np.argsort(lo, kind="stable")
                lo, hi = lo[o], np.maximum.accumulate(lo[o] + n[o])
                first = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
                spans = list(zip(lo[first].tolist(), hi[np.append(first[1:], len(lo)) - 1].tolist()))
            digest, at = hashlib.sha256(), 0
            for lo, hi in spans:
                digest.update(t[at:lo])
                at = hi
            digest.update(t[at:])
            out.append((len(t), sum(z - a for a, z in spans), len(spans), digest.hexdigest(), [x for s in spans for x in s]))
        n, gone, k, sha, spans = zip(*out) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, k)), pa.array(sha, pa.string())]
            + [pa.array(spans, pa.list_(pa.int64()))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The bytes of each document covered by a string of ``length`` bytes that also starts earlier.

    Documents are cut into segments at anchors, so that equal strings fall under
    equal anchors (see ``windows``).  The text is so coded as a dictionary of distinct
    segments, as large repetitive texts are before a Burrows-Wheeler transform of
    them is made: equal segments are one entry, told by 64 bits of the anchor's hash
    and 96 bits of a BLAKE2b digest, and an entry's occurrences but the earliest are
    repeats.  Entries that share their anchor with another may share strings with
    it: their texts are fetched, windows whose core around the anchor no other entry
    has are left out, and the rest is suffix-sorted, in blocks of whole anchors; the
    intervals of at least ``length`` common bytes give the remaining repeats.  The
    entries of an anchor with more than ``ANCHOR_CONTENTS`` of them are cut again under
    longer anchors, the cores of their windows, and those of such a core under their
    single windows, so what is indexed together is bounded whatever repeats.

    Earlier means a smaller (``doc_id``, start), with null ids as the largest long; rows
    that share an id don't precede each other, so repeated rows both keep what is first
    in them.  Matches are judged on the input and never cross documents.  Null texts
    count as empty.  Returns one row per input row: ``doc_id``, ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256`` and ``spans`` (begin and end of each removed run).  An
    empty table gives no rows; other columns are ignored.
    """
    rows = id_text(docs).select("doc_id", F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "id", F.xxhash64("text").alias("tag"), "text")

    def asked(told: DataFrame) -> DataFrame:
        # one shape for all uses of the texts, so that they are shuffled once; copies under one id say the same
        per = told.groupBy("id", "tag").agg(F.collect_set(F.struct("start", "size", "h", "core")).alias("segs"))
        return rows.join(per, ["id", "tag"], "left").select("doc_id", "id", "tag", "text", "segs")

    claims, tables = rows.mapInArrow(_cut_documents(length), CLAIMS), []
    for level in range(3):
        order = ("h", "c", "c2", "id", "at")
        told = claims.repartition("h").sortWithinPartitions(*order).mapInArrow(_compare(level == 2), TOLD)
        tables.append(written(told).withColumn("core", F.lit(level > 0)))
        split = tables[-1].where(F.col("kind") == SPLIT)
        if not split.limit(1).count():
            break
        claims = asked(split).where("segs IS NOT NULL").mapInArrow(_split(length, CLASSES, level > 0), CLAIMS)
    told = functools.reduce(DataFrame.union, tables)
    parts = asked(told.where(F.col("kind") == INDEX)).where("segs IS NOT NULL")
    parts = parts.mapInArrow(_fetch, "h long, id long, tag long, start long, core boolean, seg binary")
    found = parts.repartition("h").sortWithinPartitions("h").mapInArrow(_index(length), "id long, tag long, start long, size int")
    marks = told.where(F.col("kind") == MARK).select("id", "tag", "start", "size").union(found)
    marks = marks.withColumns({"h": F.lit(0).cast("long"), "core": F.lit(False)})
    return asked(marks).mapInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
    )


#: All windows of all documents, each byte by itself: the definition, for small tables.
SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
p AS (SELECT doc_id, h, octet_length(h) AS n, unnest(range(octet_length(h))) AS pos FROM b),
w AS (SELECT doc_id, pos, hex(array_slice(h, pos + 1, pos + 1)) AS byte, CASE WHEN pos + 100 <= n THEN array_slice(h, pos + 1, pos + 100) END AS win FROM p),
f AS (SELECT win, min(doc_id) AS doc FROM w WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
g AS (SELECT w.win, f.doc, min(w.pos) AS pos FROM w JOIN f ON w.win = f.win AND w.doc_id = f.doc GROUP BY 1, 2),
m AS (SELECT w.doc_id, w.pos, w.byte, CASE WHEN g.win IS NOT NULL AND (w.doc_id <> g.doc OR w.pos <> g.pos) THEN 1 ELSE 0 END AS later
      FROM w LEFT JOIN g ON g.win = w.win),
c AS (SELECT doc_id, pos, byte, max(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM m),
s AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS before FROM c),
r AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed,
             CAST(sum(CASE WHEN gone = 1 AND before = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_spans,
             string_agg(CASE WHEN gone = 0 THEN byte END, '' ORDER BY pos) AS kept FROM s GROUP BY doc_id)
SELECT b.doc_id, octet_length(b.h) AS n_bytes, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(r.kept, ''))) AS kept_sha256
FROM b LEFT JOIN r USING (doc_id)
"""
