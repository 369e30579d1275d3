"""Operator 5: SimHash near-dedup by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, connected_components, few_rows, id_text, learn, rows_of, text_digest, written

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: Shingles hashed at once, and fingerprints joined at once.
CHUNK, JOIN_ROWS = 1 << 15, 1 << 20
#: Of 64 bits, the first bit of each of five blocks: fingerprints that differ in at most four bits agree in one.
BLOCKS = (0, 13, 26, 39, 52)
#: Prints of a bucket from which it counts as dense, and node pairs taken at once then.
DENSE, DENSE_WIDTH = 4096, 1 << 16
#: Within a bucket larger than this, the other bits (51, or 52 for the last block) are dealt into five blocks again.
SPLIT_ABOVE, SUB_BLOCKS = 50_000, ((13, 11), (24, 10), (34, 10), (44, 10), (54, 10))
LAST_SUB_BLOCKS = ((12, 11), (23, 11), (34, 10), (44, 10), (54, 10))


def simhash(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a text: bit i is set if it is set in over half of the shingles' hashes.

    Words are runs of non-white-space (ASCII) after lower-casing A-Z; a text with
    fewer words than ``size`` has one shingle, one without words (or null) none
    and the fingerprint zero.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    ends = list(accumulate(len(w) + 1 for w in words))
    joined = b" ".join(words)
    n = max(1, len(words) - size + 1)
    first = [0, *ends[: n - 1]]
    last = [e - 1 for e in ends[size - 1 :]] or [len(joined)]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        parts = [joined[a:b] for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])]
        digests = np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(SEED))), np.uint8)
        ones += np.unpackbits(digests.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in few_rows(batches):
        prints = np.fromiter((simhash(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        rest = b.schema.names[2:]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *rest])


def _hook(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all that the pairs connect the smallest label among them, in place."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        la, lb = la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels[:] = up


def trie_links(prints: np.ndarray, starts: np.ndarray, depth: int, budget: int, width: int = 1 << 20) -> np.ndarray:
    """Labels of ``prints`` after joining all within ``budget`` bits of each other in one bucket.

    ``prints`` (uint64) is sorted within each bucket; ``starts`` holds where the
    buckets begin.  A trie node is a range of ``prints`` with a common prefix.
    Pairs of nodes descend together from ``depth``, each step splitting both by
    the next bit; a pair whose prefixes differ in more bits than the budget is
    dropped with all below it.  Pairs of single leaves end in one comparison.
    Wide frontiers are taken in parts of ``width`` pairs, depth first, so memory
    doesn't grow with the bucket.  In a bucket of more than ``DENSE`` prints, those
    that differ in one bit are joined first, and a pair of nodes whose prints are
    all joined already is dropped too: a large group of near copies is not
    compared pair by pair.  The result has one label (the least index)
    per linked group: linear in the input, however many pairs link.
    """
    n = len(prints)
    labels = np.arange(n)
    ends = np.append(starts[1:], n)
    zeros: dict[int, np.ndarray] = {}

    def split(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        if bit not in zeros:
            clear = (prints >> np.uint64(63 - bit)) & np.uint64(1) == 0
            zeros[bit] = np.concatenate([[0], np.cumsum(clear)])
        return lo + zeros[bit][hi] - zeros[bit][lo]

    dense = np.flatnonzero(ends - starts > DENSE)
    for d in dense:
        _link_flips(prints, slice(int(starts[d]), int(ends[d])), labels)
    width = min(width, DENSE_WIDTH) if len(dense) else width
    stack = [(depth, starts, ends, starts, ends, np.zeros(len(starts), np.int8))]
    while stack:
        bit, al, ah, bl, bh, off = stack.pop()
        if len(dense):
            turns = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
            joined = (turns[ah - 1] == turns[al]) & (turns[bh - 1] == turns[bl]) & (labels[al] == labels[bl])
            al, ah, bl, bh, off = (x[~joined] for x in (al, ah, bl, bh, off))
        if len(al) > width:
            half = len(al) // 2
            stack.append((bit, al[half:], ah[half:], bl[half:], bh[half:], off[half:]))
            stack.append((bit, al[:half], ah[:half], bl[:half], bh[:half], off[:half]))
            continue
        single = (ah - al == 1) & (bh - bl == 1)
        if single.any():
            a, b = al[single], bl[single]
            near = (a != b) & (np.bitwise_count(prints[a] ^ prints[b]) <= budget)
            _hook(labels, a[near], b[near])
            al, ah, bl, bh, off = (x[~single] for x in (al, ah, bl, bh, off))
        if not len(al) or bit == 64:
            _hook(labels, al, bl)  # equal prints, if any are repeated
            continue
        am, bm = split(al, ah, bit), split(bl, bh, bit)
        cross = al != bl
        grown = (
            (al, am, bl, bm, off, None),
            (am, ah, bm, bh, off, None),
            (al, am, bm, bh, off + 1, None),
            (am, ah, bl, bm, off + 1, cross),
        )
        parts = []
        for l1, h1, l2, h2, d, only in grown:
            ok = (h1 > l1) & (h2 > l2) & (d <= budget)
            if only is not None:
                ok &= only
            parts.append([x[ok] for x in (l1, h1, l2, h2, d)])
        stack.append((bit + 1, *(np.concatenate(x) for x in zip(*parts))))
    return labels


def _link_flips(prints: np.ndarray, rows: slice, labels: np.ndarray) -> None:
    """Join prints that differ in one bit: with that bit cleared they are neighbours in order."""
    own = prints[rows]
    for bit in range(64):
        clear = own & ~(np.uint64(1) << np.uint64(bit))
        order = np.argsort(clear, kind="stable")
        same = np.flatnonzero(clear[order][1:] == clear[order][:-1])
        _hook(labels, rows.start + order[same], rows.start + order[same + 1])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest for each bucket; rows come sorted by bucket and turned print."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def solve(t: pa.Table) -> pa.RecordBatch:
        key, turned = t.column("bucket").to_numpy(), t.column("turned").to_numpy().view(np.uint64)
        turned = turned ^ np.uint64(1 << 63)  # sorted as signed
        fp, low = t.column("fp").to_numpy(), t.column("low").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
        labels = trie_links(turned, starts, 12, MAX_BITS)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        cols = [pa.array(x[i]) for i in (moved, labels[moved]) for x in (low, fp)]
        return pa.RecordBatch.from_arrays(cols, ["a_low", "a", "b_low", "b"])

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= JOIN_ROWS:
            t = pa.Table.from_batches(held)
            key = t.column("bucket").to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield solve(t.slice(0, last))
                held, rows = t.slice(last).to_batches(), t.num_rows - last
    if rows:
        yield solve(pa.Table.from_batches(held))


def near_links(prints: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of the distinct fingerprints in column ``fp`` that connect all within four bits.

    Each comes with its ``low`` as ``a_low`` and ``b_low``.
    Each print goes to five buckets, one per block of its bits (13 bits each, the
    last 12, so no bit is in two blocks); prints within four bits share a bucket.
    The 36,864 possible buckets are counted, and in those of
    more than ``SPLIT_ABOVE`` prints the remaining bits are dealt into blocks once
    more by the same argument, so large corpora don't meet in large buckets.
    """
    flip = "(-9223372036854775807L - 1L)"
    turn = ", ".join(
        f"named_struct('block', {i}, 'turned', "
        + (f"(shiftleft(fp, {b}) | shiftrightunsigned(fp, {64 - b}))" if b else "fp")
        + ")"
        for i, b in enumerate(BLOCKS)
    )
    last = len(BLOCKS) - 1
    keyed = prints.select("fp", "low", F.expr(f"inline(array({turn}))")).selectExpr(
        "fp", "low", "turned", f"block * 8192 + cast(shiftrightunsigned(turned, IF(block = {last}, 52, 51)) AS int) AS main"
    )
    large = keyed.groupBy("main").count().where(F.col("count") > SPLIT_ABOVE).select("main", F.lit(True).alias("big"))

    def subs(blocks: tuple[tuple[int, int], ...]) -> str:
        keys = ", ".join(
            f"{i * 2048 + 2048}L + (shiftrightunsigned(turned, {64 - at - n}) & {(1 << n) - 1}L)"
            for i, (at, n) in enumerate(blocks)
        )
        return f"array({keys})"

    again = f"IF(main >= {last * 8192}, {subs(LAST_SUB_BLOCKS)}, {subs(SUB_BLOCKS)})"
    # at most 36,864 rows, whatever the input: the number of main buckets
    dealt = keyed.join(F.broadcast(large), "main", "left").selectExpr(
        "fp", "low", "turned", "main", f"explode(IF(big, {again}, array(0L))) AS sub"
    )
    buckets = dealt.selectExpr("main * 16384L + sub AS bucket", f"turned ^ {flip} AS turned", "fp", "low")
    ordered = buckets.repartition("bucket").sortWithinPartitions("bucket", "turned")
    return ordered.mapInArrow(_bucket_links, "a_low long, a long, b_low long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """SimHash fingerprints and near-duplicate groups of whole texts.

    Equal fingerprints meet once, as one trie leaf.  Returns one row per input
    row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest
    ``doc_id`` reachable over links of at most four differing bits).  Null and
    wordless texts have fingerprint zero and link like any other; repeated rows
    each get their row; null ids come after all others, so ``component_id`` is null
    only where a group has no other; an empty table gives none; other columns are
    ignored.
    """
    rows, total, leaf = _grouped(id_text(docs).mapInArrow(_fingerprints, "doc_id long, fp long"))
    out = learn(rows, leaf, ["fp"], total)
    low = F.col("component.low")
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(low != LAST_ID, low).alias("component_id"),
    )


def _grouped(rows: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """The rows of fingerprints ``fp``, materialised; their number; and each distinct print's ``n`` and ``component``.

    A component is named by its least ``low`` (id) and then ``fp``, so its name tells
    its smallest id and no group has to meet to find it.
    """
    rows = written(rows)
    distinct = written(rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(LAST_ID))).alias("low"), F.count("*").alias("n")))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    node = lambda side: F.struct(F.col(f"{side}_low").alias("low"), F.col(side).alias("fp")).alias(side)
    groups = connected_components(near_links(distinct).select(node("a"), node("b")))
    groups = groups.select(F.col("id.fp").alias("id"), "component")
    leaf = distinct.join(groups, distinct["fp"] == groups["id"], "left")
    return rows, total, leaf.select("fp", "n", F.coalesce("component", F.struct("low", "fp")).alias("component"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document has the smallest id of its group, columns unchanged.

    A null id comes last; of different texts under the smallest id, that of the least digest stays.
    """
    texts = id_text(docs).withColumn("digest", text_digest(F.col("text")))
    rows, total, leaf = _grouped(texts.mapInArrow(_fingerprints, "doc_id long, fp long, digest string"))
    first = F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "digest")).alias("first")
    # combined before the shuffle, so a large group costs one row a task
    keep = learn(rows, leaf, ["fp"], total).groupBy("component").agg(first).select("first.doc_id", "first.digest")
    return rows_of(docs, keep, text_digest(docs["text"]))
