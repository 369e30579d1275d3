"""Operator 8: embedding near-dedup by a forest of random-projection trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, connected_components, learn, written

COSINE = 0.95
#: Trees, vectors aimed at per leaf, half width of the zone around a split that goes to both sides.
TREES, LEAF, SPILL = 5, 400, 0.02
#: Vectors the splits are fitted on, and the least number of them for a split of its own.
FIT_VECTORS, FIT_LEAST = 4096, 8
#: Vectors of a leaf compared in one piece; larger leaves are compared block against block.
BLOCK = 4000
#: Rows of a leaf compared with all others at once, and leaves whose members are compared at once.
ROWS, NAMES = 512, 1024


@dataclass
class Forest:
    """Directions by tree and level, thresholds by tree and node, and by level where a node has none."""

    directions: np.ndarray
    nodes: list[dict[int, float]]
    levels: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, trees: int, seed: int = 8) -> Forest:
        """Random splits at medians, recursively, on a sample of unit vectors."""
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        directions = rng.normal(size=(trees, depth, dim))
        directions /= np.linalg.norm(directions, axis=2, keepdims=True)
        nodes, levels = [], np.zeros((trees, depth))
        for t in range(trees):
            node, own = np.ones(len(sample), np.int64), {}
            for d in range(depth):
                p = sample @ directions[t, d]
                levels[t, d] = np.median(p) if len(p) else 0.0
                cut_at = np.full(len(p), levels[t, d])
                order = np.argsort(node, kind="stable")
                for rows in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                    if len(rows) >= FIT_LEAST:
                        own[int(node[rows[0]])] = cut_at[rows] = np.median(p[rows])
                node = node * 2 + (p > cut_at)
            nodes.append(own)
        return cls(directions, nodes, levels)

    def leaves(self, x: np.ndarray, spill: float) -> list[list[int]]:
        """The leaves each unit vector belongs to, in all trees, in rising order; numbers tell trees apart."""
        out: list[list[int]] = [[] for _ in x]
        for t, (directions, own) in enumerate(zip(self.directions, self.nodes)):
            row, node = np.arange(len(x)), np.ones(len(x), np.int64)
            ids = np.array(sorted(own), np.int64)
            at = np.array([own[int(i)] for i in ids])
            for d, direction in enumerate(directions):
                p = (x @ direction)[row]
                split = np.full(len(row), self.levels[t, d])
                if len(ids):
                    k = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                    split = np.where(ids[k] == node, at[k], split)
                left, right = p <= split + spill, p > split - spill
                row = np.concatenate([row[left], row[right]])
                node = np.concatenate([node[left] * 2, node[right] * 2 + 1])
            for r, n in zip(row.tolist(), (node + (t << 44)).tolist()):
                out[r].append(n)
        return [sorted(x) for x in out]


def _matrix(vectors: pa.ListArray, dim: int) -> np.ndarray:
    sizes = vectors.value_lengths().to_numpy()
    flat = vectors.flatten().to_numpy().astype(np.float64)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare_leaf(leaf: int, mult, block, x: np.ndarray, leaves: list[list[int]], least: float):
    """Links within one leaf, or between two blocks of it.

    A pair that also shares a leaf of a smaller number is counted there.  Returns
    for each vector with links its index, the number of vectors it newly links to
    (each as often as it occurs) and the index that names its group here: as many
    rows as vectors, however many pairs link.
    """
    n = len(mult)
    norms = np.linalg.norm(x, axis=1)
    two = len(set(block.tolist())) > 1
    linked = np.zeros((n, n), bool)
    for a in range(0, n, ROWS):
        part = slice(a, a + ROWS)
        near = (x[part] @ x.T) / (norms[part, None] * norms[None]) >= least
        if two:
            near &= block[part, None] != block[None]
        near[np.arange(len(near)), np.arange(a, a + len(near))] = False
        linked[part] = near
    labels = _least_reached(linked)
    rows = np.flatnonzero(linked.any(1))
    fresh = linked[np.ix_(rows, rows)]
    del linked
    _drop_shared(fresh, [[v for v in leaves[i] if v < leaf] for i in rows])
    counts = np.zeros(n, np.int64)
    for a in range(0, len(rows), ROWS):
        counts[rows[a : a + ROWS]] = fresh[a : a + ROWS] @ mult[rows]
    told = np.flatnonzero((counts > 0) | (labels != np.arange(n)))
    return told, counts[told], labels[told]


def _drop_shared(pairs: np.ndarray, own: list[list[int]]) -> None:
    """Clear the pairs that have a leaf in common, in place; ``own`` lists each one's leaves.

    Leaves are taken ``NAMES`` at a time, as columns of ones whose products count what
    two vectors share, so memory doesn't grow with the number of leaves.
    """
    if not len(own):
        return
    of = np.repeat(np.arange(len(own)), [len(some) for some in own])
    names, col, seen = np.unique(np.fromiter((v for some in own for v in some), np.int64, len(of)), return_inverse=True, return_counts=True)
    wide = np.flatnonzero(seen > 1)  # a leaf that one vector alone is in is not shared
    place = np.full(len(names), -1)
    place[wide] = np.arange(len(wide))
    col = place[col]
    for a in range(0, len(wide), NAMES):
        here = (col >= a) & (col < a + NAMES)
        member = np.zeros((len(own), min(NAMES, len(wide) - a)), np.float32)
        member[of[here], col[here] - a] = 1
        for r in range(0, len(own), ROWS):
            part = slice(r, r + ROWS)
            if pairs[part].any():
                pairs[part] &= member[part] @ member.T == 0


def _least_reached(linked: np.ndarray) -> np.ndarray:
    """The least index reachable from each one by a symmetric relation."""
    labels = np.arange(len(linked))
    rows = np.flatnonzero(linked.any(1))
    if not len(rows):
        return labels
    inner = linked[np.ix_(rows, rows)]
    own = np.arange(len(rows))
    while True:
        new = own.copy()
        for a in range(0, len(rows), ROWS):
            part = slice(a, a + ROWS)
            new[part] = np.minimum(own[part], np.where(inner[part], own[None], len(rows)).min(1))
        while (up := new[new]).tobytes() != new.tobytes():
            new = up
        if (new == own).all():
            break
        own = new
    labels[rows] = rows[own]
    return labels


def vector_links(vectors: DataFrame, least: float = COSINE, trees: int = TREES, spill: float = SPILL) -> DataFrame:
    """Links of cosine at least ``least`` among all vectors, and the groups they make.

    Equal vectors are compared once and counted as often as they occur.  The
    forest's splits are fitted on ``FIT_VECTORS`` vectors; all vectors are routed,
    those near a split to both sides, and compared in double precision with all
    others of their leaves.  Leaves of more than ``BLOCK`` vectors are compared
    block against block in separate groups.  What comes out is one row per vector and
    leaf; no pairs are written.

    Returns ``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row.  Null and
    zero vectors and those with null or non-finite parts link with nothing.
    Shorter vectors count as padded with zeros.  Repeated rows are vectors of their
    own that link with each other; so do equal vectors under several ids.  Null ids
    come after all others: ``component_id`` is null only where a group has no other id,
    and its rows are ``kept``.  Other columns are ignored; an empty table gives no rows.
    """
    # single precision stays as it is on the way, and widens without loss where it is used
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast(f"array<{kind}>").alias("v"))
    fine = F.expr("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(v, x -> x <> 0)")
    fine = F.coalesce(fine, F.lit(False))
    good = rows.where(fine)
    # a vector is told by its smallest id and a hash, since one id may stand for several vectors
    distinct = good.groupBy("v").agg(F.min(F.coalesce("vec_id", F.lit(LAST_ID))).alias("rep"), F.count("*").alias("mult")).withColumn("h", F.xxhash64("v"))
    known = distinct.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.sum("mult").alias("total")).first()
    dim = known.dim or 1
    depth = max(0, int(np.ceil(np.log2(max(1, known.n) / LEAF))))
    sample = distinct.orderBy("h", "rep").limit(FIT_VECTORS).select("v").toArrow()["v"].combine_chunks()
    forest = Forest.fit(_unit(_matrix(sample, dim)) if len(sample) else np.zeros((0, dim)), depth, trees)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = forest.leaves(_unit(_matrix(b.column("v"), dim)), spill) if b.num_rows else []
            cols = [*(b.column(c) for c in ("rep", "h", "mult", "v")), pa.array(leaves, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["rep", "h", "mult", "v", "leaves"])

    routed = written(distinct.select("rep", "h", "mult", "v").mapInArrow(route, f"rep long, h long, mult long, v array<{kind}>, leaves array<long>"))
    placed = routed.select("rep", "h", "mult", "v", "leaves", F.explode("leaves").alias("leaf"))
    large = placed.groupBy("leaf").count().where(F.col("count") > BLOCK)
    large = large.select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        placed.join(large, "leaf", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.expr("cast(pmod(h, blocks) AS int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumns({"b1": F.least("block", "other"), "b2": F.greatest("block", "other")})
        .select("leaf", "b1", "b2", "rep", "h", "mult", "block", "v", "leaves")
    )
    ordered = dealt.repartition("leaf", "b1", "b2").sortWithinPartitions("leaf", "b1", "b2", "rep", "h")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_leaf(batches):
            leaf, rep, h, mult, block = (t.column(c).to_numpy() for c in ("leaf", "rep", "h", "mult", "block"))
            x = _matrix(t.column("v").combine_chunks(), dim)
            at, n, to = compare_leaf(int(leaf[0]), mult, block, x, t.column("leaves").to_pylist(), least)
            out = (rep[at], h[at], n, rep[to], h[to])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["rep", "h", "n", "to_rep", "to_h"])

    found = written(ordered.mapInArrow(compare, "rep long, h long, n long, to_rep long, to_h long"))
    sums = found.groupBy("rep", "h").agg(F.sum("n").alias("links"))
    node = F.struct("rep", "h")
    groups = connected_components(found.select(node.alias("a"), F.struct(F.col("to_rep").alias("rep"), F.col("to_h").alias("h")).alias("b")))
    groups = groups.select("id.rep", "id.h", F.col("component.rep").alias("component_id"))
    per = routed.select("rep", "h", "mult", "v").join(sums, ["rep", "h"], "left").join(groups, ["rep", "h"], "left")
    per = per.select("v", F.col("mult").alias("n"), F.expr("mult - 1 + coalesce(links, 0)").alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = learn(good, written(per), ["v"], known.total or 0).select("vec_id", "n_links", F.when(F.col("component_id") != LAST_ID, F.col("component_id")).alias("component_id"))
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("*", F.expr("vec_id <=> component_id").alias("kept"))


def _by_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one leaf and pair of blocks each, from rows in that order."""
    held: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(c)[i].as_py() for c in ("leaf", "b1", "b2"))

    for b in batches:
        k = np.stack([b.column(c).to_numpy() for c in ("leaf", "b1", "b2")])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            part = b.slice(a, z - a)
            if held and part.num_rows and key(held[0], 0) != key(part, 0):
                yield pa.Table.from_batches(held)
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


#: All pairs, for small tables.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.c),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, m.vec_id = m.component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""
