"""Surface extraction by marching cubes."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.spatial import IJK, KEY
from gridweave.sources.shared import written

from .grids import WHOLE, Grids, by_grids, check_columns, close_steps, meet, numbered

#: Values closer than this to the level, or to each other, snap to a corner.
SNAP = 1e-5
#: The two voxels of an edge.
EDGE = ["pi", "pj", "pk", "qi", "qj", "qk"]


@functools.cache
def case_triangles() -> list[list[tuple[tuple[int, int], ...]]]:
    """For each of the 256 cases the triangles, each of three cube edges (pairs of corners).

    Corners are numbered 4*di + 2*dj + dk; bit c of a case is set where corner c
    is inside.  On each face of the cube, crossed edges are joined around the inside
    corners, two adjacent ones together and two opposite ones apart, a rule that
    both cubes of a face follow alike.  The pieces form closed loops, which are cut
    into fans.
    """
    faces = []
    for axis in range(3):
        for side in (0, 1):
            u, v = (axis + 1) % 3, (axis + 2) % 3
            ring = []
            for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)):
                p = [0, 0, 0]
                p[axis], p[u], p[v] = side, a, b
                ring.append(4 * p[0] + 2 * p[1] + p[2])
            faces.append(ring if side else ring[::-1])  # counter-clockwise seen from outside
    cases = []
    for case in range(256):
        inside = [bool(case >> c & 1) for c in range(8)]
        follow = {}
        for ring in faces:
            for n in range(4):
                if inside[ring[n]] and not inside[ring[n - 1]]:
                    m = n  # the run of inside corners that begins here
                    while inside[ring[(m + 1) % 4]]:
                        m += 1
                    begin, end = (ring[n - 1], ring[n]), (ring[m % 4], ring[(m + 1) % 4])
                    follow[tuple(sorted(begin))] = tuple(sorted(end))
        triangles = []
        while follow:
            start, loop = next(iter(follow)), []
            at = start
            while at in follow:
                loop.append(at)
                at = follow.pop(at)
            triangles += [(loop[0], loop[n], loop[n + 1]) for n in range(1, len(loop) - 1)]
        cases.append(triangles)
    return cases


def marching_cubes(
    g: Grids, features: DataFrame, level: float = 0.0, value: str = "f", world: bool = True, edge_keys: bool = False
) -> tuple[DataFrame, ...]:
    """The surface where values cross ``level``: vertices ``grid_id, v_id, x, y, z`` and faces ``grid_id, f_id, v0, v1, v2``.

    Only cubes with all eight corners active are used.  A vertex lies on an edge between two voxels and is shared by all
    cubes there; vertices are numbered in order of their edge.  With ``edge_keys``,
    a third table tells each vertex's edge: ``grid_id``, ``v_id`` and the numbers, in the
    whole batch, of the edge's two voxels, ``voxel_a >= voxel_b``.  Grids of at most ``WHOLE`` voxels are
    solved whole in Arrow functions, many at a time, larger ones by windows and equi-joins.
    """
    f = check_columns(features, *KEY, value).select(*KEY, (F.col(value) - level).cast("double").alias("_v")).dropna(subset=KEY)
    sizes = f.groupBy("grid_id").agg(F.count("*").alias("size"))
    rows, most = sizes.agg(F.sum("size"), F.max("size")).first()
    key = EDGE if edge_keys else []
    if (most or 0) <= WHOLE:
        vert, faces = _small(f, rows or 0, key)
    else:
        large = written(sizes.where(F.col("size") > WHOLE).select("grid_id"))
        vert, faces = _small(meet(f, large, ["grid_id"], "left_anti"), rows, key)
        more = _large(meet(f, large, ["grid_id"], "left_semi"), key)
        vert, faces = vert.unionByName(more[0]), faces.unionByName(more[1])
    out = vert.select("grid_id", "v_id", "x", "y", "z")
    out = g.voxel_to_world(out, ("x", "y", "z")) if world else out
    return (out, faces, _edge_keys(g, vert.select("grid_id", "v_id", *key))) if edge_keys else (out, faces)


@functools.cache
def _case_arrays() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each case's triangles begin in a list of all cases' triangles; for the three edges of each in the list the
    lower corner and the direction, 0 along k, 1 along j, 2 along i."""
    cases = case_triangles()
    edges = np.array([t for ts in cases for t in ts])
    return np.cumsum([0, *map(len, cases)]), edges[:, :, 0], np.log2(edges[:, :, 1] - edges[:, :, 0]).astype(np.int64)


class _Surface:
    """The triangles of whole grids.

    ``rows`` are the voxels' rows in order of grid, i, j, k.  What follows names voxels by their place there: ``next``
    tells for each direction the next voxel (their number for none), ``cube`` the cube of each triangle, in order, and
    ``edge`` its three edges as ``3 * place + direction``.  ``used`` marks all edges that are crossed.
    """

    def __init__(self, t: pa.Table):
        grid, i, j, k = (t.column(c).to_numpy() for c in KEY)
        x, y, z = (s - s.min() for s in (close_steps(i, grid), close_steps(j), close_steps(k)))
        a, b = int(z.max()) + 2, (int(y.max()) + 2) * (int(z.max()) + 2)
        code = x * b + y * a + z
        order = np.argsort(code, kind="stable")
        last = np.append(np.diff(code[order]) != 0, True)  # of repeated voxels one counts
        self.rows, code = order[last], code[order[last]]
        self.grid, n = grid[self.rows], len(code)

        def following(d: int) -> np.ndarray:
            at = np.minimum(np.searchsorted(code, code + d), n - 1)
            return np.append(np.where(code[at] == code + d, at, n), n)

        nk, nj, ni = self.next = np.stack([following(d) for d in (1, a, b)])
        corners = np.stack([np.arange(n), *(c[:n] for c in (nk, nj, nk[nj], ni, nk[ni], nj[ni], nk[nj[ni]]))])
        corners = corners[:, corners.max(0) < n]
        inside = t.column("_v").to_numpy()[self.rows] < 0  # neither null nor NaN is
        case = (inside[corners] << np.arange(8)[:, None]).sum(0)
        begin, low, direction = _case_arrays()
        count = begin[case + 1] - begin[case]
        cube = np.repeat(np.arange(len(case)), count)
        triangle = np.arange(len(cube)) + np.repeat(begin[case] - (np.cumsum(count) - count), count)
        self.cube = corners[0, cube]
        self.edge = 3 * corners[low[triangle], cube[:, None]] + direction[triangle]
        self.used = np.zeros(3 * n, bool)
        self.used[self.edge] = True

    def vertices(self, t: pa.Table, key: Sequence[str]) -> pa.Table:
        p, direction = np.divmod(np.flatnonzero(self.used), 3)
        q = self.next[direction, p]
        grid = self.grid[p]
        column = t.column("_v")
        v, null = column.to_numpy()[self.rows], column.is_null().to_numpy()[self.rows]
        pv, qv = v[p], v[q]
        with np.errstate(invalid="ignore", over="ignore"):
            snapped = [np.abs(pv) < SNAP, np.abs(qv) < SNAP, np.abs(pv - qv) < SNAP]
            w = np.select(snapped, [0.0, 1.0, 0.0], -pv / np.where(snapped[2], 1.0, qv - pv))
        null = (null[p] | null[q]) & ~np.any(snapped, axis=0)
        at = [t.column(a).to_numpy()[self.rows] for a in IJK]
        out = {"grid_id": grid, "v_id": np.arange(len(grid)) - np.searchsorted(grid, grid)}
        out |= {n: pa.array(x[p] * (1 - w) + x[q] * w, pa.float64(), mask=null) for n, x in zip("xyz", at)}
        out |= {c: x for c, x in zip(EDGE, [x[e] for e in (p, q) for x in at]) if c in key}
        return pa.table(out)

    def faces(self) -> pa.Table:
        grid, first = self.grid[self.cube], self.grid[np.flatnonzero(self.used) // 3]
        v = (np.cumsum(self.used) - 1)[self.edge] - np.searchsorted(first, grid)[:, None]
        out = {"grid_id": grid, "f_id": np.arange(len(grid)) - np.searchsorted(grid, grid)}
        return pa.table(out | {f"v{e}": v[:, e] for e in range(3)})


def _small(f: DataFrame, rows: float, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Vertices, with the columns ``key`` of their edges, and faces, each made of whole grids: both read one shuffle."""
    kind = dict(f.dtypes)
    grid, ends = f"grid_id {kind['grid_id']}", "".join(f", {c} {kind[c[1]]}" for c in key)
    vert = by_grids(f, rows, lambda t: _Surface(t).vertices(t, key).to_batches(), f"{grid}, v_id long, x double, y double, z double{ends}")
    return vert, by_grids(f, rows, lambda t: _Surface(t).faces().to_batches(), f"{grid}, f_id long, v0 long, v1 long, v2 long")


def _large(f: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The same by windows and equi-joins.

    Cubes are put together axis by axis: voxels pair with the next one of their line, pairs with pairs, squares
    with squares, so every voxel crosses the network three times.
    """
    cubes = f.withColumn("vals", F.array("_v")).drop("_v")
    for a in reversed(IJK):
        # with the next voxel along the axis, if it is active: 1, 2, 4, then 8 corners, in order of their numbers
        line = Window.partitionBy("grid_id", *[c for c in IJK if c != a]).orderBy(a)
        cubes = cubes.withColumns({"_at": F.lead(a).over(line), "_next": F.lead("vals").over(line)})
        cubes = cubes.where(F.col("_at") == F.col(a) + 1).select(*KEY, F.concat("vals", "_next").alias("vals"))
    cubes = cubes.withColumn("case", sum(F.when(F.col("vals")[c] < 0, 1 << c).otherwise(0) for c in range(8)))
    cubes = cubes.where(F.col("case").between(1, 254))
    spark = f.sparkSession
    rows = [(case, n, *[x for e in t for x in e]) for case, ts in enumerate(case_triangles()) for n, t in enumerate(ts)]
    table = spark.createDataFrame(rows, "case int, t int, " + ", ".join(f"{s}{e} int" for e in range(3) for s in "ab"))
    # the case table has one row for each triangle of the 256 cases
    tri = cubes.select(*KEY, "case", "vals").join(F.broadcast(table), "case")

    def ends(e: int):
        out = []
        for s in "ab":
            c = F.col(f"{s}{e}")
            at = [(F.col(a) + F.floor(c / d).cast("int") % 2).alias(a) for a, d in zip(IJK, (4, 2, 1))]
            out.append(F.struct(*at, F.element_at("vals", c + 1).alias("v")))
        return F.struct(out[0].alias("p"), out[1].alias("q")).alias(f"e{e}")

    tri = tri.select(*KEY, "t", *[ends(e) for e in range(3)])
    cols = [F.col(f"x.{s}.{a}").alias(s + a) for s in "pq" for a in IJK]
    corner = tri.select(*KEY, "t", F.posexplode(F.array("e0", "e1", "e2")).alias("e", "x")).select(*KEY, "t", "e", *cols, F.col("x.p.v").alias("pv"), F.col("x.q.v").alias("qv"))
    # vertices are numbered where triangles name them, slab by slab
    corner = corner.withColumn("_r", F.dense_rank().over(Window.partitionBy("grid_id", "pi").orderBy(*EDGE[1:])))
    slabs = corner.groupBy("grid_id", "pi").agg(F.max("_r").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("grid_id").orderBy("pi").rowsBetween(Window.unboundedPreceding, -1))
    slabs = slabs.select("grid_id", "pi", F.coalesce(before, F.lit(0)).alias("_before"))
    corner = meet(corner, slabs, ["grid_id", "pi"]).withColumn("v_id", (F.col("_before") + F.col("_r") - 1).cast("long"))
    corner = written(corner.drop("_r", "_before"))  # vertices and faces are both made of it
    vert = corner.groupBy("grid_id", "v_id").agg(*[F.first(c).alias(c) for c in (*EDGE, "pv", "qv")])
    w2 = (
        F.when(F.abs("pv") < SNAP, 0.0).when(F.abs("qv") < SNAP, 1.0).when(F.abs(F.col("pv") - F.col("qv")) < SNAP, 0.0)
        .otherwise(-F.col("pv") / F.when(F.col("pv") != F.col("qv"), F.col("qv") - F.col("pv")))
    )
    vert = vert.withColumn("w", w2).withColumns({n: F.col("p" + a) * (1 - F.col("w")) + F.col("q" + a) * F.col("w") for n, a in zip("xyz", IJK)})
    faces = corner.groupBy(*KEY, "t").agg(*[F.max(F.when(F.col("e") == e, F.col("v_id"))).alias(f"v{e}") for e in range(3)])
    faces = numbered(faces, "i", ["j", "k", "t"], "f_id").select("grid_id", "f_id", "v0", "v1", "v2")
    return vert.select("grid_id", "v_id", "x", "y", "z", *key), faces


def _edge_keys(g: Grids, ids: DataFrame) -> DataFrame:
    """For each vertex the batch-wide numbers of the two voxels its edge joins, the larger first."""
    number = meet(g.indexed(), g.offsets().select("grid_id", "joffset"), ["grid_id"])
    number = number.select(*KEY, (F.col("idx") + F.col("joffset")).alias("n"))
    for s in "pq":
        own = number.select("grid_id", *[F.col(a).alias(s + a) for a in IJK], F.col("n").alias("n" + s))
        ids = meet(ids, own, ["grid_id", *[s + a for a in IJK]])
    return ids.select("grid_id", "v_id", F.greatest("np", "nq").alias("voxel_a"), F.least("np", "nq").alias("voxel_b"))
