"""Grids from points, coordinates, boxes and meshes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.spatial import IJK, KEY, Triple, nearest, triple, with_box

from .grids import META_SCHEMA, VOXEL_SCHEMA, Grids, check_columns, listed_meta, shared_grids, shared_meta

#: Fixed value: spacing in voxels of the samples taken on triangles.  With it go the rules, fixed too, that an edge of
#: length l has ceil(l / spacing + 1) samples and that those on and beyond the third edge are mirrored back.
MESH_SPACING = 3.0**0.5 / 3.0


def _over(frame: DataFrame, size: Triple, origin: Triple, grids: Grids | None) -> Grids:
    """A carrier of the transforms: of given grids, or one for all."""
    return grids or Grids(shared_meta(frame, size, origin), frame.select("grid_id"), (triple(size), triple(origin)))


def from_points(points: DataFrame, size: Triple = 1.0, origin: Triple = 0.0, like: Grids | None = None) -> Grids:
    """The voxels nearest to the points ``grid_id, x, y, z``; transforms are shared, or those of ``like``."""
    base = _over(check_columns(points, "grid_id", "x", "y", "z"), size, origin, like)
    v = base.world_to_voxel(points.select(F.col("grid_id").cast("int").alias("grid_id"), "x", "y", "z"))
    return base.with_voxels(v.select("grid_id", *[nearest(F.col("v" + a)).alias(n) for a, n in zip("xyz", IJK)]).distinct())


def from_nearest_voxels_to_points(points: DataFrame, size: Triple = 1.0, origin: Triple = 0.0, like: Grids | None = None) -> Grids:
    """The eight voxels around every point."""
    base = _over(check_columns(points, "grid_id", "x", "y", "z"), size, origin, like)
    v = base.world_to_voxel(points.select(F.col("grid_id").cast("int").alias("grid_id"), "x", "y", "z"))
    cells = v.select("grid_id", *[F.floor("v" + a).cast("int").alias(n) for a, n in zip("xyz", IJK)]).distinct()
    return base.with_voxels(shifted(cells, (0, 0, 0), (1, 1, 1)))


def shifted(voxels: DataFrame, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    """Distinct voxels at all offsets of a box from the given ones: axis by axis, so few rows are made."""
    for a, name in enumerate(IJK):
        if low[a] == high[a] == 0:
            continue
        own = F.explode(F.sequence(F.col(name) + low[a], F.col(name) + high[a])).alias(name)
        voxels = voxels.select("grid_id", *[own if n == name else n for n in IJK]).distinct()
    return voxels


def from_ijk(ijk: DataFrame, size: Triple = 1.0, origin: Triple = 0.0) -> Grids:
    """The distinct coordinates ``grid_id, i, j, k``."""
    v = check_columns(ijk, *KEY).select(*[F.col(c).cast("int").alias(c) for c in KEY]).distinct()
    return shared_grids(v, v, size, origin)


def from_dense(
    spark: SparkSession, num_grids: int, dims: Sequence[int], low: Sequence[int] = (0, 0, 0), size: Triple = 1.0,
    origin: Triple = 0.0, mask: DataFrame | None = None,
) -> Grids:
    """Boxes ``low + [0, dims)``; ``mask`` (i, j, k from the box's corner) keeps the same voxels in every grid."""
    nx, ny, nz = dims
    if min(dims) < 1 or num_grids < 1:
        raise ValueError("grids and dimensions must be positive")
    n = spark.range(num_grids * nx * ny * nz).withColumn("grid_id", F.expr(f"cast(id div {nx * ny * nz} AS int)"))
    n = n.selectExpr(
        "grid_id", f"cast(id div {ny * nz} % {nx} AS int) AS i", f"cast(id div {nz} % {ny} AS int) AS j", f"cast(id % {nz} AS int) AS k"
    )
    if mask is not None:
        n = n.join(check_columns(mask, *IJK).select(*IJK).distinct(), IJK, "left_semi")
    v = n.select("grid_id", *[(F.col(a) + d).alias(a) for a, d in zip(IJK, low)])
    ids = spark.range(num_grids).select(F.col("id").cast("int").alias("grid_id"))
    return shared_grids(ids, v, size, origin)


def from_dense_axis_aligned_bounds(
    spark: SparkSession, num_grids: int, dims: Sequence[int], low: Triple = 0.0, high: Triple = 1.0, centred: bool = False
) -> Grids:
    """A box of voxels that fills world bounds; if ``centred``, the outer voxels' centres lie on the bounds."""
    low, high = triple(low), triple(high)
    if any(h <= a for a, h in zip(low, high)):
        raise ValueError("the upper bound must be larger than the lower")
    if centred and min(dims) < 2:
        raise ValueError("centred bounds need two voxels on each axis")
    size = tuple((h - a) / (n - 1 if centred else n) for a, h, n in zip(low, high, dims))
    origin = tuple(a if centred else a + 0.5 * s for a, s in zip(low, size))
    return from_dense(spark, num_grids, dims, (0, 0, 0), size, origin)


def from_mesh(vertices: DataFrame, faces: DataFrame, size: Triple = 1.0, origin: Triple = 0.0) -> Grids:
    """Voxels near the surface of triangles.

    ``vertices`` has ``grid_id, v_id, x, y, z``; ``faces`` has ``grid_id, v0, v1, v2``.
    Each triangle is sampled on a lattice of its two edges, ``MESH_SPACING``
    voxels apart or less; samples on and beyond the third edge are folded back.
    """
    base = _over(check_columns(vertices, "grid_id", "v_id", "x", "y", "z"), size, origin, None)
    v = base.world_to_voxel(vertices.select(F.col("grid_id").cast("int").alias("grid_id"), "v_id", "x", "y", "z"))
    t = check_columns(faces, "grid_id", "v0", "v1", "v2").select(F.col("grid_id").cast("int").alias("grid_id"), "v0", "v1", "v2")
    for n in range(3):
        corner = v.select("grid_id", F.col("v_id").alias(f"v{n}"), *[F.col("v" + a).alias(f"{a}{n}") for a in "xyz"])
        t = t.join(corner, ["grid_id", f"v{n}"])
    for e, n in (("e", 1), ("f", 2)):
        t = t.withColumns({f"{e}{a}": F.col(f"{a}{n}") - F.col(f"{a}0") for a in "xyz"})
    def count(e):
        length = F.sqrt(sum(F.col(f"{e}{a}") * F.col(f"{e}{a}") for a in "xyz"))
        return F.ceil((length + MESH_SPACING) / MESH_SPACING).cast("int")

    t = t.withColumns({"nu": count("e"), "nv": count("f")})
    t = t.withColumn("a", F.explode(F.expr("sequence(0, nu - 1)"))).withColumn("b", F.explode(F.expr("sequence(0, nv - 1)")))
    t = t.withColumns({"u": F.expr("IF(nu = 1, 0.0D, a / (nu - 1))"), "v": F.expr("IF(nv = 1, 0.0D, b / (nv - 1))")})
    t = t.withColumns({"p": F.expr("IF(u + v >= 1, 1 - u, u)"), "q": F.expr("IF(u + v >= 1, 1 - v, v)")})
    at = [nearest(F.col(f"{a}0") + F.col("p") * F.col(f"e{a}") + F.col("q") * F.col(f"f{a}")).alias(n) for a, n in zip("xyz", IJK)]
    return base.with_voxels(t.select("grid_id", *at).distinct())


def from_zero_grids(spark: SparkSession) -> Grids:
    """No grids."""
    return Grids(spark.createDataFrame([], META_SCHEMA), spark.createDataFrame([], VOXEL_SCHEMA))


def from_zero_voxels(spark: SparkSession, sizes: Sequence[Triple] = (1.0,), origins: Sequence[Triple] = (0.0,)) -> Grids:
    """Grids without voxels."""
    return Grids(listed_meta(spark, sizes, origins), spark.createDataFrame([], VOXEL_SCHEMA), None, True)


def concatenate(batches: Sequence[tuple[Grids, int]]) -> Grids:
    """Batches one after the other, each with its number of grids; ids are shifted."""
    shift, metas, voxels = 0, [], []
    for g, n in batches:
        metas.append(g.meta.withColumn("grid_id", F.col("grid_id") + shift))
        voxels.append(g.voxels.withColumn("grid_id", F.col("grid_id") + shift))
        shift += n
    meta, vox = metas[0], voxels[0]
    for m, v in zip(metas[1:], voxels[1:]):
        meta, vox = meta.unionByName(m), vox.unionByName(v)
    return Grids(meta, vox, None, all(g.listed for g, _ in batches))
