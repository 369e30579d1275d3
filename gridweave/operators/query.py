"""Lookups of points, coordinates and neighbours: joins on the voxel key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.spatial import IJK, KEY, nearest, with_box

from .grids import Grids, check_columns, running_sums


def _flag(rows: DataFrame, g: Grids, name: str) -> DataFrame:
    """Whether each row's voxel is active."""
    return rows.join(g.voxels.select(*KEY, F.lit(True).alias(name)), KEY, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def points_in_grid(points: DataFrame, g: Grids, name: str = "inside") -> DataFrame:
    """Whether the voxel nearest to each point ``grid_id, x, y, z`` is active; other columns stay."""
    v = g.world_to_voxel(points).withColumns({n: nearest(F.col("v" + a)) for a, n in zip("xyz", IJK)})
    return _flag(v.drop("vx", "vy", "vz"), g, name)


def coords_in_grid(ijk: DataFrame, g: Grids, name: str = "active") -> DataFrame:
    """Whether each coordinate is active."""
    return _flag(check_columns(ijk, *KEY), g, name)


def _cubes(cubes: DataFrame, g: Grids, low, high, id_column: str, every: bool, name: str) -> DataFrame:
    check_columns(cubes, "grid_id", id_column, "x", "y", "z")
    base = cubes.select("grid_id", id_column, "x", "y", "z")
    ends = base.withColumns({f"{a}0": F.col(a) + d for a, d in zip("xyz", low)} | {f"{a}1": F.col(a) + d for a, d in zip("xyz", high)})
    for n in (0, 1):
        ends = g.world_to_voxel(ends, [f"{a}{n}" for a in "xyz"], [f"v{a}{n}" for a in "xyz"])
    for a, n in zip("xyz", IJK):
        lo, hi = nearest(F.col(f"v{a}0")), nearest(F.col(f"v{a}1"))
        ends = ends.withColumn(f"r{n}", F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")))
    probe = ends.select("grid_id", id_column, *[f"r{n}" for n in IJK])
    for n in IJK:
        probe = probe.withColumn(n, F.explode(f"r{n}"))
    found = _flag(probe.select("grid_id", id_column, *IJK), g, "on").groupBy("grid_id", id_column)
    told = found.agg((F.bool_and("on") if every else F.bool_or("on")).alias(name))
    return base.join(told, ["grid_id", id_column], "left").withColumn(name, F.coalesce(name, F.lit(every)))


def cubes_in_grid(cubes: DataFrame, g: Grids, low=(0, 0, 0), high=(0, 0, 0), id_column: str = "point_id") -> DataFrame:
    """Whether all voxels from the one nearest to centre + ``low`` to that of centre + ``high`` are active; true for none."""
    return _cubes(cubes, g, low, high, id_column, True, "inside")


def cubes_intersect_grid(cubes: DataFrame, g: Grids, low=(0, 0, 0), high=(0, 0, 0), id_column: str = "point_id") -> DataFrame:
    """Whether any of those voxels is active; false for none."""
    return _cubes(cubes, g, low, high, id_column, False, "touches")


def ijk_to_index(ijk: DataFrame, g: Grids, cumulative: bool = False) -> DataFrame:
    """Number of each coordinate's voxel in its grid, or in the batch if ``cumulative``; -1 if inactive."""
    v = g.indexed()
    if cumulative:
        v = v.join(g.offsets().select("grid_id", "joffset"), "grid_id").withColumn("idx", F.col("idx") + F.col("joffset")).drop("joffset")
    return check_columns(ijk, *KEY).join(v, KEY, "left").withColumn("idx", F.coalesce("idx", F.lit(-1).cast("long")))


def ijk_to_inv_index(ijk: DataFrame, g: Grids, position: str = "pos", cumulative: bool = False) -> DataFrame:
    """For each voxel the position of the query coordinate that names it, -1 if none, the largest of several.

    ``position`` numbers the queries within their grid; if ``cumulative``, those of
    earlier grids are counted before.
    """
    q = check_columns(ijk, *KEY, position)
    if cumulative:
        n = running_sums(q.groupBy("grid_id").agg(F.count("*").alias("n")), "grid_id", ["grid_id"], "n", "_before")
        q = q.join(n.drop("n"), "grid_id").withColumn(position, F.col(position) + F.col("_before"))
    best = q.groupBy(*KEY).agg(F.max(position).cast("long").alias("inv"))
    return g.voxels.join(best, KEY, "left").select(*KEY, F.coalesce("inv", F.lit(-1).cast("long")).alias("inv"))


def neighbor_rows(ijk: DataFrame, g: Grids, extent: int, bitshift: int = 0) -> DataFrame:
    """A row for each query and offset of the box of half width ``extent``: ``tap`` and ``idx`` (-1 if inactive)."""
    if extent < 0 or bitshift < 0:
        raise ValueError("extent and bitshift can't be negative")
    q = with_box(check_columns(ijk, *KEY), (-extent,) * 3, (extent,) * 3)
    at = {f"n{a}": F.shiftleft(F.col(a), bitshift) + F.col("d" + a) for a in IJK}
    v = g.indexed().select("grid_id", *[F.col(a).alias(f"n{a}") for a in IJK], "idx")
    rows = q.withColumns(at).join(v, ["grid_id", *at], "left").drop(*at, "di", "dj", "dk")
    return rows.withColumn("idx", F.coalesce("idx", F.lit(-1).cast("long")))


def neighbor_indexes(ijk: DataFrame, g: Grids, extent: int, bitshift: int = 0) -> DataFrame:
    """For each distinct query the indexes of its neighbours in x-major order, as an array."""
    rows = neighbor_rows(check_columns(ijk, *KEY).select(*KEY).distinct(), g, extent, bitshift).groupBy(*KEY)
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("tap", "idx"))), lambda s: s["idx"]).alias("neighbors"))


def active_in_bounds(g: Grids, low, high, name: str = "inside") -> DataFrame:
    """Whether each voxel lies within inclusive bounds."""
    test = F.lit(True)
    for a, lo, hi in zip(IJK, low, high):
        test = test & F.col(a).between(lo, hi)
    return g.voxels.withColumn(name, test)
