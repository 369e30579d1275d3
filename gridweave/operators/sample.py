"""Interpolation of voxel features at points and its adjoint, splatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.spatial import IJK, KEY, TRANSFORM, nearest, with_box

from .grids import Grids, check_columns

AXES = tuple(zip("xyz", IJK))


def _trilinear(a: str, i: str) -> tuple[Column, Column]:
    """Weight of a corner on one axis and its derivative, by the fraction ``f{a}``."""
    u = F.col("f" + a)
    high = F.col("d" + i) == 1
    return F.when(high, u).otherwise(1 - u), F.when(high, F.lit(1.0)).otherwise(F.lit(-1.0))


def _bezier(a: str, i: str) -> tuple[Column, Column]:
    """Quadratic spline weight (twice the unit spline, by convention) by the distance to the voxel, and its derivative."""
    t = F.col("d" + i) - F.col("f" + a)
    near, far = F.abs(t) < 0.5, F.abs(t) < 1.5
    w = F.when(near, 1.5 - 2 * t * t).when(far, (1.5 - F.abs(t)) * (1.5 - F.abs(t))).otherwise(0.0)
    d = F.when(near, 4 * t).when(far, F.signum(t) * (3 - 2 * F.abs(t))).otherwise(0.0)
    return w, d


def stencil(points: DataFrame, g: Grids, kind: str, grad: bool = False) -> DataFrame:
    """A row for each point and voxel around it, with weight ``w`` (and derivatives ``wx, wy, wz`` in world units).

    ``trilinear`` has the 8 voxels around a point; ``bezier`` the 27 around its
    nearest.  Points keep their other columns.
    """
    if kind not in ("trilinear", "bezier"):
        raise ValueError(f"unknown kernel {kind!r}")
    v = g.world_to_voxel(points)
    base = {i: (F.floor("v" + a).cast("int") if kind == "trilinear" else nearest(F.col("v" + a))) for a, i in AXES}
    v = v.withColumns({"b" + i: c for i, c in base.items()})
    v = v.withColumns({"f" + a: F.col("v" + a) - F.col("b" + i) for a, i in AXES})
    low, high, axis = ((0, 0, 0), (1, 1, 1), _trilinear) if kind == "trilinear" else ((-1,) * 3, (1,) * 3, _bezier)
    v = with_box(v, low, high, tap="tap")
    parts = {a: axis(a, i) for a, i in AXES}
    out = {i: F.col("b" + i) + F.col("d" + i) for _, i in AXES}
    out["w"] = parts["x"][0] * parts["y"][0] * parts["z"][0]
    if grad:
        v = g.attach(v)
        for a, s in zip("xyz", TRANSFORM):
            x, y = [parts[o][0] for o in "xyz" if o != a]
            out["w" + a] = parts[a][1] * x * y / F.col(s)
    v = v.withColumns(out)
    return v.drop(*TRANSFORM, *["v" + a for a in "xyz"], *["f" + a for a in "xyz"], *["b" + i for i in IJK], *["d" + i for i in IJK])


def sample(
    points: DataFrame, g: Grids, features: DataFrame, values: Sequence[str] = ("f",), kind: str = "trilinear",
    grad: bool = False, id_column: str = "point_id",
) -> DataFrame:
    """Weighted sums of features around points ``grid_id, id_column, x, y, z``; inactive voxels count as 0.

    With ``grad``, each value ``f`` gets ``f_dx, f_dy, f_dz``.  Weights are summed
    by point after one join on the voxel key.
    """
    check_columns(points, "grid_id", id_column, "x", "y", "z")
    s = stencil(points.select("grid_id", id_column, "x", "y", "z"), g, kind, grad)
    rows = s.join(check_columns(features, *KEY, *values).select(*KEY, *values), KEY)
    aggs = []
    for f in values:
        aggs.append(F.sum(F.col("w") * F.col(f)).alias(f))
        if grad:
            aggs += [F.sum(F.col("w" + a) * F.col(f)).alias(f"{f}_d{a}") for a in "xyz"]
    got = rows.groupBy("grid_id", id_column).agg(*aggs)
    names = [c for c in got.columns if c not in ("grid_id", id_column)]
    out = points.select("grid_id", id_column).join(got, ["grid_id", id_column], "left")
    return out.select("grid_id", id_column, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def sample_nearest(
    points: DataFrame, g: Grids, features: DataFrame, values: Sequence[str] = ("f",), id_column: str = "point_id"
) -> DataFrame:
    """Features of the nearest active one of the 8 voxels around each point; the first in order of equals, 0 for none."""
    check_columns(points, "grid_id", id_column, "x", "y", "z")
    v = g.world_to_voxel(points.select("grid_id", id_column, "x", "y", "z"))
    v = with_box(v, (0, 0, 0), (1, 1, 1)).withColumns({i: F.floor("v" + a).cast("int") + F.col("d" + i) for a, i in AXES})
    v = v.withColumn("d2", sum((F.col("v" + a) - F.col(i)) * (F.col("v" + a) - F.col(i)) for a, i in AXES))
    rows = v.select(*KEY, id_column, "d2", "tap").join(check_columns(features, *KEY, *values).select(*KEY, *values), KEY)
    best = rows.groupBy("grid_id", id_column).agg(F.min_by(F.struct(*values), F.struct("d2", "tap")).alias("b"))
    out = points.select("grid_id", id_column).join(best, ["grid_id", id_column], "left")
    return out.select("grid_id", id_column, *[F.coalesce(F.col("b")[f], F.lit(0.0)).alias(f) for f in values])


def splat(
    points: DataFrame, g: Grids, values: Sequence[str] = ("f",), kind: str = "trilinear"
) -> DataFrame:
    """For each voxel the weighted sum of the values of points ``grid_id, x, y, z, values...`` around it; 0 for none.

    Partial sums by voxel are taken before the shuffle; voxels join the sums, not
    the points.
    """
    check_columns(points, "grid_id", "x", "y", "z", *values)
    s = stencil(points.select("grid_id", "x", "y", "z", *values), g, kind)
    sums = s.groupBy(*KEY).agg(*[F.sum(F.col("w") * F.col(f)).alias(f) for f in values])
    out = g.voxels.join(sums, KEY, "left")
    return out.select(*KEY, *[F.coalesce(f, F.lit(0.0)).alias(f) for f in values])


def sample_adjoint(points: DataFrame, g: Grids, grad_values: Sequence[str] = ("f",), kind: str = "trilinear") -> DataFrame:
    """Gradient of sampling by the features: the splat of the gradients at the points."""
    return splat(points, g, grad_values, kind)


def splat_adjoint(points: DataFrame, g: Grids, grad_features: DataFrame, values=("f",), kind: str = "trilinear", id_column: str = "point_id") -> DataFrame:
    """Gradient of splatting by the points' values: the sample of the gradients of the voxels."""
    return sample(points, g, grad_features, values, kind, id_column=id_column)


def sample_grad_adjoint(
    points: DataFrame, g: Grids, value: str = "f", slopes: Sequence[str] = ("gx", "gy", "gz"), kind: str = "trilinear"
) -> DataFrame:
    """Gradient of sampling with gradients: value and slope weights go back to the voxels together."""
    check_columns(points, "grid_id", "x", "y", "z", value, *slopes)
    s = stencil(points.select("grid_id", "x", "y", "z", value, *slopes), g, kind, True)
    total = F.col("w") * F.col(value) + sum(F.col("w" + a) * F.col(n) for a, n in zip("xyz", slopes))
    sums = s.groupBy(*KEY).agg(F.sum(total).alias(value))
    return g.voxels.join(sums, KEY, "left").select(*KEY, F.coalesce(value, F.lit(0.0)).alias(value))
