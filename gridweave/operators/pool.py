"""Pooling, refinement of values, injection between grids, and dense boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.spatial import IJK, KEY, floor_div, triple, with_box

from .grids import Grids, check_columns, meet
from .topology import coarsened_grid, refined_grid


def _windows(features: DataFrame, pool, stride, values: Sequence[str]) -> DataFrame:
    """Rows of features by the coarse windows ``stride * coarse + [0, pool)`` they fall in.

    Windows that don't overlap take one projection; else each value goes to the
    windows of every offset that divides.
    """
    f = check_columns(features, *KEY, *values).select(*KEY, *values)
    if pool == stride:
        return f.withColumns({"c" + a: floor_div(F.col(a), s) for a, s in zip(IJK, stride)})
    f = with_box(f, (0, 0, 0), [p - 1 for p in pool])
    for a, s in zip(IJK, stride):
        own = F.col(a) - F.col("d" + a)
        f = f.where(F.pmod(own, F.lit(s)) == 0).withColumn("c" + a, floor_div(own, s))
    return f


def _pooled(g: Grids, features: DataFrame, pool, stride, coarse: Grids | None, values, aggs, empty) -> tuple[Grids, DataFrame]:
    pool = triple(pool)
    stride = pool if not stride else triple(stride)
    if min(pool) < 1 or min(stride) < 1:
        raise ValueError("pool and stride must be positive")
    coarse = coarse or coarsened_grid(g, stride)
    w = _windows(features, pool, stride, values).drop(*IJK, "di", "dj", "dk", "tap")
    w = w.select("grid_id", *[F.col("c" + a).alias(a) for a in IJK], *values).groupBy(*KEY).agg(*aggs(pool))
    out = coarse.voxels.join(w, KEY, "left").select(*KEY, *[F.coalesce(v, F.lit(empty)).alias(v) for v in values])
    return coarse, out


def max_pool(g: Grids, features: DataFrame, pool, stride=0, coarse: Grids | None = None, values=("f",)) -> tuple[Grids, DataFrame]:
    """Largest value of each window; minus infinity where none is active."""
    return _pooled(g, features, pool, stride, coarse, values, lambda p: [F.max(v).alias(v) for v in values], float("-inf"))


def avg_pool(g: Grids, features: DataFrame, pool, stride=0, coarse: Grids | None = None, values=("f",)) -> tuple[Grids, DataFrame]:
    """Sum over each window's active voxels divided by the window's whole volume."""
    aggs = lambda p: [(F.sum(v) / (p[0] * p[1] * p[2])).alias(v) for v in values]
    return _pooled(g, features, pool, stride, coarse, values, aggs, 0.0)


def max_pool_adjoint(features: DataFrame, grads: DataFrame, pool, stride=0, value: str = "f", grad: str = "g") -> DataFrame:
    """Gradient of max pooling by the fine values: each coarse gradient goes to its window's first largest voxel."""
    pool = triple(pool)
    stride = pool if not stride else triple(stride)
    w = _windows(features, pool, stride, [value])
    order = F.struct(F.col(value), *[-F.col(a) for a in IJK])
    top = w.groupBy("grid_id", *["c" + a for a in IJK]).agg(F.max_by(F.struct(*IJK), order).alias("at"))
    c = check_columns(grads, *KEY, grad).select("grid_id", *[F.col(a).alias("c" + a) for a in IJK], grad)
    sent = top.join(c, ["grid_id", *["c" + a for a in IJK]]).select("grid_id", *[F.col("at")[a].alias(a) for a in IJK], grad)
    sums = sent.groupBy(*KEY).agg(F.sum(grad).alias(grad))
    return features.select(*KEY).join(sums, KEY, "left").select(*KEY, F.coalesce(grad, F.lit(0.0)).alias(grad))


def avg_pool_adjoint(features: DataFrame, grads: DataFrame, pool, stride=0, grad: str = "g") -> DataFrame:
    """Gradient of average pooling: a window's gradient over its volume, to each of its voxels."""
    pool = triple(pool)
    stride = pool if not stride else triple(stride)
    w = _windows(features, pool, stride, [])
    c = check_columns(grads, *KEY, grad).select("grid_id", *[F.col(a).alias("c" + a) for a in IJK], grad)
    sums = w.join(c, ["grid_id", *["c" + a for a in IJK]]).groupBy(*KEY).agg((F.sum(grad) / (pool[0] * pool[1] * pool[2])).alias(grad))
    return features.select(*KEY).join(sums, KEY, "left").select(*KEY, F.coalesce(grad, F.lit(0.0)).alias(grad))


def refine(
    g: Grids, features: DataFrame, factor, mask: DataFrame | None = None, fine: Grids | None = None, values=("f",)
) -> tuple[Grids, DataFrame]:
    """Each fine voxel gets the value of the coarse one it lies in, 0 if there is none."""
    f = triple(factor)
    fine = fine or refined_grid(g, f, mask)
    at = fine.voxels.withColumns({"c" + a: floor_div(F.col(a), n) for a, n in zip(IJK, f)})
    c = check_columns(features, *KEY, *values).select("grid_id", *[F.col(a).alias("c" + a) for a in IJK], *values)
    out = at.join(c, ["grid_id", *["c" + a for a in IJK]], "left")
    return fine, out.select(*KEY, *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def refine_adjoint(g: Grids, grads: DataFrame, factor, grad: str = "g") -> DataFrame:
    """Gradient of refining: the sum over each coarse voxel's fine ones."""
    c = grads.select("grid_id", *[floor_div(F.col(a), n).alias(a) for a, n in zip(IJK, triple(factor))], grad)
    sums = c.groupBy(*KEY).agg(F.sum(grad).alias(grad))
    return g.voxels.join(sums, KEY, "left").select(*KEY, F.coalesce(grad, F.lit(0.0)).alias(grad))


def inject(dst: Grids, src: DataFrame, old: DataFrame | None = None, default: float = 0.0, values=("f",)) -> DataFrame:
    """Values of ``src`` where keys match, else those of ``old``, else the default, for every voxel of ``dst``."""
    s = check_columns(src, *KEY, *values).select(*KEY, *[F.col(v).alias("_n" + v) for v in values], F.lit(True).alias("_hit"))
    out = meet(dst.voxels, s, KEY, "left")
    if old is not None:
        out = meet(out, old.select(*KEY, *[F.col(v).alias("_o" + v) for v in values]), KEY, "left")
    rest = lambda v: F.coalesce("_o" + v, F.lit(default)) if old is not None else F.lit(default)
    return out.select(*KEY, *[F.when(F.col("_hit"), F.col("_n" + v)).otherwise(rest(v)).alias(v) for v in values])


def inject_from_ijk(dst: Grids, rows: DataFrame, old: DataFrame | None = None, default: float = 0.0, values=("f",), position: str = "pos") -> DataFrame:
    """As ``inject``, from coordinates that may repeat (the largest position wins) or miss (they are dropped)."""
    check_columns(rows, *KEY, position, *values)
    best = rows.groupBy(*KEY).agg(F.max_by(F.struct(*values), position).alias("b"))
    return inject(dst, best.select(*KEY, *[F.col("b")[v].alias(v) for v in values]), old, default, values)


def inject_from_dense(g: Grids, dense: DataFrame, origin: Sequence[int] = (0, 0, 0), values=("f",)) -> DataFrame:
    """Values of a dense box (``grid_id, x, y, z`` from ``origin``) at the voxels, 0 outside.

    Channel-minor and channel-major arrays are the same relation.
    """
    d = check_columns(dense, "grid_id", "x", "y", "z", *values)
    d = d.select("grid_id", *[(F.col(n) + o).cast("int").alias(a) for n, a, o in zip("xyz", IJK, origin)], *values)
    return inject(g, d, None, 0.0, values)


def inject_to_dense(
    spark: SparkSession, features: DataFrame, num_grids: int, low: Sequence[int], size: Sequence[int], values=("f",)
) -> DataFrame:
    """A dense box of each grid (``x, y, z`` from ``low``), 0 where there is no voxel."""
    nx, ny, nz = size
    if min(size) < 1:
        raise ValueError("an empty box")
    cells = spark.range(num_grids * nx * ny * nz).selectExpr(
        f"cast(id div {nx * ny * nz} AS int) AS grid_id", f"cast(id div {ny * nz} % {nx} AS int) AS x",
        f"cast(id div {nz} % {ny} AS int) AS y", f"cast(id % {nz} AS int) AS z",
    )
    f = check_columns(features, *KEY, *values)
    f = f.select("grid_id", *[(F.col(a) - lo).alias(n) for a, n, lo in zip(IJK, "xyz", low)], *values)
    out = cells.join(f, ["grid_id", "x", "y", "z"], "left")
    return out.select("grid_id", "x", "y", "z", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])


def dense_arrays(dense: DataFrame, values: Sequence[str] = ("f",), major: bool = False) -> DataFrame:
    """A dense relation as nested arrays by x-slab: channels inmost, or outermost in the slab if ``major``."""
    cell = F.struct("y", "z", *values)
    rows = dense.groupBy("grid_id", "x").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    if major:
        return rows.select("grid_id", "x", F.array(*[F.transform("cells", lambda c, v=v: c[v]) for v in values]).alias("slab"))
    return rows.select("grid_id", "x", F.transform("cells", lambda c: F.array(*[c[v] for v in values])).alias("slab"))
