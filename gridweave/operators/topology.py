"""Set algebra of voxels: union, masks, dilation, dual, coarser and finer grids, convolution supports, curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.spatial import IJK, KEY, floor_div, hilbert, morton, triple, with_box

from .build import shifted
from .grids import Grids, check_columns, meet

#: The twelve edges of a cube between corners numbered 4*di + 2*dj + dk.
CUBE_EDGES = ((0, 1), (0, 2), (0, 4), (1, 3), (1, 5), (2, 3), (2, 6), (3, 7), (4, 5), (4, 6), (5, 7), (6, 7))


def merged_grid(a: Grids, b: Grids) -> Grids:
    """Voxels of either batch, grid by grid; the first one's transforms stay."""
    return a.with_voxels(a.voxels.select(*KEY).union(b.voxels.select(*KEY)).distinct())


def pruned_grid(g: Grids, mask: DataFrame, keep: str = "keep") -> Grids:
    """Voxels whose row in ``mask`` is true."""
    return g.with_voxels(meet(g.voxels, check_columns(mask, *KEY, keep).where(F.col(keep)).select(*KEY), KEY, "left_semi"))


def _within(df: DataFrame, low, high) -> DataFrame:
    """Rows within inclusive bounds: three numbers each, or a table of bounds by grid in ``low``."""
    if isinstance(low, DataFrame):
        names = [f"min_{a}" for a in IJK] + [f"max_{a}" for a in IJK]
        df = df.join(check_columns(low, "grid_id", *names).select("grid_id", *names), "grid_id")
        for a in IJK:
            df = df.where(F.col(a).between(F.col(f"min_{a}"), F.col(f"max_{a}")))
        return df.drop(*names)
    for a, lo, hi in zip(IJK, low, high):
        df = df.where(F.col(a).between(lo, hi))
    return df


def clipped_grid(g: Grids, low, high=None) -> Grids:
    """Voxels within inclusive bounds, the same for all grids or a table ``grid_id, min_i, ..., max_k``."""
    return g.with_voxels(_within(g.voxels, low, high).select(*KEY))


def clip(g: Grids, features: DataFrame, low, high=None) -> tuple[Grids, DataFrame]:
    """The clipped grid and the features within."""
    return clipped_grid(g, low, high), _within(check_columns(features, *KEY), low, high).select(*features.columns)


def dilated_grid(g: Grids, by: int) -> Grids:
    """Voxels within ``by`` steps of the 26-neighbourhood: a cube's Minkowski sum, one axis at a time."""
    if by < 0:
        raise ValueError("a negative dilation")
    return g if by == 0 else g.with_voxels(shifted(g.voxels, (-by,) * 3, (by,) * 3))


def padded_grid(g: Grids, low: int, high: int, exclude_border: bool = False) -> Grids:
    """Voxels at offsets ``low..high`` from active ones; or only those whose whole box of offsets is active."""
    if low > 0 or high < 0 or low > high:
        raise ValueError("low <= 0 <= high is needed")
    if (low, high) == (0, 0):
        return g
    if not exclude_border:
        return g.with_voxels(shifted(g.voxels, (low,) * 3, (high,) * 3))
    v = g.voxels
    for a in IJK:  # a run along one axis, then of runs along the next: the box factors
        n = high - low + 1
        v = v.withColumn("_d", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(a, F.col(a) - F.col("_d"))
        v = v.groupBy(*KEY).agg(F.count("*").alias("_n")).where(F.col("_n") == n).select(*KEY)
    return g.with_voxels(v.join(g.voxels, KEY, "left_semi"))


def dual_grid(g: Grids, exclude_border: bool = False) -> Grids:
    """The voxels' corners; the transform moves by half a voxel."""
    p = padded_grid(g, 0, 1, exclude_border)
    return g.moved(lambda a, s, o: s, lambda a, s, o: o - s * 0.5, p.voxels)


def coarsened_grid(g: Grids, factor) -> Grids:
    """One voxel for each block of ``factor`` voxels an axis, centred on it."""
    f = triple(factor)
    if min(f) < 1:
        raise ValueError("factors must be positive")
    v = g.voxels.select("grid_id", *[floor_div(F.col(a), n).alias(a) for a, n in zip(IJK, f)]).distinct()
    return g.moved(lambda a, s, o: s * f[a], lambda a, s, o: (f[a] - 1) * s * 0.5 + o, v)


def coarse_ijk(g: Grids, factor) -> DataFrame:
    """For each voxel the coarse voxel it falls in (``ci, cj, ck``), repeats included."""
    return g.voxels.select(*KEY, *[floor_div(F.col(a), n).alias("c" + a) for a, n in zip(IJK, triple(factor))])


def refined_grid(g: Grids, factor, mask: DataFrame | None = None, keep: str = "keep") -> Grids:
    """``factor`` voxels an axis for each voxel (that ``mask`` keeps)."""
    f = triple(factor)
    if min(f) < 1:
        raise ValueError("factors must be positive")
    v = g.voxels if mask is None else pruned_grid(g, mask, keep).voxels
    v = with_box(v, (0, 0, 0), [n - 1 for n in f])
    v = v.select("grid_id", *[(F.col(a) * n + F.col("d" + a)).alias(a) for a, n in zip(IJK, f)])
    return g.moved(lambda a, s, o: s / f[a], lambda a, s, o: o - (f[a] - 1) * (s / f[a]) * 0.5, v)


def conv_pad(kernel: Sequence[int]) -> tuple:
    return tuple((k - 1) // 2 for k in kernel)


def conv_grid(g: Grids, kernel, stride=1) -> Grids:
    """Coarse voxels some tap of which lands on an active voxel: fine = stride * coarse + tap - pad."""
    k, s = triple(kernel), triple(stride)
    if k == s == (1, 1, 1):
        return g
    pad, v = conv_pad(k), g.voxels
    for a, name in enumerate(IJK):  # axis by axis: what an axis allows doesn't depend on the others
        own = F.col(name) - F.col("_t") + pad[a]
        v = v.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(k[a] - 1)))).where(F.pmod(own, F.lit(s[a])) == 0)
        v = v.select("grid_id", *[floor_div(own, s[a]).alias(n) if n == name else n for n in IJK]).distinct()
    return g.moved(lambda a, w, o: w * s[a], lambda a, w, o: o, v)


def conv_transpose_grid(g: Grids, kernel, stride=1) -> Grids:
    """All stride * coarse + tap - pad."""
    k, s = triple(kernel), triple(stride)
    if k == s == (1, 1, 1):
        return g
    pad = conv_pad(k)
    v = g.voxels.select("grid_id", *[(F.col(a) * n).alias(a) for a, n in zip(IJK, s)])
    v = shifted(v, [-p for p in pad], [n - 1 - p for n, p in zip(k, pad)])
    return g.moved(lambda a, w, o: w / s[a], lambda a, w, o: o, v)


def edge_network(g: Grids, voxel_coordinates: bool = False) -> tuple[DataFrame, DataFrame]:
    """Wireframe of the voxels: eight corners and twelve edges each, shared ones repeated.

    Vertices have ``grid_id``, ``v_id`` and a position, in world space unless
    ``voxel_coordinates``; edges ``grid_id, v0, v1``.
    """
    v = g.indexed()
    corners = with_box(v, (0, 0, 0), (1, 1, 1))
    corners = corners.select("grid_id", (F.col("idx") * 8 + F.col("tap")).alias("v_id"), *[(F.col(a) + F.col("d" + a) - 0.5).alias(n) for a, n in zip(IJK, "xyz")])
    if not voxel_coordinates:
        corners = g.voxel_to_world(corners, ("x", "y", "z"))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CUBE_EDGES])
    edges = v.select("grid_id", "idx", F.explode(pairs).alias("e"))
    return corners, edges.selectExpr("grid_id", "idx * 8 + e.a AS v0", "idx * 8 + e.b AS v1")


def curve_codes(g: Grids, kind: str = "morton", offset: Sequence[int] | None = None) -> DataFrame:
    """Codes of the voxels on a space-filling curve: ``morton``, ``morton_zyx``, ``hilbert`` or ``hilbert_zyx``.

    ``offset`` is added to the coordinates first; by default the least coordinates
    of the whole batch become zero.  Coordinates outside 21 bits raise.
    """
    v = g.voxels
    if offset is None:
        low = g.total_bbox().select(*[(-F.col(f"min_{a}")).alias("o" + a) for a in IJK])
        v = v.crossJoin(F.broadcast(low))  # one row
    else:
        v = v.withColumns({"o" + a: F.lit(d) for a, d in zip(IJK, offset)})
    v = v.withColumns({"c" + a: F.col(a).cast("long") + F.col("o" + a) for a in IJK}).drop("oi", "oj", "ok")
    ok = F.lit(True)
    for a in IJK:
        ok = ok & F.col("c" + a).between(0, (1 << 21) - 1)
    order = ("ck", "cj", "ci") if kind.endswith("_zyx") else ("ci", "cj", "ck")
    name = kind.removesuffix("_zyx")
    if name not in ("morton", "hilbert"):
        raise ValueError(f"unknown curve {kind!r}")
    code = morton(*map(F.col, order)) if name == "morton" else hilbert(*order)
    bad = F.raise_error(F.lit("coordinates outside 21 bits")).cast("long")
    return v.withColumn("code", F.when(ok, code).otherwise(bad)).select(*KEY, "code")
