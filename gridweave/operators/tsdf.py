"""Fusion of depth images into truncated signed distances."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.spatial import IJK, KEY, TRANSFORM
from gridweave.sources.shared import written

from .build import from_points
from .grids import GATHERED, MAX_LISTED, WHOLE, Grids, by_grids, check_columns, distinct_rows, meet
from .topology import dilated_grid, merged_grid

#: The most voxels that new points are padded by.
MAX_PAD = 16
#: Rows of whole grids that are fused at a time: few, since each pixel makes many voxels.
CLOSE = 1 << 13
#: Kinds of rows that meet in a task.
CAMERA, SEEN, PIXEL, VOXEL, STATE = range(5)

Camera = tuple[Sequence[Sequence[float]], Sequence[Sequence[float]]]


def _cameras(spark, cameras: Mapping[int, Camera] | DataFrame) -> DataFrame:
    """Matrices by grid.

    From a driver-side mapping of grid to (3x3 projection, 4x4 camera to world), which
    is bounded and broadcast; or, for any number of grids, from a table ``grid_id``,
    ``fx, fy, cx, cy`` and ``pose`` (a rigid camera to world, row by row), which is joined.
    """
    if isinstance(cameras, DataFrame):
        c = check_columns(cameras, "grid_id", "fx", "fy", "cx", "cy", "pose")
        turned = ", ".join(", ".join([*(f"pose[{4 * n + r}]" for n in range(3)), "-(" + " + ".join(f"pose[{4 * n + r}] * pose[{4 * n + 3}]" for n in range(3)) + ")"]) for r in range(3))
        return c.selectExpr(
            "grid_id", "array(1 / fx, 0D, -cx / fx, 0D, 1 / fy, -cy / fy, 0D, 0D, 1D) AS kinv", "slice(pose, 1, 12) AS pose",
            "array(fx, 0D, cx, 0D, fy, cy, 0D, 0D, 1D) AS kmat", f"array({turned}) AS view",
        )
    if len(cameras) > MAX_LISTED:
        raise ValueError(f"at most {MAX_LISTED} cameras; give a table of them")
    rows = []
    for g, (k, pose) in cameras.items():
        k, pose = np.asarray(k, float), np.asarray(pose, float)
        mats = [np.linalg.inv(k), pose[:3], k, np.linalg.inv(pose)[:3]]
        rows.append((int(g), *[m.ravel().tolist() for m in mats]))
    return F.broadcast(spark.createDataFrame(rows, "grid_id int, kinv array<double>, pose array<double>, kmat array<double>, view array<double>"))


def _times(m: str, cols: int, row: int, v: Sequence[str]) -> str:
    """SQL for one component of a row-major matrix times a vector; a fourth column is a shift."""
    terms = [f"{m}[{row * cols + c}] * {x}" for c, x in enumerate(v)]
    return " + ".join(terms + ([f"{m}[{row * cols + 3}]"] if cols == 4 else []))


def unproject(pixels: DataFrame, cameras: Mapping[int, Camera] | DataFrame) -> DataFrame:
    """World points of depth pixels ``grid_id, u, v, depth``."""
    p = check_columns(pixels, "grid_id", "u", "v", "depth")
    cams = _cameras(pixels.sparkSession, cameras)
    p = meet(p, cams, ["grid_id"]) if isinstance(cameras, DataFrame) else p.join(cams, "grid_id")
    p = p.withColumns({f"c{a}": F.expr(f"depth * ({_times('kinv', 3, n, ('u', 'v', '1.0D'))})") for n, a in enumerate("xyz")})
    return p.select("grid_id", *[F.expr(_times("pose", 4, n, ("cx", "cy", "cz"))).alias(a) for n, a in enumerate("xyz")])


def integrate_tsdf(
    g: Grids, state: DataFrame, pixels: DataFrame, cameras: Mapping[int, Camera] | DataFrame, size: tuple[int, int], truncation: float,
    channels: Sequence[str] = (), min_voxel: float | None = None,
) -> tuple[Grids, DataFrame]:
    """Merge one depth image per grid into distances.

    ``state`` has ``grid_id, i, j, k, tsdf, weight`` (and channels); ``pixels``
    ``grid_id, u, v, depth`` and, if wanted, ``weight`` and channels; ``size`` is the
    images' width and height.  The grid grows by the voxels within the
    truncation of the points seen.  Every voxel looks up its pixel
    and takes the weighted mean of old and new; voxels out of sight, too far
    behind the surface, or at pixels without weight keep what they had, new ones 0.
    Grids of at most ``WHOLE`` voxels are fused whole in Arrow functions, many at a time, larger ones by equi-joins.
    """
    if min_voxel is None:
        if g.shared is None:
            raise ValueError("min_voxel is needed where grids differ in voxel size")
        min_voxel = min(g.shared[0])
    pad = int(np.ceil(truncation / min_voxel))
    if not 0 < pad < MAX_PAD:
        raise ValueError(f"the truncation is {pad} voxels; 1 to {MAX_PAD - 1} are possible")
    weight = F.col("weight") if "weight" in pixels.columns else F.lit(1.0)
    state = check_columns(state, *KEY, "tsdf", "weight", *channels)
    pixels = pixels.withColumn("weight", weight)
    rows = _rows(g, state, pixels, cameras, size, channels)
    box = [F.max(F.when(F.col("kind") == SEEN, F.col(a))).cast("double") - F.min(F.when(F.col("kind") == SEEN, F.col(a))) + float(1 + 2 * pad) for a in IJK]
    cells = F.least(F.count_if(F.col("kind") == SEEN) * float((2 * pad + 1) ** 3), box[0] * box[1] * box[2])
    sizes = rows.groupBy("grid_id").agg((F.coalesce(cells, F.lit(0.0)) + F.count("*")).alias("size"))
    total, most = sizes.agg(F.sum("size"), F.max("size")).first()
    if (most or 0) <= WHOLE:
        new = _small(rows, total or 0, pad, size, truncation, channels)
        return g.with_voxels(new.select(*KEY)), new
    large = written(sizes.where(F.col("size") > WHOLE).select("grid_id"))
    new = _small(meet(rows, large, ["grid_id"], "left_anti"), total, pad, size, truncation, channels)
    own = [meet(df, large, ["grid_id"], "left_semi") for df in (g.voxels, state, pixels)]
    # so many voxels have a large grid that the table of their cameras is a small fraction of them
    few = meet(cameras, large, ["grid_id"], "left_semi") if isinstance(cameras, DataFrame) else cameras
    more = _large(g.with_voxels(own[0]), own[1], own[2], few, pad, size, truncation, channels)
    new = written(more.unionByName(new))
    return g.with_voxels(new.select(*KEY)), new


def _rows(g: Grids, state: DataFrame, pixels: DataFrame, cameras: Mapping[int, Camera] | DataFrame, size: tuple[int, int], channels: Sequence[str]) -> DataFrame:
    """All that a grid's fusion needs, as rows of one table: ``kind``, three numbers, a value, a weight, channels and a camera."""
    none = {"x": "double", "w": "double", **{f"c{n}": "double" for n in range(len(channels))}, "cam": "array<double>"}

    def kind(df: DataFrame, n: int, at: Sequence, **given) -> DataFrame:
        cols = [F.col(c).cast("int").alias(a) if isinstance(c, str) else c.cast("int").alias(a) for c, a in zip(at, IJK)]
        rest = [(F.col(given[c]) if c in given else F.lit(None)).cast(t).alias(c) for c, t in none.items()]
        return df.select(F.col("grid_id").cast("int").alias("grid_id"), F.lit(n).alias("kind"), *cols, *rest)

    zero, own = [F.lit(0)] * 3, {f"c{n}": c for n, c in enumerate(channels)}
    cams = g.attach(_cameras(pixels.sparkSession, cameras)).withColumn("_cam", F.concat("view", "kmat", F.array(*TRANSFORM))).where("_cam IS NOT NULL")
    seen = from_points(unproject(pixels, cameras), like=g).voxels.dropna()
    # a pixel without depth or weight changes nothing
    px = pixels.where(F.col("u").between(0, size[0] - 1) & F.col("v").between(0, size[1] - 1)).where("depth IS NOT NULL AND weight IS NOT NULL")
    return (
        kind(cams, CAMERA, zero, cam="_cam").union(kind(seen, SEEN, IJK)).union(kind(px, PIXEL, ["u", "v", F.lit(0)], x="depth", w="weight", **own))
        .union(kind(g.voxels, VOXEL, IJK)).union(kind(state, STATE, IJK, x="tsdf", w="weight", **own))
    )


def _padded(seen: Sequence[np.ndarray], pad: int) -> list[np.ndarray]:
    """Distinct voxels (grid, i, j, k) within ``pad`` steps of the given ones, whose grids are in order."""
    out = [[c[:0]] * 4 for c in seen[:1]]
    cuts = np.flatnonzero(np.diff(seen[0])) + 1
    for own in zip(*(np.split(c, cuts) for c in seen)):
        if not len(own[0]):
            continue
        low = [int(c.min()) - pad for c in own[1:]]
        span = [int(c.max()) + pad - n + 1 for c, n in zip(own[1:], low)]
        if math.prod(span) <= WHOLE:  # in a dense box
            box = np.zeros(span, bool)
            box[tuple(c - n for c, n in zip(own[1:], low))] = True
            for _ in range(pad):
                for a in range(3):
                    at = np.moveaxis(box, a, 0)
                    wide = at.copy()
                    wide[1:] |= at[:-1]
                    wide[:-1] |= at[1:]
                    at[:] = wide
            new = [x + n for x, n in zip(np.nonzero(box), low)]
        else:
            new = list(own[1:])
            for a in range(3):
                wide = [np.repeat(c, 2 * pad + 1) for c in new]
                wide[a] += np.tile(np.arange(-pad, pad + 1), len(new[0]))
                new = distinct_rows(wide)[0]
        out.append([np.full(len(new[0]), own[0][0]), *new])
    return [np.concatenate(c) for c in zip(*out)]


def _small(rows: DataFrame, total: float, pad: int, size: tuple[int, int], truncation: float, channels: Sequence[str]) -> DataFrame:
    """Fusion of whole grids, many at a time, in Arrow functions: the same sums in the same order as ``_large``."""
    values = ["w", *[f"c{n}" for n in range(len(channels))]]

    def times(m: Sequence[np.ndarray], cols: int, row: int, v: Sequence[np.ndarray]) -> np.ndarray:
        out = m[row * cols] * v[0] + m[row * cols + 1] * v[1] + m[row * cols + 2] * v[2]
        return out + m[row * cols + 3] if cols == 4 else out

    def fused(t: pa.Table):
        kinds, ids = t.column("kind").to_numpy(), t.column("grid_id").to_numpy()
        ids, grid = np.unique(ids, return_inverse=True)
        at = [grid.astype(np.int64), *(t.column(a).to_numpy().astype(np.int64) for a in IJK)]

        def of(kind: int) -> list[np.ndarray]:
            return [c[kinds == kind] for c in at]

        new, old, had_rows = _padded(of(SEEN), pad), of(VOXEL), of(STATE)
        n = len(new[0]) + len(old[0])
        if not n:
            return
        if len(old[0]) + len(had_rows[0]):
            vox, where = distinct_rows([np.concatenate(c) for c in zip(new, old, had_rows)])
        else:
            vox, where = new, np.arange(n)
        active = np.zeros(len(vox[0]), bool)
        active[where[:n]] = True

        # what voxels had
        was = t.filter(pa.array(kinds == STATE))
        had = {}
        for c in ("x", *values):
            had[c] = np.zeros(len(active))
            had[c][where[n:]] = was.column(c).fill_null(0.0).to_numpy()
        vox, had = [c[active] for c in vox], {c: x[active] for c, x in had.items()}

        # where they are seen
        cams = t.filter(pa.array(kinds == CAMERA))
        mats, has = np.zeros((27, len(ids))), np.zeros(len(ids), bool)
        own = grid[kinds == CAMERA]
        if len(own):
            mats[:, own], has[own] = cams.column("cam").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 27).T, True
        # numbers are looked up one at a time: a row of them for each voxel would not stay in a processor's cache
        view, kmat, step, origin = ([m[vox[0]] for m in mats[lo:hi]] for lo, hi in ((0, 12), (12, 21), (21, 24), (24, 27)))
        with np.errstate(all="ignore"):
            xyz = [(vox[a + 1] + origin[a] / step[a]) * step[a] for a in range(3)]
            c = [times(view, 4, a, xyz) for a in range(3)]
            s = [times(kmat, 3, a, c) for a in range(3)]
            u, v = (x / s[2] for x in s[:2])
            ok = has[vox[0]] & (c[2] > 0) & (s[2] != 0)
            u, v = np.trunc(u), np.trunc(v)
            ok &= (u >= 0) & (u < size[0]) & (v >= 0) & (v < size[1])
        u, v = (np.where(ok, x, 0).astype(np.int64) for x in (u, v))

        # their pixels
        of_px = of(PIXEL)
        code = (of_px[0] * size[1] + of_px[2]) * size[0] + of_px[1]
        order = np.argsort(code, kind="stable")
        wanted = (vox[0] * size[1] + v) * size[0] + u
        px = t.filter(pa.array(kinds == PIXEL)).take(pa.array(order))
        near = np.searchsorted(code[order], wanted)
        ok &= near < len(code)
        near = np.where(ok, near, 0)
        ok[ok] = code[order][near[ok]] == wanted[ok]
        here, near = np.flatnonzero(ok), near[ok]
        depth, w = (px.column(x).to_numpy()[near] for x in ("x", "w"))
        gap = depth - c[2][here]
        # as in SQL, what is not a number is larger than any
        update = ((gap > -truncation) | np.isnan(gap)) & ((w > 0) | np.isnan(w))
        here, near, gap, w = here[update], near[update], gap[update], w[update]
        w0 = had["w"][here]
        sums, nulls = w0 + w, {}
        with np.errstate(all="ignore"):
            had["x"][here] = (w0 * had["x"][here] + w * np.fmin(1.0, gap / truncation)) / sums
            for x in values[1:]:
                p = px.column(x)
                had[x][here] = (w0 * had[x][here] + w * p.fill_null(0.0).to_numpy()[near]) / sums
                nulls[x] = np.zeros(len(vox[0]), bool)
                nulls[x][here] = p.is_null().to_numpy()[near]
        had["w"][here] = sums
        cols = [ids[vox[0]], *vox[1:]]
        out = [pa.array(x).cast(pa.int32()) for x in cols] + [pa.array(had[x], mask=nulls.get(x)) for x in ("x", *values)]
        yield from pa.table(out, names=[*KEY, "tsdf", "weight", *channels]).to_batches(GATHERED)

    schema = "grid_id int, i int, j int, k int, tsdf double, weight double" + "".join(f", `{c}` double" for c in channels)
    return by_grids(rows, total, fused, schema, CLOSE)


def _large(
    g: Grids, state: DataFrame, pixels: DataFrame, cameras: Mapping[int, Camera] | DataFrame, pad: int, size: tuple[int, int], truncation: float, channels: Sequence[str]
) -> DataFrame:
    """Fusion by joins of voxels with pixels, for grids of any size."""
    seen = dilated_grid(from_points(unproject(pixels, cameras), like=g), pad)
    out = merged_grid(g, seen)

    v = out.voxel_to_world(out.voxels).join(_cameras(pixels.sparkSession, cameras), "grid_id", "left")
    v = v.withColumns({f"c{a}": F.expr(_times("view", 4, n, "xyz")) for n, a in enumerate("xyz")})
    v = v.withColumns({f"s{a}": F.expr(_times("kmat", 3, n, ("cx", "cy", "cz"))) for n, a in enumerate("xyz")})
    # pixels by truncation towards zero
    for n, a in (("u", "x"), ("v", "y")):
        at = F.expr(f"CASE WHEN cz > 0 AND sz <> 0 AND abs(s{a} / sz) < 1e9 THEN cast(s{a} / sz AS int) END")
        v = v.withColumn("p" + n, at)
    v = v.select(*KEY, "cz", "pu", "pv")
    px = pixels.where(F.col("u").between(0, size[0] - 1) & F.col("v").between(0, size[1] - 1)).select(
        "grid_id", F.col("u").alias("pu"), F.col("v").alias("pv"), F.col("depth").alias("pd"), F.col("weight").alias("pw"), *[F.col(c).alias("p_" + c) for c in channels]
    )
    v = meet(v, px, ["grid_id", "pu", "pv"], "left")
    old = state.select(*KEY, F.col("tsdf").alias("_t"), F.col("weight").alias("_w"), *[F.col(c).alias("o_" + c) for c in channels])
    v = meet(v, old, KEY, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("_t", "_w", *["o_" + c for c in channels])})
    gap = F.col("pd") - F.col("cz")
    update = F.coalesce((gap > -truncation) & (F.col("pw") > 0), F.lit(False))
    total = F.col("_w") + F.col("pw")
    new = {"tsdf": F.least(F.lit(1.0), gap / truncation)} | {c: F.col("p_" + c) for c in channels}
    cols = [F.when(update, (F.col("_w") * F.col("_t") + F.col("pw") * new["tsdf"]) / F.when(update, total)).otherwise(F.col("_t")).alias("tsdf")]
    cols.append(F.when(update, total).otherwise(F.col("_w")).alias("weight"))
    for c in channels:
        cols.append(F.when(update, (F.col("_w") * F.col("o_" + c) + F.col("pw") * new[c]) / F.when(update, total)).otherwise(F.col("o_" + c)).alias(c))
    return v.select(*KEY, *cols)
