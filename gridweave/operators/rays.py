"""Rays through voxels: traversal, segments, samples, zero crossings, and compositing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.spatial import IJK, KEY, TRANSFORM

from .grids import Grids, check_columns, meet, tasks_for

RAY = ["grid_id", "ray_id"]
#: Side of the blocks that are looked up before voxels, and the shortest piece of a sample that counts.
BLOCK, DELTA = 8, 1e-9
#: Fixed value: the longest step of a cone's samples.
LONGEST = 1e10
AXES = ("x", "y", "z")


def _clip(low: dict[str, str], high: dict[str, str], t0: str, t1: str) -> tuple[str, str]:
    """SQL for when a ray ``p + t d`` enters and leaves a box, within t0..t1; the box holds no point if they cross."""
    enter, leave = [t0], [t1]
    inf = "double('inf')"
    for a in AXES:
        p, d, lo, hi = f"p{a}", f"d{a}", low[a], high[a]
        inside = f"{p} >= {lo} AND {p} < {hi}"
        enter.append(f"CASE WHEN {d} > 0 THEN ({lo} - {p}) / {d} WHEN {d} < 0 THEN ({hi} - {p}) / {d} WHEN {inside} THEN -{inf} ELSE {inf} END")
        leave.append(f"CASE WHEN {d} > 0 THEN ({hi} - {p}) / {d} WHEN {d} < 0 THEN ({lo} - {p}) / {d} WHEN {inside} THEN {inf} ELSE -{inf} END")
    return f"greatest({', '.join(enter)})", f"least({', '.join(leave)})"


def _cells(df: DataFrame, side: int, t0: str, t1: str, names: Sequence[str]) -> DataFrame:
    """A row for each cell of the lattice of ``side`` that a ray crosses between two times.

    The times of all lattice planes in between are sorted; the middle of each
    piece lies in the cell it crosses.
    """
    planes = []
    for a in AXES:
        e0, e1 = f"(p{a} + d{a} * {t0}) / {side}", f"(p{a} + d{a} * {t1}) / {side}"
        span = f"sequence(cast(floor(least({e0}, {e1})) AS bigint), cast(ceil(greatest({e0}, {e1})) AS bigint))"
        planes.append(f"IF(d{a} = 0, array(), transform({span}, q -> (q * {side} - p{a}) / d{a}))")
    times = f"array_sort(filter(concat(array({t0}, {t1}), {', '.join(planes)}), t -> t >= {t0} AND t <= {t1}))"
    df = df.withColumn("_ts", F.expr(times))
    df = df.withColumn("_m", F.explode(F.expr("transform(filter(sequence(1, size(_ts) - 1), n -> _ts[n] > _ts[n - 1]), n -> (_ts[n] + _ts[n - 1]) / 2)")))
    at = {n: F.expr(f"cast(floor((p{a} + d{a} * _m) / {side}) AS int)") for n, a in zip(names, AXES)}
    return df.withColumns(at).drop("_ts", "_m")


def ray_voxels(rays: DataFrame, g: Grids, eps: float = 0.0, t_min: float = 0.0, t_max: float = float("inf")) -> DataFrame:
    """All active voxels on rays ``grid_id, ray_id, ox, oy, oz, dx, dy, dz``, with the times ``t0, t1`` between.

    Voxels are cubes around their centres.  Rays are clipped to their grid's
    bounds, walk the blocks of ``BLOCK`` cubed voxels there, keep those with a voxel,
    and walk the voxels in them: only equi-joins, on block and voxel keys.  Pieces
    not longer than ``eps`` are left out.
    """
    names = [*RAY, "ox", "oy", "oz", "dx", "dy", "dz"]
    r = check_columns(rays, *names).select(*[F.col(n).alias(n if n in RAY else "r" + n) for n in names])
    r = g.world_to_voxel(r, ("rox", "roy", "roz"), ("px", "py", "pz"))
    r = g.attach(r).withColumns({f"p{a}": F.col(f"p{a}") + 0.5 for a in AXES} | {f"d{a}": F.col(f"rd{a}") / F.col(s) for a, s in zip(AXES, TRANSFORM)})
    r = r.select(*RAY, *[f"p{a}" for a in AXES], *[f"d{a}" for a in AXES])
    r = r.join(g.bboxes(dual=True), "grid_id")
    first = "double('inf')" if t_max == float("inf") else f"{t_max!r}D"
    enter, leave = _clip({a: f"min_{i}" for a, i in zip(AXES, IJK)}, {a: f"max_{i}" for a, i in zip(AXES, IJK)}, f"{t_min!r}D", first)
    r = r.withColumns({"c0": F.expr(enter), "c1": F.expr(leave)}).where("c0 < c1")
    r = r.drop(*[f"{m}_{i}" for m in ("min", "max") for i in IJK])

    block = ["bi", "bj", "bk"]
    blocks = g.voxels.select("grid_id", *[F.floor(F.col(i) / BLOCK).cast("int").alias(b) for i, b in zip(IJK, block)]).distinct()
    r = _cells(r, BLOCK, "c0", "c1", block).join(blocks, ["grid_id", *block], "left_semi")
    enter, leave = _clip({a: f"b{i} * {BLOCK}" for a, i in zip(AXES, IJK)}, {a: f"(b{i} + 1) * {BLOCK}" for a, i in zip(AXES, IJK)}, "c0", "c1")
    r = r.withColumns({"e0": F.expr(enter), "e1": F.expr(leave)}).where("e0 < e1")
    v = _cells(r, 1, "e0", "e1", IJK).join(g.voxels, KEY, "left_semi")
    enter, leave = _clip(dict(zip(AXES, IJK)), {a: f"({i} + 1)" for a, i in zip(AXES, IJK)}, "c0", "c1")
    v = v.select(*RAY, *IJK, F.expr(enter).alias("t0"), F.expr(leave).alias("t1")).where(F.col("t1") - F.col("t0") > eps)
    return v.dropDuplicates([*RAY, *IJK])


def _along(*order: str):
    return Window.partitionBy(*RAY).orderBy(*order)


def voxels_along_rays(rays: DataFrame, g: Grids, max_voxels: int, eps: float = 0.0) -> DataFrame:
    """The first ``max_voxels`` active voxels of each ray, numbered from 0 by ``n``."""
    if max_voxels < 1:
        raise ValueError("max_voxels must be positive")
    n = F.row_number().over(_along("t0", *IJK)) - 1
    return ray_voxels(rays, g, eps).withColumn("n", n).where(F.col("n") < max_voxels)


def rays_intersect_voxels(rays: DataFrame, g: Grids, eps: float = 0.0) -> DataFrame:
    """Whether each ray meets an active voxel."""
    hit = ray_voxels(rays, g, eps).select(*RAY).distinct().withColumn("hit", F.lit(True))
    return rays.select(*RAY).join(hit, RAY, "left").select(*RAY, F.coalesce("hit", F.lit(False)).alias("hit"))


def segments_along_rays(rays: DataFrame, g: Grids, max_segments: int | None = None, eps: float = 0.0, t_min: float = 0.0, t_max: float = float("inf")) -> DataFrame:
    """Longest pieces of rays through touching active voxels: ``n, t0, t1``."""
    v = ray_voxels(rays, g, 0.0, t_min, t_max)
    reach = F.max("t1").over(_along("t0", "t1").rowsBetween(Window.unboundedPreceding, -1))
    v = v.withColumn("_new", F.when(F.col("t0") <= reach, 0).otherwise(1))
    v = v.withColumn("_s", F.sum("_new").over(_along("t0", "t1").rowsBetween(Window.unboundedPreceding, 0)))
    s = v.groupBy(*RAY, "_s").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("_s").where(F.col("t1") - F.col("t0") >= eps)
    s = s.withColumn("n", F.row_number().over(_along("t0")) - 1)
    return s if max_segments is None else s.where(F.col("n") < max_segments)


def uniform_ray_samples(
    rays: DataFrame, g: Grids, step: float, t_min: float = 0.0, t_max: float = 1e9, cone_angle: float = 0.0,
    include_end_segments: bool = True, midpoints: bool = False, eps: float = 0.0,
) -> DataFrame:
    """Steps along each ray inside the active segments, on a lattice of times from ``t_min``: ``t0, t1`` or ``t``.

    With end segments, pieces between a segment's ends and the lattice count as
    samples; without, whole steps whose middle lies in the segment.  A cone angle
    makes steps grow with time (``t * cone_angle``, ``step`` at least); then a
    segment's steps depend on where those before it ended, and rays go through an
    Arrow function that takes the segments of all its rays in turn.
    """
    if step <= 0 or cone_angle < 0:
        raise ValueError("the step must be positive and the cone angle not negative")
    s = segments_along_rays(rays, g, None, eps, t_min, t_max)
    if cone_angle:
        lists = s.groupBy(*RAY).agg(F.sort_array(F.collect_list(F.struct("t0", "t1"))).alias("segs"))
        out = lists.mapInArrow(_cone(step, t_min, cone_angle, include_end_segments), "grid_id int, ray_id long, t0 double, t1 double")
    elif include_end_segments:
        first, last = f"ceil((t0 - {t_min!r}D) / {step!r}D)", f"floor((t1 - {t_min!r}D) / {step!r}D)"
        grid = f"IF({first} <= {last}, transform(sequence({first}, {last}), q -> {t_min!r}D + q * {step!r}D), array())"
        marks = s.withColumn("_ts", F.expr(f"array_sort(array_distinct(filter(concat(array(t0, t1), {grid}), t -> t >= t0 AND t <= t1)))"))
        pairs = f"filter(transform(sequence(1, size(_ts) - 1), n -> named_struct('a', _ts[n - 1], 'b', _ts[n])), p -> p.b - p.a > {DELTA!r}D)"
        out = marks.select(*RAY, F.explode(F.expr(pairs)).alias("_p")).select(*RAY, F.col("_p.a").alias("t0"), F.col("_p.b").alias("t1"))
    else:
        # cells q whose middle t_min + (q + 1/2) step lies in [t0, t1)
        first, last = f"ceil((t0 - {t_min!r}D) / {step!r}D - 0.5D)", f"ceil((t1 - {t_min!r}D) / {step!r}D - 0.5D) - 1"
        cells = s.where(F.expr(f"{first} <= {last}")).select(*RAY, F.explode(F.expr(f"sequence({first}, {last})")).alias("_q"))
        out = cells.select(*RAY, F.expr(f"{t_min!r}D + _q * {step!r}D").alias("t0"), F.expr(f"{t_min!r}D + (_q + 1) * {step!r}D").alias("t1"))
    return out.select(*RAY, ((F.col("t0") + F.col("t1")) / 2).alias("t")) if midpoints else out


class GrowingLattice:
    """Times that follow each other at the length a cone has there: ``t * angle``, from ``step`` to ``LONGEST``.

    Where lengths are at a bound times are evenly spaced, in between they grow by a
    factor, so all times up to a limit come from a count and a formula, for many
    rays at once.
    """

    def __init__(self, step: float, angle: float):
        self.step, self.angle = step, angle
        self.stretches = [(step, 0.0, step / angle), (None, step / angle, LONGEST / angle), (LONGEST, LONGEST / angle, np.inf)]

    def length(self, t: np.ndarray) -> np.ndarray:
        return np.clip(t * self.angle, self.step, LONGEST)

    def after(self, t: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Times after ``t`` and under ``limit``: whose they are and what they are, in order; and the last of each or ``t``."""
        last, owners, times = t.astype(float), [], []
        for size, begin, end in self.stretches:
            here = (last >= begin) & (last < end) & (last < limit)
            if size is None:
                growth = np.log1p(self.angle)
                count = lambda to: np.log(to / np.where(here, last, 1.0)) / growth
            else:
                count = lambda to, size=size: (to - last) / size
            inside = np.maximum(np.ceil(count(limit)) - 1, 0)
            n = np.where(here, np.minimum(np.ceil(count(end)) if np.isfinite(end) else inside, inside), 0).astype(np.int64)
            own = np.repeat(np.arange(len(t)), n)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + 1
            at = last[own] * (1 + self.angle) ** nth if size is None else last[own] + nth * size
            owners.append(own)
            times.append(at)
            ends = np.cumsum(n)[n > 0] - 1
            last[n > 0] = at[ends]
        own, at = np.concatenate(owners), np.concatenate(times)
        order = np.argsort(own, kind="stable")
        return own[order], at[order], last


def _cone(step: float, t_min: float, angle: float, ends: bool):
    """Samples of growing length over each ray's segments: the first segments of all rays, then the second ones, and so on."""
    lattice = GrowingLattice(step, angle)

    def with_ends(a, b, t, size):
        """The pieces between a segment's ends and the lattice times in it; the first step has the length found before."""
        first = t + np.ceil((a - t) / size) * size
        inside = first <= b
        moved = inside & (first + size < b)
        rows = np.flatnonzero(moved)
        own, at, last = lattice.after((first + size)[rows], b[rows])
        whole = np.arange(len(a))
        owner = np.concatenate([whole, whole[inside], rows, rows[own], whole])
        marks = np.concatenate([a, first[inside], (first + size)[rows], at, b])
        t = first.copy()
        t[rows] = last
        size = size.copy()
        size[rows] = lattice.length(last)
        order = np.lexsort((marks, owner))
        owner, marks = owner[order], marks[order]
        same = (owner[1:] == owner[:-1]) & ((marks[1:] - marks[:-1] > DELTA) | ~inside[owner[1:]])
        return owner[:-1][same], marks[:-1][same], marks[1:][same], t, size

    def whole_steps(a, b, t, size):
        """Lattice steps whose middle lies in the segment."""
        first = t + np.floor((a - t) / size + 0.5) * size
        own, at, _ = lattice.after(first, b)
        owner, begin = np.concatenate([np.arange(len(a)), own]), np.concatenate([first, at])
        starts = (first + lattice.length(first) / 2 >= a)[owner]
        kept = starts & (begin + lattice.length(begin) / 2 < b[owner])
        owner, begin = owner[kept], begin[kept]
        end = begin + lattice.length(begin)
        t = first.copy()
        np.maximum.at(t, owner, end)
        return owner, begin, end, t, lattice.length(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("segs")
            flat, n = lists.flatten(), lists.value_lengths().to_numpy()
            a, b = (flat.field(c).to_numpy() for c in range(2))
            begin = np.cumsum(n) - n
            t, out = np.full(len(n), float(t_min)), []
            size = lattice.length(t)
            for nth in range(int(n.max(initial=0))):
                rays = np.flatnonzero(n > nth)
                at = begin[rays] + nth
                own, t0, t1, t[rays], size[rays] = (with_ends if ends else whole_steps)(a[at], b[at], t[rays], size[rays])
                out.append((rays[own], t0, t1))
            ray, t0, t1 = (np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0), np.empty(0))
            ids = [batch.column(c).take(pa.array(ray)) for c in RAY]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(t0), pa.array(t1)], [*RAY, "t0", "t1"])

    return run


def ray_implicit_intersection(rays: DataFrame, g: Grids, features: DataFrame, value: str = "f", eps: float = 0.0) -> DataFrame:
    """Time at which each ray first meets a change of sign, -1 for none.

    Voxels whose value is NaN, null or exactly 0 carry no sign.  Between touching
    voxels the time is interpolated between their middles; across a gap it is when
    the ray enters the second.
    """
    v = ray_voxels(rays, g, 0.0).where(F.col("t1") - F.col("t0") >= eps).join(check_columns(features, *KEY, value).select(*KEY, F.col(value).alias("_v")), KEY)
    v = v.where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_v") != 0))
    w = _along("t0", "t1")
    v = v.withColumns({n: F.lag(c).over(w) for n, c in (("_pv", "_v"), ("_p0", "t0"), ("_p1", "t1"))})
    v = v.where(F.signum("_v") != F.signum("_pv"))
    lam = F.col("_v") / (F.col("_v") - F.col("_pv"))
    middle = lam * ((F.col("_p0") + F.col("_p1")) * 0.5) + (1 - lam) * ((F.col("t0") + F.col("t1")) * 0.5)
    hit = v.select(*RAY, F.struct("t0", F.when(F.col("t0") == F.col("_p1"), middle).otherwise(F.col("t0")).alias("t")).alias("h"))
    hit = hit.groupBy(*RAY).agg(F.min("h").alias("h"))
    return rays.select(*RAY).join(hit, RAY, "left").select(*RAY, F.coalesce(F.col("h.t"), F.lit(-1.0)).alias("t"))


# -- compositing -----------------------------------------------------------------------


def _weighted(samples: DataFrame, threshold: float, group: Sequence[str], order: str) -> DataFrame:
    """Samples front to back with transmittance before (``_T``) and weight (``_w``), up to the one that crosses the threshold."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    depth = F.coalesce(F.sum(F.col("sigma") * F.col("dt")).over(before), F.lit(0.0))
    s = samples.withColumn("_d", depth).withColumn("_T", F.exp(-F.col("_d")))
    s = s.where((F.col("_T") > threshold) | (F.col("_d") == 0))
    return s.withColumn("_w", (1 - F.exp(-F.col("sigma") * F.col("dt"))) * F.col("_T"))


def volume_render(samples: DataFrame, channels: Sequence[str], threshold: float = 0.0, group: Sequence[str] = RAY, order: str = "s") -> DataFrame:
    """Front-to-back compositing of ``sigma, dt, t`` and channels: sums, depth, opacity and samples used, by ray.

    Transmittance is the exponential of a running sum, so no sequential loop is
    needed; the sample at which it falls to the threshold counts, later ones don't.
    """
    w = _weighted(check_columns(samples, *group, order, "sigma", "dt", "t", *channels), threshold, group, order)
    return w.groupBy(*group).agg(
        *[F.sum(F.col("_w") * F.col(c)).alias(c) for c in channels],
        F.sum(F.col("_w") * F.col("t")).alias("depth"),
        F.sum("_w").alias("opacity"),
        F.count("*").alias("n_samples"),
    )


def volume_render_adjoint(samples: DataFrame, grads: DataFrame, channels: Sequence[str], threshold: float = 0.0, group: Sequence[str] = RAY, order: str = "s") -> DataFrame:
    """Gradients of ``sigma`` (``g_sigma``) and of the channels from those of the rendered channels (``g_`` + name)."""
    # both sides are dealt by ray, over tasks in proportion to the samples: neither the windows nor the join shuffle again
    n = tasks_for(samples, samples.count())
    w = meet(_weighted(samples.repartition(n, *group), threshold, group, order), grads.repartition(n, *group), list(group))
    dot = sum((F.col("g_" + c) * F.col(c) for c in channels), F.lit(0.0))
    w = w.withColumn("_d", dot)
    after = Window.partitionBy(*group).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    rest = F.coalesce(F.sum(F.col("_w") * F.col("_d")).over(after), F.lit(0.0))
    left = F.col("_T") * F.exp(-F.col("sigma") * F.col("dt"))
    return w.select(*group, order, (F.col("dt") * (left * F.col("_d") - rest)).alias("g_sigma"), *[(F.col("_w") * F.col("g_" + c)).alias("g_" + c) for c in channels])
