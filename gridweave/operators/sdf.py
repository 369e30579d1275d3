"""Signed distances from signed fields: upwind redistancing of whole grids, or on blocks with halos."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.spatial import IJK, KEY

from gridweave.sources.shared import written

from .grids import WHOLE, Grids, by_grids, check_columns, close_steps, meet
from .pool import inject
from .topology import dilated_grid, pruned_grid

#: Side of the blocks that are solved by themselves, and sweeps taken between exchanges of their borders.
BLOCK, SWEEPS = 32, 3
#: The step in time, what keeps the sign's root from zero, the smoothing factors (Taubin's pair, mean
#: curvature), sweeps for each voxel of the band and besides, sweeps after smoothing at least, and the share of the
#: band within which voxels are kept.
STEP, ROOT, TAUBIN, MEAN, PER_BAND, BESIDES, LEAST, KEPT = 0.4, 1e-12, (0.5, -0.53), 1.0, 2.5, 2, 4, 0.999
STATE = "grid_id int, i int, j int, k int, phi double, sgn double"


def _neighbours(i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Rows of the six face neighbours of each voxel, n for none."""
    n = len(i)
    i, j, k = (x.astype(np.int64) - int(x.min()) + 1 for x in (i, j, k))
    a, b = int(k.max()) + 2, (int(j.max()) + 2) * (int(k.max()) + 2)
    code = i * b + j * a + k
    order = np.argsort(code)
    ordered = code[order]
    out = np.empty((6, n), np.int64)
    for c, d in enumerate((-b, b, -a, a, -1, 1)):
        at = np.minimum(np.searchsorted(ordered, code + d), n - 1)
        out[c] = np.where(ordered[at] == code + d, order[at], n)
    return out


def _faces(phi: np.ndarray, near: np.ndarray, outside: float) -> np.ndarray:
    return np.append(phi, outside)[near]


def _rate(phi, sgn, near, w, outside):
    """sign * (1 - |gradient|), one-sided against the direction the front moves."""
    f = _faces(phi, near, outside)
    total = np.zeros_like(phi)
    for a in range(3):
        back, ahead = (phi - f[2 * a]) / w, (f[2 * a + 1] - phi) / w
        up = np.maximum(np.maximum(back, 0) ** 2, np.minimum(ahead, 0) ** 2)
        down = np.maximum(np.minimum(back, 0) ** 2, np.maximum(ahead, 0) ** 2)
        total += np.where(sgn > 0, up, down)
    return sgn * (1 - np.sqrt(total))


def frozen_sign(phi, near, w, outside):
    """A smooth sign of a field from its value and central differences."""
    f = _faces(phi, near, outside)
    grad = sum(((f[2 * a + 1] - f[2 * a]) / (2 * w)) ** 2 for a in range(3))
    return phi / np.sqrt(phi * phi + grad * w * w + ROOT)


def sweep(phi, sgn, near, w, band, order):
    """One step in time of 0.4 voxels by a Runge-Kutta scheme of order 1, 2 or 3, values kept within the band."""
    dt, rate = STEP * w, lambda x: _rate(x, sgn, near, w, band)
    hold = lambda x: np.clip(x, -band, band)
    first = rate(phi)
    one = hold(phi + dt * first)
    if order == 1:
        return one
    if order == 2:
        return hold(phi + 0.5 * dt * (first + rate(one)))
    two = hold(0.75 * phi + 0.25 * one + 0.25 * dt * rate(one))
    return hold(phi / 3 + 2 / 3 * two + 2 / 3 * dt * rate(two))


def _by_blocks(state: DataFrame, halo: int, solve) -> DataFrame:
    """Run ``solve(phi, sgn, near)`` on every block and the voxels up to ``halo`` steps around it; keep the block's own.

    A voxel goes to the blocks whose border it is near; what can't be right so
    close to a block's outer edge never reaches its own voxels.
    """
    for a in IJK:
        own = F.sequence(F.floor((F.col(a) - halo) / BLOCK).cast("int"), F.floor((F.col(a) + halo) / BLOCK).cast("int"))
        state = state.withColumn("b" + a, F.explode(own))
    names = ["grid_id", "bi", "bj", "bk"]

    def run(t: pa.Table) -> pa.Table:
        i, j, k = (t.column(c).to_numpy() for c in IJK)
        phi, sgn = (t.column(c).to_numpy().copy() for c in ("phi", "sgn"))
        phi, sgn = solve(phi, sgn, _neighbours(i, j, k))
        at = [t.column(c)[0].as_py() for c in ("bi", "bj", "bk")]
        mine = np.flatnonzero((i // BLOCK == at[0]) & (j // BLOCK == at[1]) & (k // BLOCK == at[2]))
        cols = [t.column(c).take(pa.array(mine)).combine_chunks() for c in KEY]
        return pa.table([*cols, pa.array(phi[mine]), pa.array(sgn[mine])], names=[*KEY, "phi", "sgn"])

    return state.groupBy(*names).applyInArrow(run, STATE)


def _by_grids(state: DataFrame, rows: float, solve) -> DataFrame:
    """Run ``solve(phi, near)`` on whole grids of at most ``WHOLE`` voxels, many at a time: one shuffle whatever it does."""

    def solved(t: pa.Table):
        grid, i, j, k = (t.column(c).to_numpy() for c in KEY)
        phi = solve(t.column("phi").to_numpy().copy(), _neighbours(close_steps(i, grid), close_steps(j), close_steps(k)))
        return pa.table([*(t.column(c) for c in KEY), pa.array(phi)], names=[*KEY, "phi"]).to_batches()

    return by_grids(state.select(*KEY, "phi"), rows, solved, "grid_id int, i int, j int, k int, phi double")


def _sizes(g: Grids, pad: int) -> DataFrame:
    """At least as many voxels as each grid has when padded: those of its box, or a cube for each voxel."""
    cells = [F.max(a).cast("double") - F.min(a) + float(1 + 2 * pad) for a in IJK]
    n = F.count("*") * float((2 * pad + 1) ** 3)
    return g.voxels.groupBy("grid_id").agg(F.least(n, cells[0] * cells[1] * cells[2]).alias("size"))


def _redistance(state: DataFrame, w: float, band: float, order: int, sweeps: int) -> DataFrame:
    left, start, mine = sweeps, True, None
    while left > 0:
        n, fresh = min(SWEEPS, left), start

        def solve(phi, sgn, near, n=n, fresh=fresh):
            if fresh:
                sgn = frozen_sign(phi, near, w, band)
            for _ in range(n):
                phi = sweep(phi, sgn, near, w, band, order)
            return phi, sgn

        state = mine = written(_by_blocks(state, n * order + fresh, solve), mine)
        left, start = left - n, False
    return state


def reinitialize_sdf(
    g: Grids, features: DataFrame, value: str = "f", band: int = 3, smooth: int = 0, order: int = 3, taubin: bool = False, sweeps: int = -1
) -> DataFrame:
    """Turn a signed field into a distance of at most ``band`` voxels, as ``grid_id, i, j, k, f``.

    All grids share one cubic voxel size.  Voxels outside count as the band's full
    width.  ``smooth`` passes of averaging (by mean curvature, or Taubin's pairs
    that keep volume) are followed by more sweeps.  Grids of at most ``WHOLE`` voxels
    are solved whole in Arrow functions, many at a time.  Larger ones are cut into blocks, which
    are solved for a few sweeps at a time, with halos as wide as information moves
    meanwhile, so results depend on neither.
    """
    if g.shared is None or len(set(g.shared[0])) != 1:
        raise ValueError("one cubic voxel size is needed")
    if order not in (1, 2, 3) or band < 1:
        raise ValueError("order must be 1, 2 or 3 and the band at least 1")
    state = meet(check_columns(features, *KEY, value), g.voxels, KEY, "left_semi")
    return _distances(g, state, _sizes(g, 0), value, band, smooth, order, taubin, sweeps)


def _distances(g: Grids, state: DataFrame, sizes: DataFrame, value: str, band: int, smooth: int, order: int, taubin: bool, sweeps: int) -> DataFrame:
    w = float(g.shared[0][0])
    width = band * w
    x = F.greatest(F.least(F.col(value).cast("double"), F.lit(width)), F.lit(-width))
    state = state.select(*KEY, x.alias("phi"), F.lit(0.0).alias("sgn"))
    sweeps = sweeps if sweeps > 0 else max(6, int(PER_BAND * band + 0.5) + BESIDES)
    passes = (list(TAUBIN) * smooth if taubin else [MEAN] * smooth) if smooth else []
    again = max(LEAST, smooth)

    def whole(phi, near):
        for n, smoothed in ((sweeps, passes), (again, ())) if passes else ((sweeps, ()),):
            sgn = frozen_sign(phi, near, w, width)
            for _ in range(n):
                phi = sweep(phi, sgn, near, w, width, order)
            for c in smoothed:
                phi = phi + c * (_faces(phi, near, width).mean(0) - phi)
        return phi

    rows, most = sizes.agg(F.sum("size"), F.max("size")).first()
    if (most or 0) <= WHOLE:
        return _by_grids(state, rows or 0, whole).select(*KEY, F.col("phi").alias(value))
    large = sizes.where(F.col("size") > WHOLE).select("grid_id")
    small = _by_grids(meet(state, large, ["grid_id"], "left_anti"), rows, whole)
    state = _redistance(meet(state, large, ["grid_id"], "left_semi"), w, width, order, sweeps)
    for at in range(0, len(passes), BLOCK // 4):
        part = passes[at : at + BLOCK // 4]

        def average(phi, sgn, near, part=part):
            for c in part:
                phi = phi + c * (_faces(phi, near, width).mean(0) - phi)
            return phi, sgn

        state = written(_by_blocks(state, len(part), average), state)
    if passes:
        state = _redistance(state, w, width, order, again)
    return state.select(*KEY, "phi").unionByName(small).withColumnRenamed("phi", value)


def retopologize_sdf(
    g: Grids, features: DataFrame, value: str = "f", band: int = 3, smooth: int = 0, order: int = 3, taubin: bool = False,
    sweeps: int = -1, pad: bool = True, prune: bool = True,
) -> tuple[Grids, DataFrame]:
    """A clean narrow band: pad by the band, redistance, and keep voxels strictly within it."""
    width = band * float(g.shared[0][0])
    if pad:
        sizes, wide = _sizes(g, band), dilated_grid(g, band)
        state, g = inject(wide, features, default=width, values=(value,)), wide
        phi = _distances(g, state, sizes, value, band, smooth, order, taubin, sweeps)
    else:
        phi = reinitialize_sdf(g, features, value, band, smooth, order, taubin, sweeps)
    if not prune:
        return g, phi
    kept = phi.where(F.abs(value) < width * KEPT)
    return pruned_grid(g, kept.withColumn("keep", F.lit(True))), kept
