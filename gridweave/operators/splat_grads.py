"""Gradients of splats: projection, colours and blending, as adjoints of the forward operators."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grids import check_columns
from .splats import MAX_ALPHA, Camera, cameras_frame, contributions, harmonics, world_contributions

#: Gaussians whose gradients are computed at once.
ROWS = 8192
GRADS = "id long, g_mean array<double>, g_quat array<double>, g_log_scale array<double>"


# -- rotations and scales, for many Gaussians at once ------------------------------------------


def _rotations(quat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation matrices of quaternions (w, x, y, z), the unit quaternions, and their lengths."""
    size = np.linalg.norm(quat, axis=1)
    w, x, y, z = (quat / size[:, None]).T
    rows = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]
    return np.moveaxis(np.array(rows), 2, 0), quat / size[:, None], size


def _quaternion_gradient(g: np.ndarray, unit: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Gradient by the quaternions from that by their rotation matrices ``g``."""
    w, x, y, z = unit.T
    a = lambda r, c: g[:, r, c]
    gw = 2 * (z * (a(1, 0) - a(0, 1)) + y * (a(0, 2) - a(2, 0)) + x * (a(2, 1) - a(1, 2)))
    gx = 2 * (y * (a(0, 1) + a(1, 0)) + z * (a(0, 2) + a(2, 0)) + w * (a(2, 1) - a(1, 2)) - 2 * x * (a(1, 1) + a(2, 2)))
    gy = 2 * (x * (a(0, 1) + a(1, 0)) + z * (a(1, 2) + a(2, 1)) + w * (a(0, 2) - a(2, 0)) - 2 * y * (a(0, 0) + a(2, 2)))
    gz = 2 * (x * (a(0, 2) + a(2, 0)) + y * (a(1, 2) + a(2, 1)) + w * (a(1, 0) - a(0, 1)) - 2 * z * (a(0, 0) + a(1, 1)))
    out = np.stack([gw, gx, gy, gz], 1)
    # a quaternion's length has no effect
    return (out - unit * (out * unit).sum(1, keepdims=True)) / size[:, None]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _summed(grads: DataFrame) -> DataFrame:
    """Sums of gradients by Gaussian, combined before the shuffle."""
    widths = {"g_mean": 3, "g_quat": 4, "g_log_scale": 3}
    sums = grads.groupBy("id").agg(*[F.sum(F.col(c)[n]).alias(f"{c}{n}") for c, w in widths.items() for n in range(w)])
    return sums.select("id", *[F.array(*[f"{c}{n}" for n in range(w)]).alias(c) for c, w in widths.items()])


# -- projection -----------------------------------------------------------------------------------

FOOT = ("mx", "my", "depth", "ca", "cb", "cc", "compensation")


def _through_camera(mean, quat, log_scale, cam: dict, grads: dict, size, blur: float, flat: bool):
    """Gradients by mean, quaternion and log scale of Gaussians, each in a camera, from those of their footprints."""
    rot, unit, length = _rotations(quat)
    e = np.exp(log_scale)
    m = rot * e[:, None, :]
    view = np.stack([np.stack([cam[f"v{r}{c}"] for c in range(3)], 1) for r in range(3)], 1)
    t = np.einsum("nrc,nc->nr", view, mean) + np.stack([cam[f"v{r}3"] for r in range(3)], 1)
    f = np.stack([cam["fx"], cam["fy"]], 1)
    z = t[:, 2:]
    jac = np.zeros((len(t), 2, 3))
    inside = np.ones((len(t), 2), bool)
    if flat:
        jac[:, [0, 1], [0, 1]] = f
    else:
        c, n = np.stack([cam["cx"], cam["cy"]], 1), np.array(size, float)
        slope = t[:, :2] / z
        low, high = -(c / f + 0.15 * n / f), (n - c) / f + 0.15 * n / f
        held = np.clip(slope, low, high)
        inside = held == slope
        jac[:, [0, 1], [0, 1]], jac[:, :, 2] = f / z, -f * held / z
    u = jac @ view
    half = u @ m
    plain = half @ half.transpose(0, 2, 1)
    cov = plain + blur * np.eye(2)
    det = np.linalg.det(cov)
    conic = np.linalg.inv(cov)
    g_conic = np.stack([np.stack([grads["ca"], grads["cb"] / 2], 1), np.stack([grads["cb"] / 2, grads["cc"]], 1)], 1)
    g_cov = -conic @ g_conic @ conic
    det0 = np.linalg.det(plain)
    comp = np.sqrt(np.maximum(0, det0 / det))
    turned = lambda a: np.stack([np.stack([a[:, 1, 1], -a[:, 1, 0]], 1), np.stack([-a[:, 0, 1], a[:, 0, 0]], 1)], 1)
    share = np.where(comp > 0, grads["compensation"] / np.where(comp > 0, 2 * comp, 1), 0)[:, None, None]
    g_cov += share * (turned(plain) / det[:, None, None] - (det0 / det**2)[:, None, None] * turned(cov))
    g_half = 2 * g_cov @ half
    g_u, g_m = g_half @ m.transpose(0, 2, 1), u.transpose(0, 2, 1) @ g_half
    g_jac = g_u @ view.transpose(0, 2, 1)
    g_t = np.zeros_like(t)
    g_at = np.stack([grads["mx"], grads["my"]], 1)
    if flat:
        g_t[:, :2] = f * g_at
    else:
        g_t[:, :2] = f / z * g_at - np.where(inside, g_jac[:, :, 2] * f / z**2, 0)
        g_t[:, 2] = -(g_at * f * t[:, :2] / z**2).sum(1) - (g_jac[:, [0, 1], [0, 1]] * f / z**2).sum(1)
        # -f * slope / z falls with z once, and where the slope is free a second time
        g_t[:, 2] += (g_jac[:, :, 2] * f * held / z**2 * np.where(inside, 2, 1)).sum(1)
    g_t[:, 2] += grads["depth"]
    g_mean = np.einsum("nrc,nr->nc", view, g_t)
    return g_mean, _quaternion_gradient(g_m * e[:, None, :], unit, length), (g_m * m).sum(1)


def project_backward(
    gaussians: DataFrame, grads: DataFrame, cameras: Mapping[int, Camera], size: tuple[int, int], blur: float = 0.3, orthographic: bool = False
) -> DataFrame:
    """Gradients of each Gaussian's parameters, ``id, g_mean, g_quat, g_log_scale``, summed over cameras.

    ``grads`` has ``cam``, ``id`` and, for any of a footprint's ``mx, my, depth, ca, cb, cc,
    compensation``, the gradient as ``g_`` + name; only Gaussians that were not culled
    have rows in it.  The chain rule is applied in Arrow functions to many rows at once.
    """
    check_columns(grads, "cam", "id")
    g = [F.col("g_" + c).cast("double").alias("g_" + c) if "g_" + c in grads.columns else F.lit(0.0).alias("g_" + c) for c in FOOT]
    rows = check_columns(gaussians, "id", "mean", "quat", "log_scale").select("id", "mean", "quat", "log_scale")
    j = rows.join(grads.select("cam", "id", *g), "id").join(F.broadcast(cameras_frame(gaussians.sparkSession, cameras)), "cam")
    names = ["fx", "fy", "cx", "cy", *[f"v{r}{c}" for r in range(3) for c in range(4)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            col = lambda c: b.column(c).to_numpy(zero_copy_only=False)
            cam, own = {n: col(n) for n in names}, {c: col("g_" + c) for c in FOOT}
            out = _through_camera(*(_matrix(b.column(c), w) for c, w in (("mean", 3), ("quat", 4), ("log_scale", 3))), cam, own, size, blur, orthographic)
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(_lists, out)], ["id", "g_mean", "g_quat", "g_log_scale"])

    return _summed(j.select("id", "mean", "quat", "log_scale", *["g_" + c for c in FOOT], *names).mapInArrow(run, GRADS))


# -- colours --------------------------------------------------------------------------------------


class Dual:
    """A column and its derivatives by three others, under sums, products and division by numbers."""

    def __init__(self, value, slopes):
        self.value, self.slopes = value, slopes

    def __add__(self, other):
        other = other if isinstance(other, Dual) else Dual(other, (0.0,) * 3)
        return Dual(self.value + other.value, [a + b for a, b in zip(self.slopes, other.slopes)])

    def __mul__(self, other):
        if not isinstance(other, Dual):
            return Dual(self.value * other, [a * other for a in self.slopes])
        return Dual(self.value * other.value, [a * other.value + self.value * b for a, b in zip(self.slopes, other.slopes)])

    def __sub__(self, other):
        return self + other * -1.0

    def __truediv__(self, number):
        return self * (1.0 / number)

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, other):
        return self * -1.0 + other


def harmonics_backward(rows: DataFrame, degree: int, coefficients: str = "sh", grad: str = "g_color") -> DataFrame:
    """``rows`` with ``g_sh`` (an array for each channel) and ``g_vx, g_vy, g_vz``, from gradients ``grad`` of the colours.

    Rows whose radii are not both positive have gradient 0, as they have colour 0.
    """
    check_columns(rows, "vx", "vy", "vz", coefficients, grad)
    size = F.sqrt(F.expr("vx * vx + vy * vy + vz * vz"))
    r = rows.withColumns({f"_{a}": F.col("v" + a) / size for a in "xyz"} | {"_size": size})
    unit = [Dual(F.col(f"_{a}"), [float(a == b) for b in "xyz"]) for a in "xyz"]
    basis = [b if isinstance(b, Dual) else Dual(b, (0.0,) * 3) for b in harmonics(*unit, degree)]
    column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    r = r.withColumn("_b", F.array(*[column(b.value) for b in basis]))
    for n, a in enumerate("xyz"):
        r = r.withColumn(f"_d{a}", F.array(*[column(b.slopes[n]) for b in basis]))
    seen = F.lit(True)
    if {"radius_x", "radius_y"} <= set(rows.columns):
        seen = (F.col("radius_x") > 0) & (F.col("radius_y") > 0)
    own = F.when(seen, F.col(grad)).otherwise(F.transform(grad, lambda g: F.lit(0.0)))
    r = r.withColumn("_g", own).withColumn("g_sh", F.transform("_g", lambda g: F.transform("_b", lambda b: b * g)))
    # by direction: the coefficients of all channels, weighted by their gradients
    total = f"aggregate(zip_with({coefficients}, _g, (c, g) -> transform(c, x -> x * g)), transform(_b, b -> 0.0D), (s, c) -> zip_with(s, c, (x, y) -> x + y))"
    r = r.withColumn("_w", F.expr(total))
    r = r.withColumns({f"_n{a}": F.expr(f"aggregate(zip_with(_w, _d{a}, (w, d) -> w * d), 0.0D, (s, x) -> s + x)") for a in "xyz"})
    along = F.expr("_nx * _x + _ny * _y + _nz * _z")
    r = r.withColumns({f"g_v{a}": (F.col(f"_n{a}") - along * F.col(f"_{a}")) / F.col("_size") for a in "xyz"})
    return r.select(*rows.columns, "g_sh", "g_vx", "g_vy", "g_vz")


# -- blending -------------------------------------------------------------------------------------


def _blended(c: DataFrame, grads: DataFrame, channels: Sequence[str], background: Sequence[float] | None) -> DataFrame:
    """Contributions with the gradient by their alpha (``_ga``) and by their channels (``g_`` + name).

    What a Gaussian hides is the weighted gradient of all that is blended behind it:
    a running sum from the back.
    """
    g = grads.select("cam", "u", "v", *[F.col("g_" + n).alias("_p" + n) for n in channels], (F.col("g_opacity") if "g_opacity" in grads.columns else F.lit(0.0)).alias("_po"))
    c = c.join(g, ["cam", "u", "v"])
    back = background or [0.0] * len(channels)
    opacity = F.col("_po") - sum((F.col("_p" + n) * float(b) for n, b in zip(channels, back)), F.lit(0.0))
    c = c.withColumn("_s", sum((F.col(n) * F.col("_p" + n) for n in channels), opacity))
    behind = Window.partitionBy("cam", "u", "v").orderBy("depth", "id").rowsBetween(1, Window.unboundedFollowing)
    hidden = F.coalesce(F.sum(F.col("weight") * F.col("_s")).over(behind), F.lit(0.0))
    through = F.col("weight") / F.col("alpha")
    c = c.withColumn("_ga", through * F.col("_s") - hidden / (1 - F.col("alpha")))
    return c.withColumns({"g_" + n: F.col("weight") * F.col("_p" + n) for n in channels})


def rasterize_backward(
    footprints: DataFrame, pixels: DataFrame, grads: DataFrame, size: tuple[int, int], channels: Sequence[str], tile: int = 16,
    background: Sequence[float] | None = None,
) -> DataFrame:
    """Gradients of footprints, ``cam, id`` and ``g_mx, g_my, g_ca, g_cb, g_cc, g_opacity`` and of the channels.

    ``grads`` has ``cam, u, v``, the gradients of the blended channels as ``g_`` + name and,
    if wanted, ``g_opacity``.  Sums over pixels are combined before the shuffle.
    """
    c = _blended(contributions(footprints, pixels, size, tile), grads, channels, background)
    dx, dy = F.col("mx") - (F.col("u") + 0.5), F.col("my") - (F.col("v") + 0.5)
    # an alpha at its upper bound does not move
    free = F.when(F.col("alpha") < MAX_ALPHA, F.col("_ga")).otherwise(0.0)
    c = c.withColumns({"_dx": dx, "_dy": dy, "_f": free}).withColumn("_gs", -F.col("_f") * F.col("alpha"))
    parts = {
        "g_mx": "_gs * (ca * _dx + cb * _dy)", "g_my": "_gs * (cc * _dy + cb * _dx)", "g_ca": "_gs * 0.5D * _dx * _dx", "g_cb": "_gs * _dx * _dy",
        "g_cc": "_gs * 0.5D * _dy * _dy", "g_opacity": "_f * alpha / opacity",
    }
    return c.groupBy("cam", "id").agg(*[F.sum(F.expr(e)).alias(n) for n, e in parts.items()], *[F.sum("g_" + n).alias("g_" + n) for n in channels])


def rasterize_world_backward(
    gaussians: DataFrame, footprints: DataFrame, rays: DataFrame, grads: DataFrame, size: tuple[int, int], channels: Sequence[str], tile: int = 16
) -> DataFrame:
    """Gradients of blending by rays: ``id, g_mean, g_quat, g_log_scale``, ``g_opacity`` and of the channels."""
    c = _blended(world_contributions(gaussians, footprints, rays, size, channels, tile), grads, channels, None)
    c = c.withColumn("_f", F.when(F.col("alpha") < MAX_ALPHA, F.col("_ga")).otherwise(0.0))
    plain = c.groupBy("id").agg(F.sum(F.expr("_f * alpha / opacity")).alias("g_opacity"), *[F.sum("g_" + n).alias("g_" + n) for n in channels])
    ray = rays.select("cam", "u", "v", *[F.col(f"{o}{a}").cast("double").alias(f"r{o}{a}") for o in "od" for a in "xyz"])
    rows = c.select("cam", "u", "v", "id", (F.col("_f") * F.col("alpha") * -0.5).alias("_far")).join(ray, ["cam", "u", "v"])
    rows = rows.join(gaussians.select("id", "mean", "quat", "log_scale"), "id").select("id", "mean", "quat", "log_scale", "_far", *[f"r{o}{a}" for o in "od" for a in "xyz"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            mean, quat, log_scale = (_matrix(b.column(n), w) for n, w in (("mean", 3), ("quat", 4), ("log_scale", 3)))
            far = b.column("_far").to_numpy()[:, None]
            begin, along = (np.stack([b.column(f"r{o}{a}").to_numpy() for a in "xyz"], 1) for o in "od")
            rot, unit, length = _rotations(quat)
            e = np.exp(log_scale)
            into = rot.transpose(0, 2, 1) / e[:, :, None]  # world to the space where the Gaussian is a unit ball
            o, d = np.einsum("nrc,nc->nr", into, begin - mean), np.einsum("nrc,nc->nr", into, along)
            od, dd = (o * d).sum(1, keepdims=True), (d * d).sum(1, keepdims=True)
            far = np.where((o * o).sum(1, keepdims=True) > od * od / dd, far, 0)
            g_o, g_d = far * 2 * (o - od / dd * d), far * 2 * (od**2 / dd**2 * d - od / dd * o)
            g_into = g_o[:, :, None] * (begin - mean)[:, None, :] + g_d[:, :, None] * along[:, None, :]
            g_rot = (g_into / e[:, :, None]).transpose(0, 2, 1)
            out = -np.einsum("nrc,nr->nc", into, g_o), _quaternion_gradient(g_rot, unit, length), -(g_into * into).sum(2)
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(_lists, out)], ["id", "g_mean", "g_quat", "g_log_scale"])

    return _summed(rows.mapInArrow(run, GRADS)).join(plain, "id")
