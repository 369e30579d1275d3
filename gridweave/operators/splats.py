"""Gaussian splats: projection, colours, tiles, blending, contributors, relocation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grids import MAX_LISTED, check_columns

#: Standard deviations of a footprint, largest and smallest opacity blended, transmittance at which a pixel is done.
EXTENT, MAX_ALPHA, MIN_ALPHA, DONE = 3.33, 0.99, 1.0 / 255.0, 1e-4
#: A camera: 3x3 projection and 4x4 world to camera.
Camera = tuple[Sequence[Sequence[float]], Sequence[Sequence[float]]]


def cameras_frame(spark, cameras: Mapping[int, Camera]) -> DataFrame:
    """``cam, fx, fy, cx, cy`` and the view matrix as ``v00`` to ``v23``, from a bounded driver-side mapping."""
    if len(cameras) > MAX_LISTED:
        raise ValueError(f"at most {MAX_LISTED} cameras")
    rows = []
    for c, (k, view) in cameras.items():
        k, view = np.asarray(k, float), np.asarray(view, float)
        rows.append((int(c), *map(float, (k[0, 0], k[1, 1], k[0, 2], k[1, 2])), *view[:3].ravel().tolist()))
    names = [f"v{r}{c} double" for r in range(3) for c in range(4)]
    return spark.createDataFrame(rows, "cam int, fx double, fy double, cx double, cy double, " + ", ".join(names))


def _parts(gaussians: DataFrame, rest: Sequence[str]) -> DataFrame:
    """Each Gaussian as plain columns: its mean ``m0..m2`` and the matrix ``s00..s22`` of rotation times scale."""
    g = unit_quaternions(check_columns(gaussians, "id", "mean", "quat", "log_scale"))
    g = g.select(
        *rest, *[F.col("mean")[n].alias(f"m{n}") for n in range(3)], *[F.col("quat")[n].alias(f"q{n}") for n in range(4)],
        *[F.exp(F.col("log_scale")[n]).alias(f"e{n}") for n in range(3)],
    )
    rot = rotation("q0", "q1", "q2", "q3")
    return g.withColumns({f"s{r}{c}": F.expr(f"({rot[r][c]}) * e{c}") for r in range(3) for c in range(3)}).drop("q0", "q1", "q2", "q3", "e0", "e1", "e2")


def rotation(w: str, x: str, y: str, z: str) -> list[list[str]]:
    """SQL for the rotation matrix of a unit quaternion."""
    return [
        [f"1 - 2 * ({y} * {y} + {z} * {z})", f"2 * ({x} * {y} - {w} * {z})", f"2 * ({x} * {z} + {w} * {y})"],
        [f"2 * ({x} * {y} + {w} * {z})", f"1 - 2 * ({x} * {x} + {z} * {z})", f"2 * ({y} * {z} - {w} * {x})"],
        [f"2 * ({x} * {z} - {w} * {y})", f"2 * ({y} * {z} + {w} * {x})", f"1 - 2 * ({x} * {x} + {y} * {y})"],
    ]


def covariance(quat: str = "quat", scale: str = "log_scale") -> dict[str, str]:
    """SQL for the six parts of R S S R^T, from a unit quaternion (w, x, y, z) and log scales."""
    r = [[f"({x})" for x in row] for row in rotation(*(f"{quat}[{n}]" for n in range(4)))]
    out = {}
    for a in range(3):
        for b in range(a, 3):
            out[f"{a}{b}"] = " + ".join(f"exp(2 * {scale}[{n}]) * {r[a][n]} * {r[b][n]}" for n in range(3))
    return out


def unit_quaternions(g: DataFrame, quat: str = "quat") -> DataFrame:
    n = F.sqrt(sum(F.col(quat)[i] * F.col(quat)[i] for i in range(4)))
    return g.withColumn(quat, F.transform(quat, lambda v: v / n))


def project(
    gaussians: DataFrame, cameras: Mapping[int, Camera], size: tuple[int, int], near: float = 0.01, far: float = 1e10,
    blur: float = 0.3, radius_clip: float = 0.0, orthographic: bool = False, scene: str | None = None, keep_culled: bool = False,
) -> DataFrame:
    """Footprints of Gaussians ``id, mean, quat, log_scale`` in every camera: mean, depth, conic, radii, compensation.

    The pinhole projection is linearised at the mean.  A Gaussian is culled where
    its depth is out of range, its blurred covariance is singular, both radii are
    at most ``radius_clip``, or its box misses the image.  With ``scene``, a column of
    both sides' scene ids, a camera sees the Gaussians of its own scene only.
    Cameras are a bounded list, exploded onto the rows.
    """
    cams = cameras_frame(gaussians.sparkSession, cameras)
    rest = [c for c in gaussians.columns if c not in ("mean", "quat", "log_scale")]
    g = _parts(gaussians, rest)
    if scene:
        j = g.join(F.broadcast(cams), g[scene] == cams["cam"])
    else:
        j = g.crossJoin(F.broadcast(cams))
    j = j.withColumns({f"t{r}": F.expr(f"v{r}0 * m0 + v{r}1 * m1 + v{r}2 * m2 + v{r}3") for r in range(3)})
    seen = F.col("t2").between(near, far)
    j = j if keep_culled else j.where(seen)
    if orthographic:
        jac = {"a0": F.col("fx"), "a2": F.lit(0.0), "b1": F.col("fy"), "b2": F.lit(0.0)}
        at = {"mx": F.expr("fx * t0 + cx"), "my": F.expr("fy * t1 + cy")}
    else:
        # the slope is taken within 1.3 of the field of view, for stability
        w, h = size
        lim = {"x": (f"(cx / fx + 0.15 * {w} / fx)", f"(({w} - cx) / fx + 0.15 * {w} / fx)"), "y": (f"(cy / fy + 0.15 * {h} / fy)", f"(({h} - cy) / fy + 0.15 * {h} / fy)")}
        j = j.withColumns({n: F.expr(f"t2 * least({lim[a][1]}, greatest(-{lim[a][0]}, {t} / t2))") for n, a, t in (("l0", "x", "t0"), ("l1", "y", "t1"))})
        jac = {"a0": F.expr("fx / t2"), "a2": F.expr("-fx * l0 / (t2 * t2)"), "b1": F.expr("fy / t2"), "b2": F.expr("-fy * l1 / (t2 * t2)")}
        at = {"mx": F.expr("fx * t0 / t2 + cx"), "my": F.expr("fy * t1 / t2 + cy")}
    # the covariance in the image is T T^T with T = J V R S, two rows of three
    j = j.withColumns(jac | at)
    j = j.withColumns({f"x{c}": F.expr(f"a0 * v0{c} + a2 * v2{c}") for c in range(3)} | {f"y{c}": F.expr(f"b1 * v1{c} + b2 * v2{c}") for c in range(3)})
    j = j.withColumns({f"{o}{c}": F.expr(" + ".join(f"{n}{r} * s{r}{c}" for r in range(3))) for n, o in (("x", "g"), ("y", "h")) for c in range(3)})
    dot = lambda a, b: F.expr(" + ".join(f"{a}{c} * {b}{c}" for c in range(3)))
    j = j.withColumns({"p": dot("g", "g"), "q": dot("g", "h"), "r": dot("h", "h")})
    j = j.withColumns({"det0": F.expr("p * r - q * q"), "p": F.col("p") + blur, "r": F.col("r") + blur})
    j = j.withColumn("det", F.expr("p * r - q * q"))
    j = j.withColumns({"radius_x": F.ceil(EXTENT * F.sqrt("p")).cast("int"), "radius_y": F.ceil(EXTENT * F.sqrt("r")).cast("int")})
    good = seen & (F.col("det") > 0) & ~((F.col("radius_x") <= radius_clip) & (F.col("radius_y") <= radius_clip))
    for m, r, n in (("mx", "radius_x", size[0]), ("my", "radius_y", size[1])):
        good = good & (F.col(m) + F.col(r) > 0) & (F.col(m) - F.col(r) < n)
    j = _settled(j.withColumn("good", F.coalesce(good, F.lit(False))))
    good = F.col("good")
    if keep_culled:
        j = j.withColumns({r: F.when(good, F.col(r)).otherwise(0) for r in ("radius_x", "radius_y")})
    else:
        j = j.where(good)
    inv = F.when(F.col("det") > 0, F.col("det"))
    return j.select(
        *rest, "cam", "mx", "my", F.col("t2").alias("depth"), (F.col("r") / inv).alias("ca"), (-F.col("q") / inv).alias("cb"), (F.col("p") / inv).alias("cc"),
        "radius_x", "radius_y", F.sqrt(F.greatest(F.lit(0.0), F.col("det0") / inv)).alias("compensation"),
    )


#: Models of lens distortion: whether the radial part is a fraction, and whether there is a thin prism.
MODELS = {"pinhole": None, "radtan_5": (False, False), "rational_8": (True, False), "radtan_thin_prism_9": (False, True), "thin_prism_12": (True, True)}
#: Depth in front of the camera at least, and refinements of the time at which a shutter passes a pixel.
FRONT, REFINEMENTS = 1e-6, 6


def distorted(x, y, k, model: str):
    """Normalised image coordinates after the lens; ``k`` has k1 to k6, p1, p2, s1 to s4.  Columns or arrays."""
    if MODELS[model] is None:
        return x, y
    fraction, prism = MODELS[model]
    r2 = x * x + y * y
    radial = 1 + r2 * (k[0] + r2 * (k[1] + r2 * k[2]))
    if fraction:
        radial = radial / (1 + r2 * (k[3] + r2 * (k[4] + r2 * k[5])))
    u = x * radial + 2 * k[6] * x * y + k[7] * (r2 + 2 * x * x)
    v = y * radial + k[6] * (r2 + 2 * y * y) + 2 * k[7] * x * y
    return (u + r2 * (k[8] + r2 * k[9]), v + r2 * (k[10] + r2 * k[11])) if prism else (u, v)


def project_unscented(
    gaussians: DataFrame, cameras: Mapping[int, Camera], size: tuple[int, int], near: float = 0.01, far: float = 1e10, blur: float = 0.3,
    alpha: float = 0.1, beta: float = 2.0, kappa: float = 0.0, margin: float = 0.1, model: str = "pinhole",
    distortion: Mapping[int, Sequence[float]] | None = None, shutter: str = "none", last_views: Mapping[int, Sequence] | None = None,
    require_all: bool = True, radius_clip: float = 0.0,
) -> DataFrame:
    """The same from seven sigma points through the camera and their weighted moments.

    The camera may have a lens (``model`` and twelve coefficients for each in
    ``distortion``).  With a rolling ``shutter``, ``vertical`` or ``horizontal``, it moves from
    its view to that in ``last_views`` while rows or columns are read, and a point is seen
    at the time its pixel is.  The mean must lie between ``near`` and ``far``, no sigma point
    behind the camera, and all of them (or one, unless ``require_all``) in the image
    widened by ``margin``.
    """
    if model not in MODELS or shutter not in ("none", "vertical", "horizontal"):
        raise ValueError("unknown lens or shutter")
    lam = alpha * alpha * (3 + kappa) - 3
    spread = math.sqrt(3 + lam)
    rest = [c for c in gaussians.columns if c not in ("mean", "quat", "log_scale")]
    g = _parts(gaussians, rest)
    points = []
    for axis, sign in [(None, 0), *[(n, s) for n in range(3) for s in (1, -1)]]:
        xyz = [f"m{r}" + (f" + {sign * spread!r}D * s{r}{axis}" if sign else "") for r in range(3)]
        wm = lam / (3 + lam) if not sign else 0.5 / (3 + lam)
        wc = wm + (1 - alpha * alpha + beta if not sign else 0.0)
        points.append(f"named_struct('x', {xyz[0]}, 'y', {xyz[1]}, 'z', {xyz[2]}, 'wm', {wm!r}D, 'wc', {wc!r}D)")
    s = g.select(*rest, F.expr(f"inline(array({', '.join(points)}))"))
    spark = gaussians.sparkSession
    cams = cameras_frame(spark, cameras)
    lens = [(int(c), [float(k) for k in (distortion or {}).get(c, [0.0] * 12)], np.asarray((last_views or {}).get(c, view), float)[:3].ravel().tolist()) for c, (_, view) in cameras.items()]
    cams = cams.join(spark.createDataFrame(lens, "cam int, lens array<double>, last array<double>"), "cam")
    s = s.crossJoin(F.broadcast(cams))  # a bounded list
    if shutter == "none":
        s = s.withColumns({f"t{r}": F.expr(f"v{r}0 * x + v{r}1 * y + v{r}2 * z + v{r}3") for r in range(3)})
        s = s.withColumns({"_x": F.expr(f"IF(t2 > {FRONT!r}D, t0 / t2, NULL)"), "_y": F.expr(f"IF(t2 > {FRONT!r}D, t1 / t2, NULL)")})
        u, v = distorted(F.col("_x"), F.col("_y"), [F.col("lens")[n] for n in range(12)], model)
        s = s.withColumns({"u": F.col("fx") * u + F.col("cx"), "v": F.col("fy") * v + F.col("cy")})
    else:
        schema = [f"{f.name} {f.dataType.simpleString()}" for f in s.select(*rest, "cam", "wm", "wc").schema]
        s = s.mapInArrow(_rolling(rest, model, shutter, size, margin), ", ".join([*schema, "u double", "v double", "t2 double"]))
    seen = F.col("u").isNotNull()
    inside = F.coalesce((F.col("u") >= -margin * size[0]) & (F.col("u") < size[0] * (1 + margin)) & (F.col("v") >= -margin * size[1]) & (F.col("v") < size[1] * (1 + margin)), F.lit(False))
    m = s.groupBy(*rest, "cam").agg(
        (F.bool_and(seen) & (F.bool_and(inside) if require_all else F.bool_or(inside))).alias("ok"), F.sum(F.expr("wm * u")).alias("mx"), F.sum(F.expr("wm * v")).alias("my"), F.sum(F.expr("wm * t2")).alias("depth"),
        *[F.sum(F.expr(e)).alias(n) for n, e in (("sc", "wc"), ("su", "wc * u"), ("sv", "wc * v"), ("uu", "wc * u * u"), ("uv", "wc * u * v"), ("vv", "wc * v * v"))],
    ).where(F.col("ok") & F.col("depth").between(near, far))
    m = m.withColumns({
        "p": F.expr("uu - 2 * mx * su + sc * mx * mx") + blur,
        "q": F.expr("uv - mx * sv - my * su + sc * mx * my"),
        "r": F.expr("vv - 2 * my * sv + sc * my * my") + blur,
    }).withColumn("det", F.expr("p * r - q * q")).where("det > 0")
    m = m.withColumns({n: F.ceil(EXTENT * F.sqrt(c)).cast("int") for n, c in (("radius_x", "p"), ("radius_y", "r"))})
    m = m.where(~((F.col("radius_x") <= radius_clip) & (F.col("radius_y") <= radius_clip)))
    return m.select(*rest, "cam", "mx", "my", "depth", F.expr("r / det AS ca"), F.expr("-q / det AS cb"), F.expr("p / det AS cc"), "radius_x", "radius_y")


def _rolling(rest: Sequence[str], model: str, shutter: str, size: tuple[int, int], margin: float):
    """Points seen by cameras that move while the image is read: pixels (null: behind the camera) and depth half way."""
    import pyarrow as pa

    def quaternions(m: np.ndarray) -> np.ndarray:
        """Unit quaternions of rotation matrices: the eigenvector of the largest eigenvalue of a symmetric form of each."""
        a = lambda r, c: m[:, r, c]
        k = np.zeros((len(m), 4, 4))
        k[:, 0, 0], k[:, 1, 1] = a(0, 0) + a(1, 1) + a(2, 2), a(0, 0) - a(1, 1) - a(2, 2)
        k[:, 2, 2], k[:, 3, 3] = a(1, 1) - a(0, 0) - a(2, 2), a(2, 2) - a(0, 0) - a(1, 1)
        off = {(0, 1): a(2, 1) - a(1, 2), (0, 2): a(0, 2) - a(2, 0), (0, 3): a(1, 0) - a(0, 1), (1, 2): a(0, 1) + a(1, 0), (1, 3): a(0, 2) + a(2, 0), (2, 3): a(1, 2) + a(2, 1)}
        for (r, c), v in off.items():
            k[:, r, c] = k[:, c, r] = v
        return np.linalg.eigh(k)[1][:, :, 3]

    def turned(q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Points turned by unit quaternions."""
        w, axis = q[:, :1], q[:, 1:]
        t = 2 * np.cross(axis, p)
        return p + w * t + np.cross(axis, t)

    def run(batches):
        wide, high = size
        for b in batches:
            col = lambda n: b.column(n).to_numpy(zero_copy_only=False).astype(float)
            point = np.stack([col(n) for n in "xyz"], 1)
            first = np.stack([col(f"v{r}{c}") for r in range(3) for c in range(4)], 1).reshape(-1, 3, 4)
            last = b.column("last").flatten().to_numpy().reshape(-1, 3, 4)
            k = b.column("lens").flatten().to_numpy().reshape(-1, 12).T
            f, centre = np.stack([col("fx"), col("fy")], 1), np.stack([col("cx"), col("cy")], 1)
            q0, q1 = quaternions(first[:, :, :3]), quaternions(last[:, :, :3])
            q1 = np.where((q0 * q1).sum(1, keepdims=True) < 0, -q1, q1)  # the shorter way round

            def camera(at: np.ndarray) -> np.ndarray:
                q = q0 + at[:, None] * (q1 - q0)
                shift = first[:, :, 3] + at[:, None] * (last[:, :, 3] - first[:, :, 3])
                return turned(q / np.linalg.norm(q, axis=1, keepdims=True), point) + shift

            def image(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                """Pixels at a time, whether the point is in front, and in the widened image."""
                t = camera(at)
                front = t[:, 2] > FRONT
                z = np.where(front, t[:, 2], 1.0)
                px = f * np.stack(distorted(t[:, 0] / z, t[:, 1] / z, k, model), 1) + centre
                inside = front & (px >= [-margin * wide, -margin * high]).all(1) & (px < [wide * (1 + margin), high * (1 + margin)]).all(1)
                return px, front, inside

            n = len(point)
            (p0, f0, i0), (p1, f1, i1) = image(np.zeros(n)), image(np.ones(n))
            px, front, live = np.where((i0 | ~f1)[:, None], p0, p1), f0 | f1, i0 | i1
            for _ in range(REFINEMENTS):
                row = np.floor(px[:, 1]) / max(1, high - 1) if shutter == "vertical" else np.floor(px[:, 0]) / max(1, wide - 1)
                p, fr, ins = image(np.clip(row, 0, 1))
                px, front = np.where(live[:, None], p, px), np.where(live, fr, front)
                live &= ins
            uv = [pa.array(px[:, a], mask=~front) for a in range(2)]
            depth = camera(np.full(n, 0.5))[:, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*rest, "cam", "wm", "wc")), *uv, pa.array(depth)], [*rest, "cam", "wm", "wc", "u", "v", "t2"])

    return run


def _settled(df: DataFrame) -> DataFrame:
    """The same rows, their columns computed before any later filter.

    Filters are pushed below projections by writing out what columns stand for;
    for long chains of arithmetic that grows without bound, and a generator stops it.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def harmonics(x: Column, y: Column, z: Column, degree: int) -> list[Column]:
    """Real spherical harmonics up to a degree (4 at most), by order, of a unit direction; odd orders are negative.

    From the recurrences of the Legendre functions and of powers of x + iy, by sums
    and products alone; what doesn't depend on the direction is a number.
    """
    if not 0 <= degree <= 4:
        raise ValueError("degrees 0 to 4 are known")
    cos, sin = [1.0], [0.0]
    for _ in range(degree):
        cos, sin = [*cos, x * cos[-1] - y * sin[-1]], [*sin, x * sin[-1] + y * cos[-1]]
    legendre = {}
    for m in range(degree + 1):
        legendre[m, m] = float(math.prod(range(1, 2 * m, 2)))
        for n in range(m + 1, degree + 1):
            two = legendre.get((n - 2, m), 0.0)
            legendre[n, m] = (z * legendre[n - 1, m] * float(2 * n - 1) - two * float(n + m - 1)) / float(n - m)
    out = []
    for n in range(degree + 1):
        for m in range(-n, n + 1):
            a = abs(m)
            norm = math.sqrt((2 * n + 1) / (4 * math.pi) * math.factorial(n - a) / math.factorial(n + a)) * (math.sqrt(2) if m else 1) * (-1) ** a
            out.append(legendre[n, a] * (sin[a] if m < 0 else cos[a]) * norm)
    return [F.lit(b) if isinstance(b, float) and isinstance(x, Column) else b for b in out]


def evaluate_harmonics(rows: DataFrame, degree: int, coefficients: str = "sh", out: str = "color") -> DataFrame:
    """Colours ``0.5 + sum of coefficient * harmonic`` by view direction ``vx, vy, vz``; 0 unless both radii are positive.

    ``coefficients`` holds one array of (degree + 1)^2 values for each channel.
    """
    check_columns(rows, "vx", "vy", "vz", coefficients)
    n = F.sqrt(F.expr("vx * vx + vy * vy + vz * vz"))
    r = rows.withColumns({f"_{a}": F.col("v" + a) / n for a in "xyz"})
    basis = F.array(*harmonics(F.col("_x"), F.col("_y"), F.col("_z"), degree))
    r = r.withColumn("_b", basis)
    dot = lambda c: F.aggregate(F.zip_with(c, F.col("_b"), lambda a, b: a * b), F.lit(0.5), lambda s, x: s + x)
    seen = F.lit(True)
    if {"radius_x", "radius_y"} <= set(rows.columns):
        seen = (F.col("radius_x") > 0) & (F.col("radius_y") > 0)
    zero = F.transform(coefficients, lambda c: F.lit(0.0))
    return r.withColumn(out, F.when(seen, F.transform(coefficients, dot)).otherwise(zero)).drop("_b", "_x", "_y", "_z")


# -- tiles and blending ---------------------------------------------------------------


def intersect_tiles(footprints: DataFrame, size: tuple[int, int], tile: int = 16) -> DataFrame:
    """A row for each tile that a footprint's box touches: ``tile_x, tile_y``."""
    f = check_columns(footprints, "cam", "id", "mx", "my", "radius_x", "radius_y", "depth")
    for a, n in (("x", -(-size[0] // tile)), ("y", -(-size[1] // tile))):
        m, r = F.col("m" + a) / tile, F.col("radius_" + a) / tile
        lo = F.greatest(F.lit(0), F.least(F.lit(n), F.floor(m - r).cast("int")))
        hi = F.greatest(F.lit(0), F.least(F.lit(n), F.ceil(m + r).cast("int"))) - 1
        f = f.where((lo <= hi) & (F.col("radius_" + a) > 0)).withColumn("tile_" + a, F.explode(F.sequence(lo, hi)))
    return f


def tile_layout(pixels: DataFrame, tile: int = 16) -> DataFrame:
    """Tiles that hold requested pixels ``cam, u, v``, and how many."""
    t = pixels.select("cam", F.floor(F.col("u") / tile).cast("int").alias("tile_x"), F.floor(F.col("v") / tile).cast("int").alias("tile_y"))
    return t.groupBy("cam", "tile_x", "tile_y").agg(F.count("*").alias("n_pixels"))


def all_pixels(spark, cameras: Sequence[int], size: tuple[int, int]) -> DataFrame:
    w, h = size
    ids = F.array(*[F.lit(int(c)) for c in cameras])
    return spark.range(w * h).select(F.explode(ids).alias("cam"), (F.col("id") % w).cast("int").alias("u"), F.floor(F.col("id") / w).cast("int").alias("v"))


def contributions(footprints: DataFrame, pixels: DataFrame, size: tuple[int, int], tile: int = 16, opacity: str = "opacity") -> DataFrame:
    """Gaussians that are blended at each pixel, front to back, with ``alpha`` and ``weight``.

    Pixels meet the Gaussians of their tile by an equi-join.  Transmittance is the
    exponential of a running sum of log(1 - alpha); the Gaussian that would bring it to
    ``DONE`` or less is not blended, nor is what lies behind.
    """
    t = intersect_tiles(footprints, size, tile)
    p = pixels.select("cam", "u", "v", F.floor(F.col("u") / tile).cast("int").alias("tile_x"), F.floor(F.col("v") / tile).cast("int").alias("tile_y"))
    j = t.join(p, ["cam", "tile_x", "tile_y"])
    dx, dy = F.col("mx") - (F.col("u") + 0.5), F.col("my") - (F.col("v") + 0.5)
    sigma = 0.5 * (F.col("ca") * dx * dx + F.col("cc") * dy * dy) + F.col("cb") * dx * dy
    j = j.withColumn("_s", sigma).where("_s >= 0").withColumn("alpha", F.least(F.lit(MAX_ALPHA), F.col(opacity) * F.exp(-F.col("_s"))))
    j = j.where(F.col("alpha") >= MIN_ALPHA).withColumn("_l", F.log1p(-F.col("alpha")))
    w = Window.partitionBy("cam", "u", "v").orderBy("depth", "id")
    after = F.sum("_l").over(w.rowsBetween(Window.unboundedPreceding, 0))
    j = j.withColumns({"_a": after, "rank": F.row_number().over(w) - 1}).where(F.exp("_a") > DONE)
    return j.withColumn("weight", F.col("alpha") * F.exp(F.col("_a") - F.col("_l"))).drop("_s", "_l", "_a", "tile_x", "tile_y")


def rasterize(
    footprints: DataFrame, pixels: DataFrame, size: tuple[int, int], channels: Sequence[str], tile: int = 16, background: Sequence[float] | None = None
) -> DataFrame:
    """Blended channels, ``opacity`` and the last blended Gaussian (``last_id``) of each pixel."""
    c = contributions(footprints, pixels, size, tile)
    got = c.groupBy("cam", "u", "v").agg(
        *[F.sum(F.col("weight") * F.col(n)).alias(n) for n in channels], F.sum("weight").alias("_o"), F.max_by("id", "rank").alias("last_id"), F.count("*").alias("n_blended")
    )
    out = pixels.join(got, ["cam", "u", "v"], "left").withColumn("_o", F.coalesce("_o", F.lit(0.0)))
    back = background or [0.0] * len(channels)
    cols = [(F.coalesce(n, F.lit(0.0)) + (1 - F.col("_o")) * float(b)).alias(n) for n, b in zip(channels, back)]
    return out.select("cam", "u", "v", *cols, F.col("_o").alias("opacity"), "last_id", F.coalesce("n_blended", F.lit(0).cast("long")).alias("n_blended"))


def count_contributing(footprints: DataFrame, pixels: DataFrame, size, tile: int = 16) -> DataFrame:
    n = contributions(footprints, pixels, size, tile).groupBy("cam", "u", "v").agg(F.count("*").alias("n"), F.sum("weight").alias("opacity"))
    out = pixels.join(n, ["cam", "u", "v"], "left")
    return out.select("cam", "u", "v", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("opacity", F.lit(0.0)).alias("opacity"))


def contributing_ids(footprints: DataFrame, pixels: DataFrame, size, tile: int = 16) -> DataFrame:
    """All blended Gaussians of each pixel, front to back: ``cam, u, v, rank, id, weight``."""
    return contributions(footprints, pixels, size, tile).select("cam", "u", "v", "rank", "id", "weight")


def top_contributors(footprints: DataFrame, pixels: DataFrame, size, k: int, tile: int = 16) -> DataFrame:
    """The ``k`` Gaussians of largest weight at each pixel."""
    c = contributions(footprints, pixels, size, tile)
    n = F.row_number().over(Window.partitionBy("cam", "u", "v").orderBy(F.desc("weight"), "depth", "id"))
    return c.withColumn("n", n).where(F.col("n") <= k).select("cam", "u", "v", "n", "id", "weight")


def world_contributions(
    gaussians: DataFrame, footprints: DataFrame, rays: DataFrame, size: tuple[int, int], channels: Sequence[str], tile: int = 16
) -> DataFrame:
    """Gaussians that are blended at each pixel's own ray, front to back, with ``alpha`` and ``weight``.

    The ray is taken into the space where the Gaussian is a unit ball; its
    response is that of the ray's point nearest to the centre.
    """
    rest = ["id"]
    g = _parts(gaussians, rest)
    g = g.withColumns({f"_n{c}": F.expr(" + ".join(f"s{r}{c} * s{r}{c}" for r in range(3))) for c in range(3)})
    t = intersect_tiles(footprints, size, tile).select("cam", "id", "tile_x", "tile_y", "depth", "opacity", *channels).join(g, "id")
    p = rays.withColumns({"tile_x": F.floor(F.col("u") / tile).cast("int"), "tile_y": F.floor(F.col("v") / tile).cast("int")})
    j = p.join(t, ["cam", "tile_x", "tile_y"])
    # rows of the inverse of R S are columns of R S over their squared length
    j = j.withColumns({f"o{c}": F.expr(" + ".join(f"s{r}{c} * (o{a} - m{r})" for r, a in enumerate("xyz")) ) / F.col(f"_n{c}") for c in range(3)})
    j = j.withColumns({f"d{c}": F.expr(" + ".join(f"s{r}{c} * d{a}" for r, a in enumerate("xyz"))) / F.col(f"_n{c}") for c in range(3)})
    j = _settled(j.select("cam", "u", "v", "id", "depth", "opacity", *channels, "o0", "o1", "o2", "d0", "d1", "d2"))
    j = j.withColumns({"_oo": F.expr("o0 * o0 + o1 * o1 + o2 * o2"), "_od": F.expr("o0 * d0 + o1 * d1 + o2 * d2"), "_dd": F.expr("d0 * d0 + d1 * d1 + d2 * d2")})
    far = F.greatest(F.lit(0.0), F.expr("_oo - _od * _od / _dd"))
    j = _settled(j.withColumn("alpha", F.least(F.lit(MAX_ALPHA), F.col("opacity") * F.exp(-0.5 * far)))).where(F.col("alpha") >= MIN_ALPHA)
    w = Window.partitionBy("cam", "u", "v").orderBy("depth", "id")
    j = j.withColumn("_l", F.log1p(-F.col("alpha")))
    j = j.withColumn("_a", F.sum("_l").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.exp("_a") > DONE)
    return j.select("cam", "u", "v", "id", "depth", "opacity", *channels, "alpha", (F.col("alpha") * F.exp(F.col("_a") - F.col("_l"))).alias("weight"))


def rasterize_world(
    gaussians: DataFrame, footprints: DataFrame, rays: DataFrame, size: tuple[int, int], channels: Sequence[str], tile: int = 16
) -> DataFrame:
    """Blending by each pixel's own ray ``cam, u, v, ox, oy, oz, dx, dy, dz`` instead of a projected ellipse.

    ``footprints`` (projected, with ``opacity``) only say which tiles a Gaussian may touch.
    """
    j = world_contributions(gaussians, footprints, rays, size, channels, tile)
    got = j.groupBy("cam", "u", "v").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in channels], F.sum("weight").alias("opacity"))
    out = rays.select("cam", "u", "v").join(got, ["cam", "u", "v"], "left")
    return out.select("cam", "u", "v", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in (*channels, "opacity")])


# -- upkeep ---------------------------------------------------------------------------------


def finite_mask(gaussians: DataFrame, arrays: Sequence[str] = ("mean", "quat", "log_scale"), scalars: Sequence[str] = ("logit_opacity",)) -> DataFrame:
    """Whether every parameter of each Gaussian is a finite number."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    test = F.lit(True)
    for a in arrays:
        test = test & F.forall(a, ok)
    for s in scalars:
        test = test & ok(F.col(s))
    return gaussians.select("id", F.coalesce(test, F.lit(False)).alias("finite"))


def relocate(gaussians: DataFrame, most: int = 51, min_opacity: float = 0.005, ratio: str = "ratio") -> DataFrame:
    """Opacity and scale of Gaussians split into ``ratio`` copies, so that together they look as before."""
    g = check_columns(gaussians, "id", "log_scale", "logit_opacity", ratio)
    n = F.least(F.col(ratio), F.lit(most)).cast("int")
    g = g.withColumns({"_n": n, "_o": 1 / (1 + F.exp(-F.col("logit_opacity")))})
    new = 1 - F.pow(1 - F.col("_o"), 1.0 / F.col("_n"))
    g = g.withColumn("_p", F.greatest(F.lit(min_opacity), F.least(F.lit(1 - 2.220446049250313e-16), new)))
    # sum over i = 1..n and k < i of C(i-1, k) (-1)^k p^(k+1) / sqrt(k+1): by the hockey-stick rule each k counts C(n, k+1)
    term = (
        "aggregate(sequence(1, _n), named_struct('c', 1.0D, 's', 0.0D), (a, k) -> named_struct("
        "'c', a.c * (_n - k + 1) / k, 's', a.s + a.c * (_n - k + 1) / k * IF(k % 2 = 1, 1, -1) * pow(_p, k) / sqrt(k)), a -> a.s)"
    )
    g = g.withColumn("_c", F.col("_o") / F.expr(term))
    return g.select("id", F.log(F.col("_p") / (1 - F.col("_p"))).alias("logit_opacity"), F.transform("log_scale", lambda s: F.log(F.col("_c")) + s).alias("log_scale"))


def add_noise(gaussians: DataFrame, scale: float, t: float = 0.005, k: float = 100.0, seed: int = 0, noise: str | None = None) -> DataFrame:
    """Means moved by normal noise shaped by each covariance, less for opaque Gaussians.

    ``noise`` names a column of three given values; otherwise they are drawn by ``seed``.
    """
    g = unit_quaternions(check_columns(gaussians, "id", "mean", "quat", "log_scale", "logit_opacity"))
    if noise is None:
        g, noise = g.withColumn("_e", F.array(*[F.randn(seed + a) for a in range(3)])), "_e"
    opacity = 1 / (1 + F.exp(-F.col("logit_opacity")))
    g = g.withColumn("_f", scale / (1 + F.exp(k * (opacity - t))))
    g = g.withColumns({f"c{n}": F.expr(e) for n, e in covariance().items()})
    moved = []
    for a in range(3):
        total = sum(F.col(f"c{min(a, b)}{max(a, b)}") * F.col(noise)[b] for b in range(3))
        moved.append(F.col("mean")[a] + F.col("_f") * total)
    return g.select("id", F.array(*moved).alias("mean"))
