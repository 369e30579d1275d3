"""Queries of sampling, pooling, injection, convolution and layers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridweave.functions.spatial import IJK, KEY, settle
from gridweave.operators import conv, nn, pool, sample, topology

from .base import FEAT_E, FEAT_L, PTS_E, SCALE_E, SCALE_L, VOX_E, box_sql, emb_grid, emb_points, feat_sql, feature, line_grid, line_points, query, settled
from .topology_queries import MOVED, moved_points


def _settled(df, *names):
    return df.withColumns({n: settle(F.col(n)) for n in names})


# -- sampling and splatting ---------------------------------------------------------------


def tri_sql(scale, points: str, grad: bool = False) -> str:
    """Rows of points and corners with weights (and slopes)."""
    base = ", ".join(f"floor({a} / {s}) AS b{i}, {a} / {s} - floor({a} / {s}) AS u{i}" for a, i, s in zip("xyz", IJK, scale))
    w = {i: f"(CASE WHEN d{i} = 1 THEN u{i} ELSE 1 - u{i} END)" for i in IJK}
    slopes = ""
    if grad:
        d = {i: f"(CASE WHEN d{i} = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)" for i in IJK}
        parts = {"x": f"{d['i']} * {w['j']} * {w['k']} / {scale[0]}", "y": f"{d['j']} * {w['i']} * {w['k']} / {scale[1]}", "z": f"{d['k']} * {w['i']} * {w['j']} / {scale[2]}"}
        slopes = ", " + ", ".join(f"{e} AS w{a}" for a, e in parts.items())
    return (
        f"corner AS (SELECT c.*, CAST(bi + di AS INTEGER) AS i, CAST(bj + dj AS INTEGER) AS j, CAST(bk + dk AS INTEGER) AS k, {w['i']} * {w['j']} * {w['k']} AS w{slopes} "
        f"FROM (SELECT *, {base} FROM ({points})) c, {box_sql(0, 1)} b)"
    )


@query(
    f"WITH {FEAT_E}, {tri_sql(SCALE_E, MOVED)} SELECT p.grid_id, p.point_id, {settled('coalesce(sum(c.w * f.f), 0)')} AS f FROM pts p LEFT JOIN corner c USING (grid_id, point_id) "
    "LEFT JOIN feat f ON f.grid_id = c.grid_id AND f.i = c.i AND f.j = c.j AND f.k = c.k GROUP BY 1, 2"
)
def sample_trilinear(spark, sf):
    g = emb_grid(spark, sf)
    return _settled(sample.sample(moved_points(spark, sf), g, feature(g.voxels)), "f")


@query(
    f"WITH {FEAT_E}, {tri_sql(SCALE_E, MOVED, True)} SELECT p.grid_id, p.point_id, {settled('coalesce(sum(c.w * f.f), 0)')} AS f, "
    + ", ".join(f"{settled(f'coalesce(sum(c.w{a} * f.f), 0)', 4)} AS f_d{a}" for a in "xyz")
    + " FROM pts p LEFT JOIN corner c USING (grid_id, point_id) LEFT JOIN feat f ON f.grid_id = c.grid_id AND f.i = c.i AND f.j = c.j AND f.k = c.k GROUP BY 1, 2"
)
def sample_trilinear_with_grad(spark, sf):
    g = emb_grid(spark, sf)
    out = sample.sample(moved_points(spark, sf), g, feature(g.voxels), grad=True)
    return _settled(out, "f").withColumns({f"f_d{a}": settle(F.col(f"f_d{a}"), 4) for a in "xyz"})


def bezier_sql(scale, points: str, grad: bool = False) -> str:
    base = ", ".join(f"floor({a} / {s} + 0.5) AS b{i}, {a} / {s} - floor({a} / {s} + 0.5) AS u{i}" for a, i, s in zip("xyz", IJK, scale))
    t = {i: f"(d{i} - u{i})" for i in IJK}
    w = {i: f"(CASE WHEN abs({x}) < 0.5 THEN 1.5 - 2 * {x} * {x} WHEN abs({x}) < 1.5 THEN (1.5 - abs({x})) * (1.5 - abs({x})) ELSE 0 END)" for i, x in t.items()}
    slopes = ""
    if grad:
        d = {i: f"(CASE WHEN abs({x}) < 0.5 THEN 4 * {x} WHEN abs({x}) < 1.5 THEN sign({x}) * (3 - 2 * abs({x})) ELSE 0 END)" for i, x in t.items()}
        parts = {"x": f"{d['i']} * {w['j']} * {w['k']} / {scale[0]}", "y": f"{d['j']} * {w['i']} * {w['k']} / {scale[1]}", "z": f"{d['k']} * {w['i']} * {w['j']} / {scale[2]}"}
        slopes = ", " + ", ".join(f"CAST({e} AS DOUBLE) AS w{a}" for a, e in parts.items())
    return (
        f"corner AS (SELECT c.*, CAST(bi + di AS INTEGER) AS i, CAST(bj + dj AS INTEGER) AS j, CAST(bk + dk AS INTEGER) AS k, CAST({w['i']} * {w['j']} * {w['k']} AS DOUBLE) AS w{slopes} "
        f"FROM (SELECT *, {base} FROM ({points})) c, {box_sql(-1, 1)} b)"
    )


@query(
    f"WITH {FEAT_E}, {bezier_sql(SCALE_E, MOVED)} SELECT p.grid_id, p.point_id, {settled('coalesce(sum(c.w * f.f), 0)')} AS f FROM pts p LEFT JOIN corner c USING (grid_id, point_id) "
    "LEFT JOIN feat f ON f.grid_id = c.grid_id AND f.i = c.i AND f.j = c.j AND f.k = c.k GROUP BY 1, 2"
)
def sample_bezier(spark, sf):
    g = emb_grid(spark, sf)
    return _settled(sample.sample(moved_points(spark, sf), g, feature(g.voxels), kind="bezier"), "f")


@query(
    f"WITH {FEAT_E}, {bezier_sql(SCALE_E, MOVED, True)} SELECT p.grid_id, p.point_id, "
    + ", ".join(f"{settled(f'coalesce(sum(c.w{a} * f.f), 0)', 4)} AS f_d{a}" for a in "xyz")
    + " FROM pts p LEFT JOIN corner c USING (grid_id, point_id) LEFT JOIN feat f ON f.grid_id = c.grid_id AND f.i = c.i AND f.j = c.j AND f.k = c.k GROUP BY 1, 2"
)
def sample_bezier_with_grad(spark, sf):
    g = emb_grid(spark, sf)
    out = sample.sample(moved_points(spark, sf), g, feature(g.voxels), kind="bezier", grad=True)
    return out.select("grid_id", "point_id", *[settle(F.col(f"f_d{a}"), 4).alias(f"f_d{a}") for a in "xyz"])


@query(
    f"WITH {FEAT_E}, m AS ({MOVED}), c AS (SELECT grid_id, point_id, di * 4 + dj * 2 + dk AS tap, x / 0.1::DOUBLE AS vx, y / 0.1::DOUBLE AS vy, z / 0.1::DOUBLE AS vz, CAST(floor(x / 0.1::DOUBLE) + di AS INTEGER) AS i, "
    f"CAST(floor(y / 0.1::DOUBLE) + dj AS INTEGER) AS j, CAST(floor(z / 0.1::DOUBLE) + dk AS INTEGER) AS k FROM m, {box_sql(0, 1)} b), "
    "r AS (SELECT c.grid_id, c.point_id, f.f, row_number() OVER (PARTITION BY c.grid_id, c.point_id ORDER BY (vx - c.i) * (vx - c.i) + (vy - c.j) * (vy - c.j) + (vz - c.k) * (vz - c.k), tap) AS n FROM c JOIN feat f USING (grid_id, i, j, k)) "
    "SELECT p.grid_id, p.point_id, CAST(coalesce(r.f, 0) AS DOUBLE) AS f FROM pts p LEFT JOIN r ON r.grid_id = p.grid_id AND r.point_id = p.point_id AND r.n = 1"
)
def sample_nearest(spark, sf):
    g = emb_grid(spark, sf)
    return sample.sample_nearest(moved_points(spark, sf), g, feature(g.voxels))


@query(
    f"WITH {FEAT_E}, {tri_sql(SCALE_E, 'SELECT * FROM pts')} SELECT v.grid_id, v.i, v.j, v.k, {settled('coalesce(sum(c.w), 0)')} AS f FROM vox v LEFT JOIN corner c USING (grid_id, i, j, k) GROUP BY 1, 2, 3, 4"
)
def splat_trilinear(spark, sf):
    points = emb_points(spark, sf).withColumn("f", F.lit(1.0))
    return _settled(sample.splat(points, emb_grid(spark, sf)), "f")


@query(
    f"WITH {FEAT_L}, {tri_sql(SCALE_L, 'SELECT * FROM pts')} SELECT v.grid_id, v.i, v.j, v.k, {settled('coalesce(sum(c.w * c.x), 0)', 8)} AS x FROM vox v LEFT JOIN corner c USING (grid_id, i, j, k) GROUP BY 1, 2, 3, 4"
)
def splat_trilinear_lineitem(spark, sf):
    out = sample.splat(line_points(spark, sf).withColumn("q", F.col("x")), line_grid(spark, sf), ("q",))
    return out.select(*KEY, settle(F.col("q"), 8).alias("x"))


@query(f"WITH {FEAT_E}, {bezier_sql(SCALE_E, 'SELECT * FROM pts')} SELECT v.grid_id, v.i, v.j, v.k, {settled('coalesce(sum(c.w), 0)')} AS f FROM vox v LEFT JOIN corner c USING (grid_id, i, j, k) GROUP BY 1, 2, 3, 4")
def splat_bezier(spark, sf):
    points = emb_points(spark, sf).withColumn("f", F.lit(1.0))
    return _settled(sample.splat(points, emb_grid(spark, sf), kind="bezier"), "f")


@query(
    f"WITH {FEAT_E}, {tri_sql(SCALE_E, 'SELECT * FROM pts', True)} SELECT v.grid_id, v.i, v.j, v.k, {settled('coalesce(sum(c.w * c.point_id + c.wx - 2 * c.wy + 0.5::DOUBLE * c.wz), 0)', 3)} AS f FROM vox v LEFT JOIN corner c USING (grid_id, i, j, k) GROUP BY 1, 2, 3, 4"
)
def sample_grad_adjoint(spark, sf):
    p = emb_points(spark, sf).withColumns({"f": F.col("point_id").cast("double"), "gx": F.lit(1.0), "gy": F.lit(-2.0), "gz": F.lit(0.5)})
    return sample.sample_grad_adjoint(p, emb_grid(spark, sf)).withColumn("f", settle(F.col("f"), 3))


# -- pooling, refinement, injection ------------------------------------------------------------


def coarse_sql(n: int, cols: str = "i, j, k") -> str:
    return ", ".join(f"CAST(floor({a} / {n}.0) AS INTEGER) AS {a}" for a in IJK)


@query(f"WITH {FEAT_L} SELECT grid_id, {coarse_sql(2)}, CAST(max(f) AS DOUBLE) AS f FROM feat GROUP BY 1, 2, 3, 4")
def max_pool(spark, sf):
    g = line_grid(spark, sf)
    return pool.max_pool(g, feature(g.voxels), 2)[1]


WINDOW_3_2 = (
    f"c AS (SELECT DISTINCT grid_id, {coarse_sql(2)} FROM vox), w AS (SELECT grid_id, (i - di) // 2 AS i, (j - dj) // 2 AS j, (k - dk) // 2 AS k, f, i AS fi, j AS fj, k AS fk FROM feat, {box_sql(0, 2)} b "
    "WHERE (i - di) % 2 = 0 AND (j - dj) % 2 = 0 AND (k - dk) % 2 = 0)"
)


@query(f"WITH {FEAT_E}, {WINDOW_3_2} SELECT c.*, CAST(coalesce(max(w.f), '-inf'::DOUBLE) AS DOUBLE) AS f FROM c LEFT JOIN w USING (grid_id, i, j, k) GROUP BY ALL")
def max_pool_strided(spark, sf):
    g = emb_grid(spark, sf)
    return pool.max_pool(g, feature(g.voxels), 3, 2)[1]


@query(f"WITH {FEAT_L} SELECT grid_id, {coarse_sql(2)}, CAST(sum(f) / 8.0 AS DOUBLE) AS f FROM feat GROUP BY 1, 2, 3, 4")
def avg_pool(spark, sf):
    g = line_grid(spark, sf)
    return pool.avg_pool(g, feature(g.voxels), 2)[1]


@query(
    f"WITH {FEAT_E}, t AS (SELECT *, floor(i / 2.0) AS ci, floor(j / 2.0) AS cj, floor(k / 2.0) AS ck FROM feat), r AS (SELECT *, row_number() OVER (PARTITION BY grid_id, ci, cj, ck ORDER BY f DESC, i, j, k) AS n FROM t) "
    f"SELECT grid_id, i, j, k, CAST(CASE WHEN n = 1 THEN {feat_sql(3).replace('i *', 'ci *').replace('j *', 'cj *').replace('k *', 'ck *')} ELSE 0 END AS DOUBLE) AS g FROM r"
)
def max_pool_adjoint(spark, sf):
    g = emb_grid(spark, sf)
    f = feature(g.voxels)
    coarse = topology.coarsened_grid(g, 2)
    return pool.max_pool_adjoint(f, feature(coarse.voxels, "g", 3), 2)


@query(
    f"WITH {FEAT_E}, t AS (SELECT *, floor(i / 2.0) AS ci, floor(j / 2.0) AS cj, floor(k / 2.0) AS ck FROM feat) SELECT grid_id, i, j, k, "
    f"CAST({feat_sql(3).replace('i *', 'ci *').replace('j *', 'cj *').replace('k *', 'ck *')} / 8.0 AS DOUBLE) AS g FROM t"
)
def avg_pool_adjoint(spark, sf):
    g = emb_grid(spark, sf)
    return pool.avg_pool_adjoint(feature(g.voxels), feature(topology.coarsened_grid(g, 2).voxels, "g", 3), 2)


@query(f"WITH {FEAT_E} SELECT grid_id, i * 2 + di AS i, j * 2 + dj AS j, k * 2 + dk AS k, CAST(f AS DOUBLE) AS f FROM feat, {box_sql(0, 1)} b")
def refine_values(spark, sf):
    g = emb_grid(spark, sf)
    return pool.refine(g, feature(g.voxels), 2)[1]


@query(f"WITH {FEAT_E} SELECT grid_id, {coarse_sql(2)}, CAST(sum(f) AS DOUBLE) AS g FROM feat GROUP BY 1, 2, 3, 4")
def refine_adjoint(spark, sf):
    g = emb_grid(spark, sf)
    return pool.refine_adjoint(topology.coarsened_grid(g, 2), feature(g.voxels, "g"), 2)


@query(f"WITH {FEAT_E}, s AS (SELECT grid_id, i + 1 AS i, j, k, f FROM feat) SELECT v.*, CAST(CASE WHEN s.i IS NOT NULL THEN s.f ELSE -1 END AS DOUBLE) AS f FROM vox v LEFT JOIN s USING (grid_id, i, j, k)")
def inject_default(spark, sf):
    g = emb_grid(spark, sf)
    return pool.inject(g, feature(g.voxels).withColumn("i", F.col("i") + 1), default=-1.0)


@query(
    f"WITH {FEAT_E}, p AS (SELECT grid_id, CAST(floor(x / 0.1::DOUBLE + 0.5) AS INTEGER) AS i, CAST(floor(y / 0.1::DOUBLE + 0.5) AS INTEGER) AS j, CAST(floor(z / 0.1::DOUBLE + 0.5) AS INTEGER) AS k, point_id FROM pts), "
    f"w AS (SELECT *, {feat_sql()} AS f FROM (SELECT * FROM vox UNION SELECT grid_id, i + 1, j, k FROM vox)) "
    "SELECT v.grid_id, v.i, v.j, v.k, CAST(coalesce(max(p.point_id), max(v.f)) AS DOUBLE) AS f FROM w v LEFT JOIN p USING (grid_id, i, j, k) GROUP BY 1, 2, 3, 4"
)
def inject_from_ijk(spark, sf):
    """Points' values into a grid that also has the next voxel along i, which keeps its own where there is no point."""
    from gridweave.functions.spatial import nearest

    g = emb_grid(spark, sf)
    p = g.world_to_voxel(emb_points(spark, sf))
    rows = p.select("grid_id", *[nearest(F.col("v" + a)).alias(n) for a, n in zip("xyz", IJK)], F.col("point_id").alias("pos"), F.col("point_id").cast("double").alias("f"))
    wide = g.with_voxels(g.voxels.union(g.voxels.withColumn("i", F.col("i") + 1)).distinct())
    return pool.inject_from_ijk(wide, rows, old=feature(wide.voxels))


@query(
    f"WITH {FEAT_E} SELECT CAST(g AS INTEGER) AS grid_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(z AS INTEGER) AS z, CAST(coalesce(f.f, 0) AS DOUBLE) AS f FROM (SELECT unnest(range(10)) AS g), (SELECT unnest(range(5)) AS x), "
    "(SELECT unnest(range(4)) AS y), (SELECT unnest(range(3)) AS z) LEFT JOIN feat f ON f.grid_id = g AND f.i = x - 2 AND f.j = y - 1 AND f.k = z - 1"
)
def inject_to_dense(spark, sf):
    g = emb_grid(spark, sf)
    return pool.inject_to_dense(spark, feature(g.voxels), 10, (-2, -1, -1), (5, 4, 3))


@query(f"WITH {FEAT_E} SELECT *, CAST(CASE WHEN i BETWEEN -2 AND 2 AND j BETWEEN -1 AND 2 AND k BETWEEN -1 AND 1 THEN (i + 2) * 100 + (j + 1) * 10 + k + 1 ELSE 0 END AS DOUBLE) AS d FROM vox")
def inject_from_dense(spark, sf):
    g = emb_grid(spark, sf)
    cells = spark.range(600).selectExpr("cast(id div 60 AS int) AS grid_id", "cast(id div 12 % 5 AS int) AS x", "cast(id div 3 % 4 AS int) AS y", "cast(id % 3 AS int) AS z")
    dense = cells.selectExpr("*", "cast(x * 100 + y * 10 + z AS double) AS d")
    return pool.inject_from_dense(g, dense, (-2, -1, -1), ("d",))


# -- convolution ----------------------------------------------------------------------------------


def weights(spark, taps: int, ci: int, co: int):
    """Weights that are multiples of 1/8: ``((tap * 5 + ci * 3 + co * 7) mod 11 - 5) / 8``."""
    rows = [(t, a, b, ((t * 5 + a * 3 + b * 7) % 11 - 5) / 8) for t in range(taps) for a in range(ci) for b in range(co)]
    return spark.createDataFrame(rows, "tap int, ci int, co int, w double")


def w_sql(tap: str, ci: int, co: int) -> str:
    return f"((({tap}) * 5 + {ci * 3 + co * 7}) % 11 - 5) / 8.0::DOUBLE"


TAP = "(di * 9 + dj * 3 + dk)"
EDGES = (
    f"e AS (SELECT v.grid_id, {TAP} AS tap, v.i AS di0, v.j AS dj0, v.k AS dk0, s.i AS si, s.j AS sj, s.k AS sk, s.f FROM (vox v CROSS JOIN {box_sql(0, 2)} b) JOIN feat s ON s.grid_id = v.grid_id AND s.i = v.i + di - 1 AND s.j = v.j + dj - 1 AND s.k = v.k + dk - 1)"
)


@query(f"WITH {FEAT_E}, {EDGES} SELECT grid_id, CAST(tap AS INTEGER) AS tap, si, sj, sk, di0 AS di, dj0 AS dj, dk0 AS dk FROM e")
def conv_edges(spark, sf):
    g = emb_grid(spark, sf)
    return conv.edges(g, g, 3).select("grid_id", "tap", "si", "sj", "sk", "di", "dj", "dk")


@query(f"WITH {FEAT_E}, {EDGES} SELECT grid_id, di0 AS i, dj0 AS j, dk0 AS k, CAST(sum({w_sql('tap', 0, 0)} * f) AS DOUBLE) AS f FROM e GROUP BY 1, 2, 3, 4")
def conv3_forward(spark, sf):
    g = emb_grid(spark, sf)
    plan = conv.ConvPlan.build(g, 3, 1, target=g, keep=False)
    return plan.execute(feature(g.voxels), weights(spark, 27, 1, 1))


@query(
    f"WITH {FEAT_E}, {EDGES}, h AS (SELECT e.*, {feat_sql(5).replace('i *', 'si *').replace('j *', 'sj *').replace('k *', 'sk *')} AS g FROM e) SELECT grid_id, di0 AS i, dj0 AS j, dk0 AS k, "
    + ", ".join(f"CAST(sum({w_sql('tap', 0, b)} * f + {w_sql('tap', 1, b)} * g) + {b + 1} AS DOUBLE) AS y{b}" for b in range(2))
    + " FROM h GROUP BY 1, 2, 3, 4"
)
def conv3_channels(spark, sf):
    g = emb_grid(spark, sf)
    x = feature(feature(g.voxels), "g", 5)
    layer = nn.SparseConv3d(weights(spark, 27, 2, 2), (3, 3, 3), bias=(1.0, 2.0))
    return layer(g, x, ("f", "g"), ("y0", "y1"), g)[1]


WIDE = 32
WIDE_X = f"x AS (SELECT grid_id, i, j, k, c, ((((i * 7 + j * 13 + k * 29 + c) % 17) + 17) % 17) / 4.0::DOUBLE AS x FROM vox, (SELECT CAST(unnest(range({WIDE})) AS INTEGER) AS c))"
WIDE_E = (
    f"e AS (SELECT v.grid_id, (di + 1) * 9 + (dj + 1) * 3 + dk + 1 AS tap, v.i, v.j, v.k, v.i + di AS si, v.j + dj AS sj, v.k + dk AS sk FROM vox v CROSS JOIN {box_sql(-1, 1)} b)"
)
WIDE_W = "(((e.tap * 5 + x.c * 3 + o * 7) % 11) - 5) / 8.0::DOUBLE"


def wide_features(g):
    """``WIDE`` channels of each voxel, multiples of 1/4."""
    return g.voxels.selectExpr(*KEY, f"transform(sequence(0, {WIDE - 1}), c -> pmod(i * 7 + j * 13 + k * 29 + c, 17) / 4.0D) AS x")


def wide_weights():
    tap, ci, co = np.indices((27, WIDE, WIDE))
    return ((tap * 5 + ci * 3 + co * 7) % 11 - 5) / 8.0


@query(
    f"WITH {VOX_E}, {WIDE_X}, {WIDE_E} SELECT e.grid_id, e.i, e.j, e.k, o AS co, CAST(sum(x.x * {WIDE_W}) AS DOUBLE) AS y "
    f"FROM e JOIN x ON x.grid_id = e.grid_id AND x.i = e.si AND x.j = e.sj AND x.k = e.sk CROSS JOIN (SELECT CAST(unnest(range({WIDE})) AS INTEGER) AS o) GROUP BY ALL"
)
def conv3_wide(spark, sf):
    """32 to 32 channels, as arrays."""
    g = emb_grid(spark, sf)
    plan = conv.ConvPlan.build(g, 3, 1, target=g, keep=False)
    y = plan.execute_arrays(wide_features(g), wide_weights())
    return y.select(*KEY, F.posexplode("y").alias("co", "y"))


@query(
    f"WITH {VOX_E}, {WIDE_X}, {WIDE_E} SELECT CAST(e.tap AS INTEGER) AS tap, x.c AS ci, z.c AS co, CAST(sum(x.x * z.x) AS DOUBLE) AS w FROM e JOIN x ON x.grid_id = e.grid_id AND x.i = e.si AND x.j = e.sj AND x.k = e.sk "
    "JOIN x z ON z.grid_id = e.grid_id AND z.i = e.i AND z.j = e.j AND z.k = e.k GROUP BY ALL"
)
def conv3_wide_weight_gradient(spark, sf):
    g = emb_grid(spark, sf)
    plan = conv.ConvPlan.build(g, 3, 1, target=g, keep=False)
    return plan.weight_gradient_arrays(wide_features(g), wide_features(g).withColumnRenamed("x", "y"))


@query(
    f"WITH {FEAT_E}, c AS (SELECT grid_id, i - di + 1 AS i, j - dj + 1 AS j, k - dk + 1 AS k, {TAP} AS tap, f FROM feat, {box_sql(0, 2)} b) SELECT grid_id, CAST(i // 2 AS INTEGER) AS i, CAST(j // 2 AS INTEGER) AS j, CAST(k // 2 AS INTEGER) AS k, "
    f"CAST(sum({w_sql('tap', 0, 0)} * f) AS DOUBLE) AS f FROM c WHERE i % 2 = 0 AND j % 2 = 0 AND k % 2 = 0 GROUP BY 1, 2, 3, 4"
)
def conv3_strided(spark, sf):
    g = emb_grid(spark, sf)
    return conv.ConvPlan.build(g, 3, 2, keep=False).execute(feature(g.voxels), weights(spark, 27, 1, 1))


@query(
    f"WITH {FEAT_E} SELECT grid_id, 2 * i + di - 1 AS i, 2 * j + dj - 1 AS j, 2 * k + dk - 1 AS k, CAST(sum({w_sql(TAP, 0, 0)} * f) AS DOUBLE) AS f FROM feat, {box_sql(0, 2)} b GROUP BY 1, 2, 3, 4"
)
def conv3_transpose(spark, sf):
    g = emb_grid(spark, sf)
    return conv.ConvPlan.build(g, 3, 2, transposed=True, keep=False).execute(feature(g.voxels), weights(spark, 27, 1, 1))


@query(
    f"WITH {FEAT_E}, {EDGES}, h AS (SELECT e.*, {feat_sql(5).replace('i *', 'di0 *').replace('j *', 'dj0 *').replace('k *', 'dk0 *')} AS g FROM e) SELECT grid_id, si AS i, sj AS j, sk AS k, CAST(sum({w_sql('tap', 0, 0)} * g) AS DOUBLE) AS f FROM h GROUP BY 1, 2, 3, 4"
)
def conv3_input_gradient(spark, sf):
    g = emb_grid(spark, sf)
    plan = conv.ConvPlan.build(g, 3, 1, target=g, keep=False)
    return plan.input_gradient(feature(g.voxels, "f", 5), weights(spark, 27, 1, 1))


@query(
    f"WITH {FEAT_E}, {EDGES}, h AS (SELECT e.*, {feat_sql(5).replace('i *', 'di0 *').replace('j *', 'dj0 *').replace('k *', 'dk0 *')} AS g FROM e) SELECT CAST(tap AS INTEGER) AS tap, 0 AS ci, 0 AS co, CAST(sum(f * g) AS DOUBLE) AS w FROM h GROUP BY 1"
)
def conv3_weight_gradient(spark, sf):
    g = emb_grid(spark, sf)
    plan = conv.ConvPlan.build(g, 3, 1, target=g, keep=False)
    return plan.weight_gradient(feature(g.voxels), feature(g.voxels, "f", 5))


@query(
    f"WITH {FEAT_E}, {EDGES}, a AS (SELECT count(*) AS degree FROM e GROUP BY grid_id, si, sj, sk), b AS (SELECT count(*) AS degree FROM e GROUP BY grid_id, di0, dj0, dk0) "
    "SELECT 'input' AS side, degree, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT 'output', degree, count(*) FROM b GROUP BY ALL"
)
def coverage_hist(spark, sf):
    g = emb_grid(spark, sf)
    return conv.ConvPlan.build(g, 3, 1, target=g, keep=False).coverage()


@query(f"WITH {VOX_E} SELECT grid_id, i, j, k, CAST(2 * {feat_sql()} - {feat_sql(5)} + 1 AS DOUBLE) AS a, CAST(0.5 * {feat_sql(5)} AS DOUBLE) AS b FROM vox")
def linear_map(spark, sf):
    x = feature(feature(emb_grid(spark, sf).voxels), "g", 5)
    return conv.linear(x, [[2.0, -1.0], [0.0, 0.5]], ("f", "g"), ("a", "b"), [1.0, 0.0])


# -- layers ---------------------------------------------------------------------------------------


@query(
    f"WITH {FEAT_L}, x AS (SELECT *, {feat_sql(5)} AS g FROM feat), s AS (SELECT grid_id, (sum(f) + sum(g)) / (2 * count(*)) AS m, (sum(f * f) + sum(g * g)) / (2 * count(*)) AS q FROM x GROUP BY 1) "
    f"SELECT x.grid_id, i, j, k, {settled('(f - m) / sqrt(q - m * m + 1e-5::DOUBLE)')} AS f, {settled('(g - m) / sqrt(q - m * m + 1e-5::DOUBLE)')} AS g FROM x JOIN s USING (grid_id)"
)
def group_norm(spark, sf):
    x = feature(feature(line_grid(spark, sf).voxels), "g", 5)
    return _settled(nn.group_norm(x, ("f", "g"), 1), "f", "g")


@query(
    f"WITH {FEAT_L}, s AS (SELECT avg(f) AS m, var_pop(f) AS v FROM feat) SELECT grid_id, i, j, k, {settled('(f - m) / sqrt(v + 1e-5::DOUBLE)')} AS f FROM feat, s"
)
def batch_norm(spark, sf):
    return _settled(nn.batch_norm(feature(line_grid(spark, sf).voxels), ("f",)), "f")


def unet_sql(width: int = 4) -> str:
    """The small network step by step: every layer sums over the 27 taps of each voxel."""
    names = [f"h{c}" for c in range(width)]
    cells = ", ".join(names)

    def layer(name: str, source: str, grid: str, ins: list[str], outs: list[str]) -> str:
        sums = ", ".join(f"coalesce(sum({' + '.join(f'{w_sql(TAP, a, b)} * s.{x}' for a, x in enumerate(ins))}), 0) AS {o}" for b, o in enumerate(outs))
        return (
            f"{name} AS MATERIALIZED (SELECT v.grid_id, v.i, v.j, v.k, {sums} FROM ({grid} v CROSS JOIN {box_sql(0, 2)} b) "
            f"LEFT JOIN {source} s ON s.grid_id = v.grid_id AND s.i = v.i + di - 1 AND s.j = v.j + dj - 1 AND s.k = v.k + dk - 1 GROUP BY 1, 2, 3, 4)"
        )

    def relu(name: str, source: str, form: str = "{}") -> str:
        return f"{name} AS MATERIALIZED (SELECT grid_id, i, j, k, {', '.join(f'greatest({form.format(n)}, 0) AS {n}' for n in names)} FROM {source})"

    norm = "({0} - avg({0}) OVER ()) / sqrt(var_pop({0}) OVER () + 1e-5)"
    low = ", ".join(f"CAST(floor({i} / 2.0) AS INTEGER) AS {i}" for i in IJK)
    steps = [
        FEAT_E,
        f"wide AS MATERIALIZED (SELECT DISTINCT grid_id, i + di AS i, j + dj AS j, k + dk AS k FROM vox, {box_sql(-1, 1)} b)",
        "x0 AS (SELECT w.*, coalesce(f.f, 0) AS f FROM wide w LEFT JOIN feat f USING (grid_id, i, j, k))",
        layer("c1", "x0", "wide", ["f"], names), relu("r1", "c1", norm), layer("c2", "r1", "wide", names, names), relu("skip", "c2"),
        f"low AS MATERIALIZED (SELECT grid_id, i, j, k, {', '.join(f'max({n}) AS {n}' for n in names)} FROM (SELECT grid_id, {low}, {cells} FROM skip) GROUP BY 1, 2, 3, 4)",
        "half AS (SELECT grid_id, i, j, k FROM low)", layer("c3", "low", "half", names, names), relu("r3", "c3"),
        f"both_ AS MATERIALIZED (SELECT s.grid_id, s.i, s.j, s.k, {', '.join(f's.{n} + coalesce(r.{n}, 0) AS {n}' for n in names)} FROM skip s LEFT JOIN r3 r ON r.grid_id = s.grid_id AND "
        + " AND ".join(f"r.{i} = CAST(floor(s.{i} / 2.0) AS INTEGER)" for i in IJK) + ")",
        layer("c4", "both_", "wide", names, names), relu("r4", "c4"), layer("c5", "r4", "wide", names, ["y"]),
    ]
    return f"WITH {', '.join(steps)} SELECT c5.grid_id, c5.i, c5.j, c5.k, {settled('c5.y', 4)} AS y FROM c5 JOIN vox USING (grid_id, i, j, k)"


@query(unet_sql())
def simple_unet(spark, sf):
    w = 4
    k = (3, 3, 3)
    layer = lambda a, b: nn.SparseConv3d(weights(spark, 27, a, b), k)
    net = nn.SimpleUNet(layer(1, w), layer(w, w), layer(w, w), layer(w, w), layer(w, 1), w)
    g = emb_grid(spark, sf)
    return net(g, feature(g.voxels), ("f",), ("y",)).withColumn("y", settle(F.col("y"), 4))


__all__ = ["PTS_E"]
