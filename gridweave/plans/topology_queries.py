"""Queries of constructors, properties, lookups and topology."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions.spatial import IJK, KEY
from gridweave.operators import build, topology
from gridweave.operators import query as q
from gridweave.operators.grids import Grids

from .base import EMB_SIZE, FEAT_E, LINE_SIZE, PTS_E, PTS_L, SCALE_E, VOX_E, VOX_L, box_sql, emb_grid, emb_points, line_grid, line_points, query


@query(f"WITH {VOX_L} SELECT * FROM vox")
def from_points(spark, sf):
    return build.from_points(line_points(spark, sf), LINE_SIZE).voxels


@query(f"WITH {VOX_E} SELECT * FROM vox")
def from_ijk(spark, sf):
    v = emb_grid(spark, sf).voxels
    return build.from_ijk(v.union(v), EMB_SIZE).voxels


@query(
    f"WITH {PTS_E} SELECT DISTINCT grid_id, CAST(floor(x / {SCALE_E[0]}) AS INTEGER) + di AS i, CAST(floor(y / {SCALE_E[1]}) AS INTEGER) + dj AS j, "
    f"CAST(floor(z / {SCALE_E[2]}) AS INTEGER) + dk AS k FROM pts, {box_sql(0, 1)} b"
)
def from_nearest_voxels_to_points(spark, sf):
    return build.from_nearest_voxels_to_points(emb_points(spark, sf), EMB_SIZE).voxels


@query(
    "SELECT CAST(g AS INTEGER) AS grid_id, CAST(x - 3 AS INTEGER) AS i, CAST(y AS INTEGER) AS j, CAST(z + 2 AS INTEGER) AS k FROM (SELECT unnest(range(3)) AS g), "
    "(SELECT unnest(range(6)) AS x), (SELECT unnest(range(5)) AS y), (SELECT unnest(range(4)) AS z) WHERE (x + y + z) % 2 = 0"
)
def from_dense(spark, sf):
    cells = build.from_dense(spark, 1, (6, 5, 4)).voxels
    return build.from_dense(spark, 3, (6, 5, 4), (-3, 0, 2), mask=cells.where("(i + j + k) % 2 = 0")).voxels


@query(
    "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, -1.0 + 0.25 + i * 0.5 AS x, 0.0 + 0.25 + j * 0.5 AS y, 2.0 + 0.125 + k * 0.25 AS z "
    "FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j), (SELECT unnest(range(4)) AS k)"
)
def from_dense_axis_aligned_bounds(spark, sf):
    g = build.from_dense_axis_aligned_bounds(spark, 1, (4, 4, 4), (-1, 0, 2), (1, 2, 3))
    return g.voxel_to_world(g.voxels).select(*IJK, "x", "y", "z")


S3 = "(sqrt(3.0::DOUBLE) / 3.0)"


@query(
    # triangles of three consecutive points of a grid
    f"WITH {PTS_E}, n AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY point_id) - 1 AS v FROM pts), "
    f"t AS (SELECT a.grid_id, a.x / 0.1::DOUBLE AS x, a.y / 0.1::DOUBLE AS y, a.z / 0.1::DOUBLE AS z, b.x / 0.1::DOUBLE - a.x / 0.1::DOUBLE AS ex, b.y / 0.1::DOUBLE - a.y / 0.1::DOUBLE AS ey, b.z / 0.1::DOUBLE - a.z / 0.1::DOUBLE AS ez, "
    f"c.x / 0.1::DOUBLE - a.x / 0.1::DOUBLE AS fx, c.y / 0.1::DOUBLE - a.y / 0.1::DOUBLE AS fy, c.z / 0.1::DOUBLE - a.z / 0.1::DOUBLE AS fz FROM n a JOIN n b ON a.grid_id = b.grid_id AND b.v = a.v + 1 JOIN n c ON a.grid_id = c.grid_id AND c.v = a.v + 2 WHERE a.v % 3 = 0), "
    f"s AS (SELECT *, CAST(ceil((sqrt(ex * ex + ey * ey + ez * ez) + {S3}) / {S3}) AS INTEGER) AS nu, CAST(ceil((sqrt(fx * fx + fy * fy + fz * fz) + {S3}) / {S3}) AS INTEGER) AS nv FROM t), "
    "u1 AS (SELECT *, unnest(range(nu)) AS a FROM s), u2 AS (SELECT *, unnest(range(nv)) AS b FROM u1), "
    "u3 AS (SELECT *, CASE WHEN nu = 1 THEN 0.0::DOUBLE ELSE a / (nu - 1)::DOUBLE END AS u, CASE WHEN nv = 1 THEN 0.0::DOUBLE ELSE b / (nv - 1)::DOUBLE END AS v FROM u2), "
    "u4 AS (SELECT *, CASE WHEN u + v >= 1 THEN 1 - u ELSE u END AS p, CASE WHEN u + v >= 1 THEN 1 - v ELSE v END AS q FROM u3) "
    "SELECT DISTINCT grid_id, CAST(floor(x + p * ex + q * fx + 0.5) AS INTEGER) AS i, CAST(floor(y + p * ey + q * fy + 0.5) AS INTEGER) AS j, CAST(floor(z + p * ez + q * fz + 0.5) AS INTEGER) AS k FROM u4"
)
def from_mesh(spark, sf):
    from pyspark.sql import Window

    n = emb_points(spark, sf).withColumn("v_id", F.row_number().over(Window.partitionBy("grid_id").orderBy("point_id")) - 1)
    c = n.groupBy("grid_id").agg(F.count("*").alias("c"))
    faces = n.join(c, "grid_id").where("v_id % 3 = 0 AND v_id + 2 < c").select("grid_id", F.col("v_id").alias("v0"), (F.col("v_id") + 1).alias("v1"), (F.col("v_id") + 2).alias("v2"))
    return build.from_mesh(n.drop("point_id"), faces, EMB_SIZE).voxels


@query("SELECT CAST(grid_id AS INTEGER) AS grid_id, 0::BIGINT AS num_voxels, 0.5::DOUBLE AS sx FROM (SELECT unnest(range(2)) AS grid_id)")
def from_zero_voxels(spark, sf):
    g = build.from_zero_voxels(spark, [0.5, 0.5], [0.0, 1.0])
    return g.num_voxels().join(g.meta.select("grid_id", "sx"), "grid_id")


@query(f"WITH {VOX_E} SELECT * FROM vox UNION ALL SELECT grid_id + 10, i, j, k FROM vox")
def concatenate_grids(spark, sf):
    g = emb_grid(spark, sf)
    return build.concatenate([(g, 10), (g, 10)]).voxels


# -- properties ------------------------------------------------------------------------


@query(
    f"WITH {VOX_L}, n AS (SELECT grid_id, count(*) AS num_voxels FROM vox GROUP BY grid_id) SELECT grid_id, num_voxels, "
    "CAST(sum(num_voxels) OVER (ORDER BY grid_id) AS BIGINT) AS cum_voxels, CAST(sum(num_voxels) OVER (ORDER BY grid_id) - num_voxels AS BIGINT) AS joffset FROM n"
)
def voxel_counts(spark, sf):
    return line_grid(spark, sf).offsets()


@query(f"WITH {VOX_E} SELECT count(*) AS total_voxels FROM vox")
def total_voxels(spark, sf):
    return emb_grid(spark, sf).total_voxels()


BBOX = ", ".join(f"min({a}) AS min_{a}" for a in IJK) + ", " + ", ".join(f"max({a}) AS max_{a}" for a in IJK)


@query(f"WITH {VOX_L} SELECT grid_id, {BBOX} FROM vox GROUP BY grid_id")
def bboxes(spark, sf):
    return line_grid(spark, sf).bboxes()


@query(f"WITH {VOX_E} SELECT grid_id, {BBOX.replace('max(i)', 'max(i) + 1').replace('max(j)', 'max(j) + 1').replace('max(k)', 'max(k) + 1')} FROM vox GROUP BY grid_id")
def dual_bboxes(spark, sf):
    return emb_grid(spark, sf).bboxes(dual=True)


@query(f"WITH {VOX_E} SELECT {BBOX} FROM vox")
def total_bbox(spark, sf):
    return emb_grid(spark, sf).total_bbox()


@query(f"WITH {VOX_L} SELECT grid_id, count(DISTINCT (floor(i / 8.0), floor(j / 8.0), floor(k / 8.0))) AS num_leaf_nodes FROM vox GROUP BY grid_id")
def leaf_counts(spark, sf):
    return line_grid(spark, sf).leaf_counts()


@query("SELECT false AS has_zero_grids, false AS all_have_zero_voxels, true AS any_have_zero_voxels")
def emptiness(spark, sf):
    return build.concatenate([(emb_grid(spark, sf), 10), (build.from_zero_voxels(spark), 1)]).emptiness()


@query(f"WITH {VOX_E} SELECT grid_id, i, j, k, row_number() OVER (PARTITION BY grid_id ORDER BY i, j, k) - 1 AS idx FROM vox")
def active_grid_coords(spark, sf):
    return emb_grid(spark, sf).indexed()


@query("SELECT DISTINCT label AS grid_id, 0.1::DOUBLE AS vw_scale, 1.0::DOUBLE AS vw_shift, round(1 / 0.1::DOUBLE, 9) AS wv_scale, round(-1.0 / 0.1::DOUBLE, 9) AS wv_shift FROM embeddings")
def transform_matrices(spark, sf):
    g = build.from_points(emb_points(spark, sf), EMB_SIZE, 1.0)
    m = g.matrices()
    return m.select("grid_id", F.col("voxel_to_world")[0].alias("vw_scale"), F.col("voxel_to_world")[3].alias("vw_shift"), F.round(F.col("world_to_voxel")[5], 9).alias("wv_scale"), F.round(F.col("world_to_voxel")[7], 9).alias("wv_shift"))


@query("SELECT true AS is_same")
def is_same(spark, sf):
    g = emb_grid(spark, sf)
    return g.is_same(Grids(g.meta, g.voxels))


@query(f"WITH {VOX_E} SELECT CASE grid_id WHEN 7 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS grid_id, i, j, k FROM vox WHERE grid_id IN (7, 2, 5)")
def index_grid(spark, sf):
    return emb_grid(spark, sf).pick([7, 2, 5]).voxels


# -- lookups --------------------------------------------------------------------------------

#: Points moved by a bit, so that some leave the active voxels.
MOVED = "SELECT grid_id, point_id, x + 0.07::DOUBLE AS x, y - 0.05::DOUBLE AS y, z AS z FROM pts"


def moved_points(spark, sf):
    return emb_points(spark, sf).withColumns({"x": F.col("x") + 0.07, "y": F.col("y") - 0.05})


@query(
    f"WITH {VOX_E}, m AS ({MOVED}) SELECT m.grid_id, m.point_id, v.i IS NOT NULL AS inside FROM m LEFT JOIN vox v ON v.grid_id = m.grid_id AND v.i = floor(m.x / 0.1::DOUBLE + 0.5) "
    "AND v.j = floor(m.y / 0.1::DOUBLE + 0.5) AND v.k = floor(m.z / 0.1::DOUBLE + 0.5)"
)
def points_in_grid(spark, sf):
    return q.points_in_grid(moved_points(spark, sf), emb_grid(spark, sf)).select("grid_id", "point_id", "inside")


@query(f"WITH {VOX_L} SELECT a.grid_id, a.i + 1 AS i, a.j, a.k, b.i IS NOT NULL AS active FROM vox a LEFT JOIN vox b ON a.grid_id = b.grid_id AND b.i = a.i + 1 AND b.j = a.j AND b.k = a.k")
def coords_in_grid(spark, sf):
    g = line_grid(spark, sf)
    return q.coords_in_grid(g.voxels.withColumn("i", F.col("i") + 1), g)


def cubes_sql(word: str, name: str, empty: str) -> str:
    near = lambda a, d: f"CAST(floor(({a} + {d}) / 0.1::DOUBLE + 0.5) AS INTEGER)"
    parts = ", ".join(f"{near(a, '-0.04::DOUBLE')} AS {n}0, {near(a, '0.06::DOUBLE')} AS {n}1" for a, n in zip("xyz", IJK))
    return (
        f"WITH {VOX_E}, c AS (SELECT grid_id, point_id, {parts} FROM pts), e1 AS (SELECT *, unnest(range(i0, i1 + 1)) AS i FROM c), e2 AS (SELECT *, unnest(range(j0, j1 + 1)) AS j FROM e1), "
        f"e3 AS (SELECT *, unnest(range(k0, k1 + 1)) AS k FROM e2), r AS (SELECT e3.grid_id, e3.point_id, {word}(v.i IS NOT NULL) AS t FROM e3 LEFT JOIN vox v USING (grid_id, i, j, k) GROUP BY 1, 2) "
        f"SELECT p.grid_id, p.point_id, coalesce(r.t, {empty}) AS {name} FROM pts p LEFT JOIN r USING (grid_id, point_id)"
    )


@query(cubes_sql("bool_and", "inside", "true"))
def cubes_in_grid(spark, sf):
    return q.cubes_in_grid(emb_points(spark, sf), emb_grid(spark, sf), (-0.04,) * 3, (0.06,) * 3).select("grid_id", "point_id", "inside")


@query(cubes_sql("bool_or", "touches", "false"))
def cubes_intersect_grid(spark, sf):
    return q.cubes_intersect_grid(emb_points(spark, sf), emb_grid(spark, sf), (-0.04,) * 3, (0.06,) * 3).select("grid_id", "point_id", "touches")


IDX = "idx AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY i, j, k) - 1 AS idx FROM vox)"


@query(
    f"WITH {VOX_L}, {IDX}, o AS (SELECT grid_id, sum(count(*)) OVER (ORDER BY grid_id) - count(*) AS b FROM vox GROUP BY grid_id) "
    "SELECT v.grid_id, v.i, v.j + 1 AS j, v.k, CAST(coalesce(x.idx + o.b, -1) AS BIGINT) AS idx FROM vox v LEFT JOIN idx x ON x.grid_id = v.grid_id AND x.i = v.i AND x.j = v.j + 1 AND x.k = v.k LEFT JOIN o ON o.grid_id = v.grid_id"
)
def ijk_to_index(spark, sf):
    g = line_grid(spark, sf)
    return q.ijk_to_index(g.voxels.withColumn("j", F.col("j") + 1), g, cumulative=True)


@query(
    f"WITH {VOX_E}, p AS (SELECT grid_id, point_id, {', '.join(f'CAST(floor({a} / 0.1::DOUBLE + 0.5) AS INTEGER) AS {n}' for a, n in zip('xyz', IJK))} FROM pts), w AS (SELECT * FROM vox UNION SELECT grid_id, i + 1, j, k FROM vox) "
    "SELECT w.*, CAST(coalesce(max(p.point_id), -1) AS BIGINT) AS inv FROM w LEFT JOIN p USING (grid_id, i, j, k) GROUP BY ALL"
)
def ijk_to_inv_index(spark, sf):
    """The last point in each voxel, of a grid that also has the next voxel along i, where there may be none."""
    from gridweave.functions.spatial import nearest

    g = emb_grid(spark, sf)
    p = g.world_to_voxel(emb_points(spark, sf))
    rows = p.select("grid_id", *[nearest(F.col("v" + a)).alias(n) for a, n in zip("xyz", IJK)], F.col("point_id").alias("pos"))
    return q.ijk_to_inv_index(rows, g.with_voxels(g.voxels.union(g.voxels.withColumn("i", F.col("i") + 1)).distinct()))


@query(
    f"WITH {VOX_E}, {IDX} SELECT v.grid_id, v.i, v.j, v.k, CAST((di + 1) * 9 + (dj + 1) * 3 + dk + 1 AS INTEGER) AS tap, coalesce(x.idx, -1) AS idx FROM (vox v CROSS JOIN {box_sql(-1, 1)} b) "
    "LEFT JOIN idx x ON x.grid_id = v.grid_id AND x.i = v.i + di AND x.j = v.j + dj AND x.k = v.k + dk"
)
def neighbor_indexes(spark, sf):
    g = emb_grid(spark, sf)
    arrays = q.neighbor_indexes(g.voxels, g, 1)
    return arrays.select(*KEY, F.posexplode("neighbors").alias("tap", "idx"))


@query(f"WITH {VOX_L} SELECT *, i BETWEEN 1 AND 6 AND j BETWEEN 2 AND 7 AND k BETWEEN 0 AND 3 AS inside FROM vox")
def active_in_bounds(spark, sf):
    return q.active_in_bounds(line_grid(spark, sf), (1, 2, 0), (6, 7, 3))


@query(f"WITH {VOX_E} SELECT *, (i + 0.5 / 0.1::DOUBLE) * 0.1::DOUBLE AS x, (j + 0.5 / 0.1::DOUBLE) * 0.1::DOUBLE AS y, (k + 0.5 / 0.1::DOUBLE) * 0.1::DOUBLE AS z FROM vox")
def voxel_to_world(spark, sf):
    g = emb_grid(spark, sf)
    half = Grids(g.meta, g.voxels, ((0.1,) * 3, (0.5,) * 3))
    return half.voxel_to_world(g.voxels)


@query(f"WITH {PTS_L} SELECT grid_id, point_id, x / 5.0::DOUBLE AS vx, y / 10000.0::DOUBLE AS vy, z / 0.02::DOUBLE AS vz FROM pts")
def world_to_voxel(spark, sf):
    return line_grid(spark, sf).world_to_voxel(line_points(spark, sf)).select("grid_id", "point_id", "vx", "vy", "vz")


# -- topology -----------------------------------------------------------------------------------


@query(f"WITH {VOX_L} SELECT * FROM vox UNION SELECT grid_id, i + 2, j, k FROM vox")
def merged_grid(spark, sf):
    g = line_grid(spark, sf)
    return topology.merged_grid(g, g.with_voxels(g.voxels.withColumn("i", F.col("i") + 2))).voxels


@query(f"WITH {FEAT_E} SELECT grid_id, i, j, k FROM feat WHERE f > 2")
def pruned_grid(spark, sf):
    from .base import feature

    g = emb_grid(spark, sf)
    return topology.pruned_grid(g, feature(g.voxels).withColumn("keep", F.col("f") > 2)).voxels


@query(f"WITH {VOX_L} SELECT * FROM vox WHERE i BETWEEN 2 AND 8 AND j BETWEEN 0 AND 5 AND k BETWEEN 1 AND 4")
def clipped_grid(spark, sf):
    return topology.clipped_grid(line_grid(spark, sf), (2, 0, 1), (8, 5, 4)).voxels


@query(f"WITH {FEAT_E} SELECT * FROM feat WHERE i BETWEEN -grid_id AND grid_id AND j BETWEEN -1 AND 1 AND k BETWEEN -2 AND grid_id")
def clip(spark, sf):
    from .base import feature

    g = emb_grid(spark, sf)
    n = F.col("grid_id")
    bounds = g.meta.select("grid_id", (-n).alias("min_i"), F.lit(-1).alias("min_j"), F.lit(-2).alias("min_k"), n.alias("max_i"), F.lit(1).alias("max_j"), n.alias("max_k"))
    return topology.clip(g, feature(g.voxels), bounds)[1]


@query(f"WITH {VOX_L} SELECT DISTINCT grid_id, i + di AS i, j + dj AS j, k + dk AS k FROM vox, {box_sql(-1, 1)} b")
def dilated_grid(spark, sf):
    return topology.dilated_grid(line_grid(spark, sf), 1).voxels


@query(f"WITH {VOX_E} SELECT DISTINCT grid_id, i + di AS i, j + dj AS j, k + dk AS k FROM vox, {box_sql(0, 1)} b")
def dual_grid(spark, sf):
    return topology.dual_grid(emb_grid(spark, sf)).voxels


@query(
    f"WITH {VOX_L} SELECT v.grid_id, v.i, v.j, v.k FROM vox v, {box_sql(0, 1)} b JOIN vox w ON w.grid_id = v.grid_id AND w.i = v.i + di AND w.j = v.j + dj AND w.k = v.k + dk "
    "GROUP BY ALL HAVING count(*) = 8"
)
def dual_grid_inner(spark, sf):
    return topology.dual_grid(line_grid(spark, sf), exclude_border=True).voxels


@query(f"WITH {VOX_L} SELECT DISTINCT grid_id, i + di AS i, j + dj AS j, k + dk AS k FROM vox, {box_sql(-1, 2)} b")
def padded_grid(spark, sf):
    return topology.padded_grid(line_grid(spark, sf), -1, 2).voxels


@query(f"WITH {VOX_E} SELECT DISTINCT grid_id, CAST(floor(i / 2.0) AS INTEGER) AS i, CAST(floor(j / 3.0) AS INTEGER) AS j, CAST(floor(k / 2.0) AS INTEGER) AS k FROM vox")
def coarsened_grid(spark, sf):
    return topology.coarsened_grid(emb_grid(spark, sf), (2, 3, 2)).voxels


@query("SELECT DISTINCT label AS grid_id, round(2 * 0.1::DOUBLE, 9) AS sx, round(3 * 0.1::DOUBLE, 9) AS sy, round(0.05::DOUBLE, 9) AS ox, round(0.1::DOUBLE, 9) AS oy FROM embeddings")
def coarsened_transform(spark, sf):
    m = topology.coarsened_grid(emb_grid(spark, sf), (2, 3, 2)).meta
    return m.select("grid_id", *[F.round(c, 9).alias(c) for c in ("sx", "sy", "ox", "oy")])


@query(f"WITH {VOX_E} SELECT *, CAST(floor(i / 4.0) AS INTEGER) AS ci, CAST(floor(j / 4.0) AS INTEGER) AS cj, CAST(floor(k / 4.0) AS INTEGER) AS ck FROM vox")
def coarse_ijk(spark, sf):
    return topology.coarse_ijk(emb_grid(spark, sf), 4)


@query(f"WITH {FEAT_E} SELECT grid_id, i * 2 + di AS i, j * 2 + dj AS j, k * 2 + dk AS k FROM feat, {box_sql(0, 1)} b WHERE f < 3")
def refined_grid(spark, sf):
    from .base import feature

    g = emb_grid(spark, sf)
    return topology.refined_grid(g, 2, feature(g.voxels).withColumn("keep", F.col("f") < 3)).voxels


@query(
    f"WITH {VOX_L}, c AS (SELECT grid_id, i - di + 1 AS i, j - dj + 1 AS j, k - dk + 1 AS k FROM vox, {box_sql(0, 2)} b) SELECT DISTINCT grid_id, CAST(floor(i / 2.0) AS INTEGER) AS i, "
    "CAST(floor(j / 2.0) AS INTEGER) AS j, CAST(floor(k / 2.0) AS INTEGER) AS k FROM c WHERE i % 2 = 0 AND j % 2 = 0 AND k % 2 = 0"
)
def conv_grid(spark, sf):
    return topology.conv_grid(line_grid(spark, sf), 3, 2).voxels


@query(f"WITH {VOX_E} SELECT DISTINCT grid_id, 2 * i + di - 1 AS i, 2 * j + dj - 1 AS j, 2 * k + dk - 1 AS k FROM vox, {box_sql(0, 2)} b")
def conv_transpose_grid(spark, sf):
    return topology.conv_transpose_grid(emb_grid(spark, sf), 3, 2).voxels


@query(
    f"WITH {VOX_E}, {IDX}, e AS (SELECT * FROM (VALUES {', '.join(str(p) for p in topology.CUBE_EDGES)}) t(a, b)), "
    f"c AS (SELECT grid_id, idx * 8 + di * 4 + dj * 2 + dk AS v, i + di - 0.5 AS x, j + dj - 0.5 AS y, k + dk - 0.5 AS z FROM idx, {box_sql(0, 1)} b) "
    "SELECT i.grid_id, i.idx * 8 + e.a AS v0, i.idx * 8 + e.b AS v1, CAST(abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) AS DOUBLE) AS length FROM idx i CROSS JOIN e "
    "JOIN c p ON p.grid_id = i.grid_id AND p.v = i.idx * 8 + e.a JOIN c q ON q.grid_id = i.grid_id AND q.v = i.idx * 8 + e.b"
)
def edge_network(spark, sf):
    v, e = topology.edge_network(emb_grid(spark, sf), voxel_coordinates=True)
    p = v.select("grid_id", *[F.col(c).alias(n) for c, n in (("v_id", "v0"), ("x", "px"), ("y", "py"), ("z", "pz"))])
    r = v.select("grid_id", *[F.col(c).alias(n) for c, n in (("v_id", "v1"), ("x", "qx"), ("y", "qy"), ("z", "qz"))])
    length = F.abs(F.col("px") - F.col("qx")) + F.abs(F.col("py") - F.col("qy")) + F.abs(F.col("pz") - F.col("qz"))
    return e.join(p, ["grid_id", "v0"]).join(r, ["grid_id", "v1"]).select("grid_id", "v0", "v1", length.alias("length"))


def morton_sql(a: str, b: str, c: str) -> str:
    bits = " + ".join(f"((({x} >> {n}) & 1) << {3 * n + s})" for n in range(8) for s, x in enumerate((a, b, c)))
    return f"CAST({bits} AS BIGINT)"


LOW = f"{VOX_E}, low AS (SELECT min(i) AS a, min(j) AS b, min(k) AS c FROM vox), s AS (SELECT vox.*, CAST(i - a AS BIGINT) AS ci, CAST(j - b AS BIGINT) AS cj, CAST(k - c AS BIGINT) AS ck FROM vox, low)"


@query(f"WITH {LOW} SELECT grid_id, i, j, k, {morton_sql('ci', 'cj', 'ck')} AS code FROM s")
def morton(spark, sf):
    return topology.curve_codes(emb_grid(spark, sf), "morton")


@query(f"WITH {VOX_E}, s AS (SELECT *, CAST(i + 64 AS BIGINT) AS ci, CAST(j + 64 AS BIGINT) AS cj, CAST(k + 64 AS BIGINT) AS ck FROM vox) SELECT grid_id, i, j, k, {morton_sql('ci', 'cj', 'ck')} AS code FROM s")
def morton_from_ijk(spark, sf):
    """Codes of coordinates moved by a given offset."""
    return topology.curve_codes(emb_grid(spark, sf), "morton", (64, 64, 64))


@query(f"WITH {LOW} SELECT grid_id, i, j, k, {morton_sql('ck', 'cj', 'ci')} AS code FROM s")
def morton_zyx(spark, sf):
    return topology.curve_codes(emb_grid(spark, sf), "morton_zyx")


def hilbert_sql(order: tuple[str, str, str]) -> str:
    """The transform unrolled over the bits as a chain of subqueries; all 21 bits, since high zero bits swap axes."""
    inner = f"SELECT grid_id, i, j, k, {order[0]} AS a, {order[1]} AS b, {order[2]} AS c FROM s"
    for p in range(20, -1, -1):
        m = (1 << p) - 1
        inner = f"SELECT grid_id, i, j, k, CASE WHEN (a >> {p}) & 1 = 1 THEN xor(a, {m}) ELSE a END AS a, b, c FROM ({inner})"
        for x in "bc":
            other = "c" if x == "b" else "b"
            swap = f"(xor(a, {x}) & {m})"
            inner = (
                f"SELECT grid_id, i, j, k, CASE WHEN ({x} >> {p}) & 1 = 1 THEN xor(a, {m}) ELSE xor(a, {swap}) END AS a, "
                f"CASE WHEN ({x} >> {p}) & 1 = 1 THEN {x} ELSE xor({x}, {swap}) END AS {x}, {other} FROM ({inner})"
            )
    gray = " + ".join(f"((({x} >> {n}) & 1) << {3 * n + s})" for n in range(21) for s, x in ((2, "a"), (1, "b"), (0, "c")))
    g = f"SELECT grid_id, i, j, k, {gray} AS g FROM ({inner})"
    for shift in (1, 2, 4, 8, 16, 32):  # Gray to binary
        g = f"SELECT grid_id, i, j, k, xor(g, g >> {shift}) AS g FROM ({g})"
    return f"WITH {LOW} SELECT grid_id, i, j, k, CAST(g AS BIGINT) AS code FROM ({g})"


@query(hilbert_sql(("ci", "cj", "ck")))
def hilbert(spark, sf):
    return topology.curve_codes(emb_grid(spark, sf), "hilbert")


@query(hilbert_sql(("ck", "cj", "ci")))
def hilbert_zyx(spark, sf):
    return topology.curve_codes(emb_grid(spark, sf), "hilbert_zyx")


__all__ = ["PTS_L"]
