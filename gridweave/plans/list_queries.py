"""Queries of jagged lists, elementwise functions, rays, surfaces, fusion, splats and metrics."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridweave.functions import elementwise as el
from gridweave.functions.spatial import IJK, KEY, settle, with_box
from gridweave.operators import jagged, mesh, metrics, rays, sdf, splat_grads, splats, tsdf
from gridweave.operators.grids import Grids, meet, shared_grids, tasks_for

from .base import FEAT_E, VOX_E, box_sql, emb_grid, feature, query, settled, table

# -- jagged lists: line items by order --------------------------------------------------------

#: Values are whole multiples of 1/4, so that sums don't depend on order.
JAG = (
    "jag AS (SELECT CAST(l_orderkey AS INTEGER) AS outer_idx, 0 AS inner_idx, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS row_idx, "
    "CAST(l_quantity * 0.25 AS DOUBLE) AS v FROM lineitem)"
)
ORD = f"{JAG}, shape AS (SELECT CAST(o_orderkey AS INTEGER) AS outer_idx, 0 AS inner_idx, count(j.v) AS n FROM orders LEFT JOIN jag j ON j.outer_idx = o_orderkey GROUP BY 1)"


def jag(spark, sf):
    n = table(spark, sf, "lineitem")
    n = n.repartition(tasks_for(n, n.count()), "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return n.select(F.col("l_orderkey").cast("int").alias("outer_idx"), F.lit(0).alias("inner_idx"), (F.row_number().over(w) - 1).cast("long").alias("row_idx"), (F.col("l_quantity") * 0.25).alias("v"))


def shape(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("int").alias("outer_idx"), F.lit(0).alias("inner_idx"))
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("int").alias("outer_idx")).agg(F.count("*").alias("n"))
    return o.join(n, "outer_idx", "left").select("outer_idx", "inner_idx", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query(f"WITH {ORD} SELECT s.outer_idx, s.inner_idx, CAST(coalesce(sum(j.v), 0) AS DOUBLE) AS sum FROM shape s LEFT JOIN jag j USING (outer_idx, inner_idx) GROUP BY 1, 2")
def jsum(spark, sf):
    return jagged.jsum(jag(spark, sf), shape(spark, sf))


def extreme_sql(f: str) -> str:
    return (
        f"WITH {ORD}, m AS (SELECT outer_idx, {f}(v) AS value FROM jag GROUP BY 1), x AS (SELECT j.outer_idx, m.value, max(j.row_idx) AS index FROM jag j JOIN m ON m.outer_idx = j.outer_idx AND m.value = j.v GROUP BY 1, 2) "
        "SELECT s.outer_idx, s.inner_idx, coalesce(x.value, 0.0::DOUBLE) AS value, coalesce(x.index, -1) AS index FROM shape s LEFT JOIN x USING (outer_idx)"
    )


@query(extreme_sql("max"))
def jmax(spark, sf):
    return jagged.jmax(jag(spark, sf), shape(spark, sf))


@query(extreme_sql("min"))
def jmin(spark, sf):
    return jagged.jmin(jag(spark, sf), shape(spark, sf))


@query(f"WITH {JAG} SELECT outer_idx, inner_idx, row_number() OVER (PARTITION BY outer_idx ORDER BY v, row_idx) - 1 AS rank, row_idx FROM jag")
def jagged_argsort(spark, sf):
    return jagged.jargsort(jag(spark, sf))


@query(f"WITH {ORD} SELECT outer_idx, inner_idx, CAST(sum(n) OVER (ORDER BY outer_idx) - n AS BIGINT) AS begin, CAST(sum(n) OVER (ORDER BY outer_idx) AS BIGINT) AS \"end\" FROM shape")
def joffsets(spark, sf):
    return jagged.joffsets(shape(spark, sf))


@query(
    f"WITH {ORD}, o AS (SELECT outer_idx, CAST(row_number() OVER (ORDER BY outer_idx) - 1 AS INTEGER) AS jidx, sum(n) OVER (ORDER BY outer_idx) - n AS b FROM shape) "
    "SELECT j.outer_idx, j.inner_idx, j.row_idx, j.v, o.jidx, CAST(o.b + j.row_idx AS BIGINT) AS pos FROM jag j JOIN o USING (outer_idx)"
)
def jidx(spark, sf):
    return jagged.jidx(jag(spark, sf), shape(spark, sf))


@query(f"WITH {JAG} SELECT outer_idx, inner_idx, row_idx, v FROM jag UNION ALL SELECT outer_idx + (SELECT max(outer_idx) + 1 FROM jag), inner_idx, row_idx, v * 2 FROM jag")
def jcat_lists(spark, sf):
    j = jag(spark, sf)
    return jagged.jcat([j, j.withColumn("v", F.col("v") * 2)])


@query(f"WITH {JAG}, n AS (SELECT outer_idx, count(*) AS n FROM jag GROUP BY 1) SELECT outer_idx, inner_idx, row_idx, v FROM jag UNION ALL SELECT outer_idx, inner_idx, row_idx + n, v * 2 FROM jag JOIN n USING (outer_idx)")
def jcat_rows(spark, sf):
    j = jag(spark, sf)
    return jagged.jcat([j, j.withColumn("v", F.col("v") * 2)], 0)


@query(f"WITH {JAG} SELECT outer_idx, inner_idx, row_idx, v AS a, v * 2 AS b FROM jag")
def jcat_features(spark, sf):
    j = jag(spark, sf)
    a = j.withColumn("v", F.array("v"))
    out = jagged.jcat([a, j.withColumn("v", F.array(F.col("v") * 2))], 1)
    return out.select(*jagged.ROW, F.col("v")[0].alias("a"), F.col("v")[1].alias("b"))


@query(f"WITH {JAG} SELECT outer_idx, inner_idx, row_number() OVER (PARTITION BY outer_idx ORDER BY row_idx) - 1 AS row_idx, v FROM jag WHERE v > 5")
def rmask(spark, sf):
    j = jag(spark, sf)
    return jagged.rmask(j, j.withColumn("keep", F.col("v") > 5))


@query(f"WITH {JAG}, n AS (SELECT outer_idx, count(*) AS n FROM jag GROUP BY 1) SELECT a.outer_idx, a.inner_idx, a.row_idx, b.v FROM jag a JOIN n USING (outer_idx) JOIN jag b ON b.outer_idx = a.outer_idx AND b.row_idx = n - 1 - a.row_idx")
def jagged_index(spark, sf):
    j = jag(spark, sf)
    return jagged.jindex(j, j.select(*jagged.ROW, (-1 - F.col("row_idx")).alias("v")))


@query(f"WITH {JAG} SELECT CASE outer_idx WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS outer_idx, inner_idx, row_idx, v FROM jag WHERE outer_idx IN (7, 3, 5)")
def jagged_pick(spark, sf):
    return jagged.jpick(jag(spark, sf), [7, 3, 5])


@query(f"WITH {JAG} SELECT 0 AS outer_idx, 0 AS inner_idx, row_number() OVER (ORDER BY outer_idx, row_idx) - 1 AS row_idx, v FROM jag")
def jflatten(spark, sf):
    return jagged.jflatten(jag(spark, sf))


@query(
    f"WITH {JAG}, f AS (SELECT row_number() OVER (ORDER BY outer_idx, row_idx) - 1 AS p, v FROM jag), n AS (SELECT l_suppkey AS o, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT o, n, sum(n) OVER (ORDER BY o) - n AS b FROM n) "
    "SELECT CAST(s.o AS INTEGER) AS outer_idx, 0 AS inner_idx, CAST(f.p - s.b AS BIGINT) AS row_idx, f.v FROM f JOIN s ON f.p >= s.b AND f.p < s.b + s.n"
)
def jreshape(spark, sf):
    """All line items, in lists as long as the suppliers' own."""
    lists = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("outer_idx")).agg(F.count("*").alias("n"))
    return jagged.jreshape(jag(spark, sf), lists.select("outer_idx", F.lit(0).alias("inner_idx"), "n"))


@query(f"WITH {ORD} SELECT count(*) AS num_tensors, count(*) AS num_lists, CAST(sum(n) AS BIGINT) AS num_rows, 1 AS ldim FROM shape")
def jagged_sizes(spark, sf):
    return jagged.sizes(shape(spark, sf))


@query("WITH n AS (SELECT o_custkey, o_orderkey, count(l_orderkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT CAST(o_custkey AS INTEGER) AS outer_idx, CAST(len(list(n)) AS INTEGER) AS lists, CAST(sum(r * n) AS BIGINT) AS told FROM n GROUP BY 1")
def jagged_lshape(spark, sf):
    """Orders as lists within customers: their lengths in order, told by a weighted sum."""
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    inner = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("inner_idx")
    nested = o.select(F.col("o_custkey").cast("int").alias("outer_idx"), inner, F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    out = jagged.lshape(nested)
    return out.selectExpr("outer_idx", "size(lshape) AS lists", "aggregate(zip_with(lshape, sequence(1, size(lshape)), (n, r) -> n * r), 0L, (s, x) -> s + x) AS told")


@query(f"WITH {JAG} SELECT outer_idx, inner_idx, row_idx, CAST(trunc(v) AS BIGINT) AS v FROM jag")
def jagged_cast(spark, sf):
    return jagged.cast(jag(spark, sf), "long")


@query(f"WITH {JAG} SELECT outer_idx, inner_idx, CAST(count(*) AS INTEGER) AS n, first(v ORDER BY row_idx) AS first, last(v ORDER BY row_idx) AS last FROM jag GROUP BY 1, 2")
def unbind(spark, sf):
    u = jagged.unbind(jag(spark, sf))
    return u.select(*jagged.LIST, F.size("v").alias("n"), F.col("v")[0].alias("first"), F.element_at("v", -1).alias("last"))


@query(f"WITH {JAG} SELECT outer_idx, inner_idx, row_idx, 1.0::DOUBLE AS v FROM jag")
def jagged_ones(spark, sf):
    return jagged.filled(shape(spark, sf), "ones")


@query(f"WITH {JAG} SELECT outer_idx, inner_idx, row_idx, v + v * v AS v FROM jag")
def jagged_add(spark, sf):
    j = jag(spark, sf)
    return jagged.combine(j, j.withColumn("v", F.col("v") * F.col("v")), el.BINARY["add"], strict=True)


@query(
    "SELECT conv_id AS outer_idx, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1"
)
def jagged_from_indices(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("jidx"), F.col("turn").alias("pos"), F.length("text").alias("v"))
    j = jagged.from_indices(c)
    return j.groupBy(F.col("outer_idx").cast("long").alias("outer_idx")).agg(F.count("*").alias("n"), F.sum("v").alias("chars"))


@query(
    "WITH e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS p, label AS v, count(*) OVER () AS n FROM embeddings), o AS (SELECT CAST(unnest(range(7)) AS INTEGER) AS o) "
    "SELECT o AS outer_idx, 0 AS inner_idx, CAST(p - n * o // 7 AS BIGINT) AS row_idx, v FROM e JOIN o ON p >= n * o // 7 AND p < n * (o + 1) // 7"
)
def jagged_from_offsets(spark, sf):
    """All vectors' labels, cut at sevenths of their number."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.col("label").alias("v"))
    n = e.count()
    return jagged.from_offsets(e, [n * k // 7 for k in range(8)])


@query(
    f"WITH {JAG}, s AS (SELECT q.outer_idx, q.inner_idx, q.row_idx, k.row_idx AS at, (q.v * k.v + (1 - q.v) * k.v) / sqrt(2.0::DOUBLE) AS s, k.v FROM jag q JOIN jag k ON k.outer_idx = q.outer_idx), "
    "e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY outer_idx, row_idx)) AS e FROM s) "
    f"SELECT outer_idx, inner_idx, row_idx, {settled('sum(e * v) / sum(e)')} AS y FROM e GROUP BY 1, 2, 3"
)
def attention(spark, sf):
    j = jag(spark, sf)
    q = j.withColumn("v", F.array(F.col("v"), 1 - F.col("v")))
    k = j.withColumn("v", F.array(F.col("v"), F.col("v")))
    out = jagged.attention(q, k, j.withColumn("v", F.array("v")))
    return out.select(*jagged.ROW, settle(F.col("v")[0]).alias("y"))


# -- elementwise ---------------------------------------------------------------------------------

X = "CAST(embedding[1] AS DOUBLE) * 4"
SIG = f"(1 / (1 + exp(-({X}))))"
UNARY_SQL = {
    "abs": f"abs({X})", "neg": f"-({X})", "relu": f"greatest({X}, 0.0::DOUBLE)", "sigmoid": SIG, "tanh": f"tanh({X})", "silu": f"({X}) * {SIG}", "exp": f"exp({X})",
    "expm1": f"exp({X}) - 1", "floor": f"floor({X})", "ceil": f"ceil({X})", "trunc": f"trunc({X})", "log": f"ln({X} + 9)", "log1p": f"ln(1 + ({X} + 9))",
    "sqrt": f"sqrt({X} + 9)", "rsqrt": f"1 / sqrt({X} + 9)",
}


@query("SELECT vec_id, " + ", ".join(f"{settled(f'({e})')} AS {n}" for n, e in UNARY_SQL.items()) + " FROM embeddings")
def elementwise_unary(spark, sf):
    e = table(spark, sf, "embeddings")
    x = F.col("embedding")[0].cast("double") * 4
    shifted = {"log", "log1p", "sqrt", "rsqrt"}
    return e.select("vec_id", *[settle(el.unary(n, x + 9 if n in shifted else x)).alias(n) for n in UNARY_SQL])


Y = "CAST(label AS DOUBLE) - 4.5"
BINARY_SQL = {
    "add": f"{X} + ({Y})", "sub": f"{X} - ({Y})", "mul": f"{X} * ({Y})", "true_divide": f"{X} / ({Y})", "floor_divide": f"floor({X} / ({Y}))",
    "remainder": f"{X} - ({Y}) * floor({X} / ({Y}))", "fmod": f"{X} - ({Y}) * trunc({X} / ({Y}))", "maximum": f"greatest({X}, {Y})", "minimum": f"least({X}, {Y})",
    "fmax": f"greatest({X}, {Y})", "fmin": f"least({X}, {Y})",
}


@query("SELECT vec_id, " + ", ".join(f"{settled(f'({e})')} AS {n}" for n, e in BINARY_SQL.items()) + f", {X} < ({Y}) AS lt, {X} >= ({Y}) AS ge, {settled(f'({X} + (({Y}) - {X}) * 0.25)')} AS lerp FROM embeddings")
def elementwise_binary(spark, sf):
    e = table(spark, sf, "embeddings")
    x, y = F.col("embedding")[0].cast("double") * 4, F.col("label").cast("double") - 4.5
    cols = [settle(el.binary(n, x, y)).alias(n) for n in BINARY_SQL]
    return e.select("vec_id", *cols, el.binary("lt", x, y).alias("lt"), el.binary("ge", x, y).alias("ge"), settle(el.lerp(x, y, 0.25)).alias("lerp"))


@query(
    "WITH e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS p FROM embeddings), m AS (SELECT vec_id, max(v) AS hi, min(v) AS lo FROM e GROUP BY 1) "
    f"SELECT e.vec_id, {settled('sum(v::DOUBLE)', 4)} AS sum, {settled('avg(v::DOUBLE)', 5)} AS mean, max(v::DOUBLE) AS amax, min(v::DOUBLE) AS amin, min(CASE WHEN v = hi THEN p END) AS argmax, min(CASE WHEN v = lo THEN p END) AS argmin, "
    f"bool_and(v <> 0) AS \"all\", bool_or(v <> 0) AS \"any\", {settled('sqrt(sum(v::DOUBLE * v::DOUBLE))', 4)} AS norm, {settled('var_samp(v::DOUBLE)', 5)} AS var, {settled('stddev_samp(v::DOUBLE)', 5)} AS std FROM e JOIN m USING (vec_id) GROUP BY 1"
)
def feature_reductions(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    digits = {"sum": 4, "mean": 5, "norm": 4, "var": 5, "std": 5}
    cols = []
    for n in ("sum", "mean", "amax", "amin", "argmax", "argmin", "all", "any", "norm", "var", "std"):
        c = el.reduce_features(n, F.col("v"))
        cols.append((settle(c, digits[n]) if n in digits else c).alias(n))
    return e.select("vec_id", *cols)


# -- rays -------------------------------------------------------------------------------------------

#: Rays from left of the points through them, slightly tilted.
RAYS = "rays AS (SELECT grid_id, point_id AS ray_id, -6.0::DOUBLE AS ox, y AS oy, z AS oz, 1.0::DOUBLE AS dx, 0.01::DOUBLE AS dy, -0.02::DOUBLE AS dz FROM pts)"


def every_ray(spark, sf):
    """A ray through each point."""
    from .base import emb_points

    p = emb_points(spark, sf)
    return p.select("grid_id", F.col("point_id").alias("ray_id"), F.lit(-6.0).alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), F.lit(1.0).alias("dx"), F.lit(0.01).alias("dy"), F.lit(-0.02).alias("dz"))


def slab_sql() -> str:
    p = {a: f"(o{a} / 0.1::DOUBLE + 0.5)" for a in "xyz"}
    d = {a: f"(d{a} / 0.1::DOUBLE)" for a in "xyz"}
    enter = ", ".join(f"CASE WHEN {d[a]} > 0 THEN ({i} - {p[a]}) / {d[a]} ELSE ({i} + 1 - {p[a]}) / {d[a]} END" for a, i in zip("xyz", IJK))
    leave = ", ".join(f"CASE WHEN {d[a]} > 0 THEN ({i} + 1 - {p[a]}) / {d[a]} ELSE ({i} - {p[a]}) / {d[a]} END" for a, i in zip("xyz", IJK))
    return f"{RAYS}, hits AS (SELECT * FROM (SELECT r.grid_id, r.ray_id, i, j, k, greatest(0.0::DOUBLE, {enter}) AS t0, least({leave}) AS t1 FROM rays r JOIN vox v USING (grid_id)) WHERE t1 - t0 > 0)"


HITS = f"{VOX_E}, {slab_sql()}"


@query(f"WITH {HITS}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY grid_id, ray_id ORDER BY t0, i, j, k) - 1 AS INTEGER) AS n FROM hits) SELECT grid_id, ray_id, i, j, k, n, {settled('t0')} AS t0, {settled('t1')} AS t1 FROM n WHERE n < 5")
def voxels_along_rays(spark, sf):
    v = rays.voxels_along_rays(every_ray(spark, sf), emb_grid(spark, sf), 5)
    return v.withColumns({"t0": settle(F.col("t0")), "t1": settle(F.col("t1"))})


@query(f"WITH {HITS} SELECT r.grid_id, r.ray_id, count(h.i) > 0 AS hit FROM rays r LEFT JOIN hits h USING (grid_id, ray_id) GROUP BY 1, 2")
def rays_intersect_voxels(spark, sf):
    return rays.rays_intersect_voxels(every_ray(spark, sf), emb_grid(spark, sf))


SEGS = (
    f"{HITS}, l AS (SELECT *, CASE WHEN t0 <= max(t1) OVER (PARTITION BY grid_id, ray_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM hits), "
    "g AS (SELECT *, sum(fresh) OVER (PARTITION BY grid_id, ray_id ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS s FROM l), segs AS (SELECT grid_id, ray_id, s, min(t0) AS t0, max(t1) AS t1 FROM g GROUP BY 1, 2, 3)"
)


@query(f"WITH {SEGS} SELECT grid_id, ray_id, CAST(row_number() OVER (PARTITION BY grid_id, ray_id ORDER BY t0) - 1 AS INTEGER) AS n, {settled('t0')} AS t0, {settled('t1')} AS t1 FROM segs")
def segments_along_rays(spark, sf):
    s = rays.segments_along_rays(every_ray(spark, sf), emb_grid(spark, sf))
    return s.withColumns({"t0": settle(F.col("t0")), "t1": settle(F.col("t1"))})


@query(
    f"WITH {SEGS}, c AS (SELECT *, unnest(range(CAST(ceil(t0 / 0.03::DOUBLE - 0.5) AS BIGINT), CAST(ceil(t1 / 0.03::DOUBLE - 0.5) AS BIGINT))) AS q FROM segs) SELECT grid_id, ray_id, {settled('(q * 0.03::DOUBLE + (q + 1) * 0.03::DOUBLE) / 2')} AS t FROM c"
)
def uniform_ray_samples(spark, sf):
    s = rays.uniform_ray_samples(every_ray(spark, sf), emb_grid(spark, sf), 0.03, include_end_segments=False, midpoints=True)
    return s.withColumn("t", settle(F.col("t")))


@query(
    f"WITH {SEGS}, m AS (SELECT grid_id, ray_id, s, t0 AS t FROM segs UNION SELECT grid_id, ray_id, s, t1 FROM segs UNION SELECT grid_id, ray_id, s, q * 0.03::DOUBLE FROM (SELECT *, unnest(range(CAST(ceil(t0 / 0.03::DOUBLE) AS BIGINT), CAST(floor(t1 / 0.03::DOUBLE) AS BIGINT) + 1)) AS q FROM segs) "
    "WHERE q * 0.03::DOUBLE BETWEEN t0 AND t1), p AS (SELECT grid_id, ray_id, t AS a, lead(t) OVER (PARTITION BY grid_id, ray_id, s ORDER BY t) AS b FROM m) "
    f"SELECT grid_id, ray_id, {settled('a')} AS t0, {settled('b')} AS t1 FROM p WHERE b - a > 1e-9"
)
def uniform_ray_samples_ends(spark, sf):
    s = rays.uniform_ray_samples(every_ray(spark, sf), emb_grid(spark, sf), 0.03)
    return s.withColumns({"t0": settle(F.col("t0")), "t1": settle(F.col("t1"))})


#: A step at a time: ``on`` tells whether the walk is inside segment ``n``, at time ``t`` with the next step's length.
CONE = (
    f"{SEGS}, w(grid_id, ray_id, n, t, size, \"on\", x0, x1) AS (SELECT grid_id, ray_id, 1, 0.0::DOUBLE, 0.01::DOUBLE, false, NULL::DOUBLE, NULL::DOUBLE FROM segs WHERE s = 1 UNION ALL "
    "SELECT grid_id, ray_id, CASE WHEN (\"on\" AND t + size >= b) OR (NOT \"on\" AND first > b) THEN n + 1 ELSE n END, CASE WHEN NOT \"on\" THEN first WHEN t + size < b THEN t + size ELSE t END, "
    "CASE WHEN \"on\" AND t + size < b THEN greatest((t + size) * 0.005::DOUBLE, 0.01::DOUBLE) ELSE size END, CASE WHEN \"on\" THEN t + size < b ELSE first <= b END, "
    "CASE WHEN NOT \"on\" THEN a ELSE t END, CASE WHEN NOT \"on\" THEN least(first, b) ELSE least(t + size, b) END "
    "FROM (SELECT w.*, g.t0 AS a, g.t1 AS b, w.t + ceil((g.t0 - w.t) / w.size) * w.size AS first FROM w JOIN segs g ON g.grid_id = w.grid_id AND g.ray_id = w.ray_id AND g.s = w.n))"
)


@query(f"WITH RECURSIVE {CONE} SELECT grid_id, ray_id, {settled('x0', 5)} AS t0, {settled('x1', 5)} AS t1 FROM w WHERE x1 - x0 > 1e-9")
def cone_ray_samples(spark, sf):
    s = rays.uniform_ray_samples(every_ray(spark, sf), emb_grid(spark, sf), 0.01, cone_angle=0.005)
    return s.withColumns({"t0": settle(F.col("t0"), 5), "t1": settle(F.col("t1"), 5)})


SIGNED = f"signed AS (SELECT *, {'((((i * 7 + j * 13 + k * 29) % 17) + 17) % 17) / 4.0::DOUBLE'} - 2 AS f FROM vox)"


@query(
    f"WITH {HITS}, {SIGNED}, s AS (SELECT h.*, f, lag(f) OVER w AS pf, lag(t0) OVER w AS p0, lag(t1) OVER w AS p1 FROM hits h JOIN signed USING (grid_id, i, j, k) WHERE f <> 0 WINDOW w AS (PARTITION BY grid_id, ray_id ORDER BY t0, t1)), "
    "x AS (SELECT grid_id, ray_id, t0, CASE WHEN t0 = p1 THEN f / (f - pf) * ((p0 + p1) * 0.5) + (1 - f / (f - pf)) * ((t0 + t1) * 0.5) ELSE t0 END AS t, row_number() OVER (PARTITION BY grid_id, ray_id ORDER BY t0) AS n FROM s WHERE sign(f) <> sign(pf)) "
    f"SELECT r.grid_id, r.ray_id, {settled('coalesce(x.t, -1.0::DOUBLE)')} AS t FROM rays r LEFT JOIN x ON x.grid_id = r.grid_id AND x.ray_id = r.ray_id AND x.n = 1"
)
def implicit_hit(spark, sf):
    g = emb_grid(spark, sf)
    f = feature(g.voxels).withColumn("f", F.col("f") - 2)
    return rays.ray_implicit_intersection(every_ray(spark, sf), g, f).withColumn("t", settle(F.col("t")))


SAMPLES = (
    "samples AS (SELECT l_orderkey AS ray_id, 0 AS grid_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS s, l_quantity / 20 AS sigma, 0.5::DOUBLE AS dt, CAST(l_linenumber AS DOUBLE) AS t, l_discount AS c, l_tax AS d FROM lineitem), "
    "tr AS (SELECT *, coalesce(sum(sigma * dt) OVER (PARTITION BY ray_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tau FROM samples), "
    "w AS (SELECT *, (1 - exp(-sigma * dt)) * exp(-tau) AS w FROM tr WHERE exp(-tau) > 0.0713::DOUBLE OR tau = 0)"
)


def samples(spark, sf):
    n = table(spark, sf, "lineitem")
    n = n.repartition(tasks_for(n, n.count()), "l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return n.select(
        F.lit(0).alias("grid_id"), F.col("l_orderkey").alias("ray_id"), F.row_number().over(w).alias("s"), (F.col("l_quantity") / 20).alias("sigma"), F.lit(0.5).alias("dt"),
        F.col("l_linenumber").cast("double").alias("t"), F.col("l_discount").alias("c"), F.col("l_tax").alias("d"),
    )


@query(f"WITH {SAMPLES} SELECT grid_id, ray_id, " + ", ".join(f"{settled(f'sum(w * {x})')} AS {n}" for x, n in (("c", "c"), ("d", "d"), ("t", "depth"), ("1", "opacity"))) + ", count(*) AS n_samples FROM w GROUP BY 1, 2")
def volume_render(spark, sf):
    out = rays.volume_render(samples(spark, sf), ("c", "d"), 0.0713)
    return out.withColumns({n: settle(F.col(n)) for n in ("c", "d", "depth", "opacity")})


@query(
    f"WITH {SAMPLES}, r AS (SELECT *, coalesce(sum(w * c) OVER (PARTITION BY ray_id ORDER BY s ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rest FROM w) "
    f"SELECT grid_id, ray_id, s, {settled('dt * (exp(-tau) * exp(-sigma * dt) * c - rest)')} AS g_sigma, {settled('w')} AS g_c FROM r"
)
def volume_render_adjoint(spark, sf):
    s = samples(spark, sf)
    grads = s.select("grid_id", "ray_id").distinct().withColumn("g_c", F.lit(1.0))
    out = rays.volume_render_adjoint(s, grads, ("c",), 0.0713)
    return out.withColumns({n: settle(F.col(n)) for n in ("g_sigma", "g_c")})


# -- surfaces and distances ------------------------------------------------------------------------------


#: Half the side of a ball's box.
HALF = 4
RADIUS = "1.25 + (s_suppkey % 5) * 0.5"
BALLS = (
    f"ball AS (SELECT CAST(s_suppkey AS INTEGER) AS grid_id, i, j, k, sqrt(CAST(i * i + j * j + k * k AS DOUBLE)) - ({RADIUS.replace('1.25', '1.25::DOUBLE')}) AS f FROM supplier, {box_sql(-HALF, HALF, ('i', 'j', 'k'))} b)"
)


def ball_tasks(spark, sf) -> int:
    """As many tasks as the voxels of all boxes need."""
    rows = table(spark, sf, "supplier")
    return tasks_for(rows, rows.count() * (2 * HALF + 1) ** 3)


def balls(spark, sf) -> tuple[Grids, object]:
    """A grid for each supplier: a dense box around a ball, and each voxel's distance to its surface."""
    rows = table(spark, sf, "supplier").selectExpr("cast(s_suppkey AS int) AS grid_id", f"cast({RADIUS} AS double) AS r")
    # the file of so few rows is read by one task, which would make all boxes
    rows = rows.repartition(ball_tasks(spark, sf), "grid_id")
    box = with_box(rows, (-HALF,) * 3, (HALF,) * 3, tuple(IJK))
    f = box.select(*KEY, (F.sqrt(F.expr("cast(i * i + j * j + k * k AS double)")) - F.col("r")).alias("f"))
    return shared_grids(rows, f.select(*KEY)), f


@query(f"WITH {BALLS}, s AS (SELECT unnest([[1,0,0],[0,1,0],[0,0,1]]) AS s) SELECT a.grid_id, count(*) AS n_vertices FROM ball a CROSS JOIN s JOIN ball b ON b.grid_id = a.grid_id AND b.i = a.i + s[1] AND b.j = a.j + s[2] AND b.k = a.k + s[3] WHERE (a.f < 0) <> (b.f < 0) GROUP BY 1")
def marching_cubes_vertices(spark, sf):
    g, f = balls(spark, sf)
    return mesh.marching_cubes(g, f)[0].groupBy("grid_id").agg(F.count("*").alias("n_vertices"))


@query(
    f"WITH {BALLS}, s AS (SELECT unnest([[1,0,0],[0,1,0],[0,0,1]]) AS s), n AS (SELECT grid_id, i, j, k, f, row_number() OVER (ORDER BY grid_id, i, j, k) - 1 AS n FROM ball) "
    "SELECT a.grid_id, b.n AS voxel_a, a.n AS voxel_b FROM n a CROSS JOIN s JOIN n b ON b.grid_id = a.grid_id AND b.i = a.i + s[1] AND b.j = a.j + s[2] AND b.k = a.k + s[3] WHERE (a.f < 0) <> (b.f < 0)"
)
def vertex_edge_keys(spark, sf):
    g, f = balls(spark, sf)
    return mesh.marching_cubes(g, f, edge_keys=True)[2].select("grid_id", "voxel_a", "voxel_b")


@query("SELECT CAST(s_suppkey AS INTEGER) AS grid_id, 2::BIGINT AS euler, true AS closed FROM supplier")
def marching_cubes_euler(spark, sf):
    """Vertices minus edges plus faces of a ball's surface is 2, and every edge has two faces."""
    v, f = mesh.marching_cubes(*balls(spark, sf))
    sides = [F.struct(F.least(f"v{a}", f"v{b}").alias("a"), F.greatest(f"v{a}", f"v{b}").alias("b")) for a, b in ((0, 1), (1, 2), (2, 0))]
    f = f.repartition(ball_tasks(spark, sf), "grid_id")
    e = f.select("grid_id", F.inline(F.array(*sides))).groupBy("grid_id", "a", "b").agg(F.count("*").alias("n"))
    v = v.groupBy("grid_id").agg(F.count("*").alias("v"))
    # a face has three sides
    e = e.groupBy("grid_id").agg(F.count("*").alias("e"), F.bool_and(F.col("n") == 2).alias("closed"), F.expr("sum(n) div 3").alias("f"))
    return meet(v, e, ["grid_id"]).select("grid_id", (F.col("v") - F.col("e") + F.col("f")).alias("euler"), "closed")


def cubes_sql() -> str:
    """Faces and vertices of the balls' surfaces, with the same triangles of each case."""
    triangles = ", ".join(f"({case}, {n}, {', '.join(str(x) for e in t for x in e)})" for case, ts in enumerate(mesh.case_triangles()) for n, t in enumerate(ts))
    at = lambda s, c: ", ".join(f"{a} + ({c} // {d}) % 2 AS {s}{a}" for a, d in zip(IJK, (4, 2, 1)))
    edges = " UNION ALL ".join(f"SELECT grid_id, i, j, k, t, {e} AS e, {at('p', f'a{e}')}, {at('q', f'b{e}')}, vals[a{e} + 1] AS pv, vals[b{e} + 1] AS qv FROM tri" for e in range(3))
    key = ", ".join(s + a for s in "pq" for a in IJK)
    snap = f"{mesh.SNAP!r}::DOUBLE"
    return (
        f"{BALLS}, o AS (SELECT CAST(unnest(range(8)) AS INTEGER) AS c), cu AS (SELECT grid_id, i - c // 4 AS i, j - (c // 2) % 2 AS j, k - c % 2 AS k, list(f ORDER BY c) AS vals, sum(CASE WHEN f < 0 THEN 1 << c ELSE 0 END) AS kase FROM ball, o GROUP BY 1, 2, 3, 4 HAVING count(*) = 8), "
        f"tr(kase, t, a0, b0, a1, b1, a2, b2) AS (VALUES {triangles}), tri AS (SELECT * FROM cu JOIN tr USING (kase)), e AS ({edges}), "
        f"w AS (SELECT DISTINCT grid_id, {key}, CASE WHEN abs(pv) < {snap} THEN 0 WHEN abs(qv) < {snap} THEN 1 WHEN abs(pv - qv) < {snap} THEN 0 ELSE -pv / (qv - pv) END AS w FROM e), "
        f"v AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY {key}) - 1 AS v_id FROM w), "
        f"n AS (SELECT e.grid_id, e.i, e.j, e.k, e.t, e.e, v.v_id FROM e JOIN v USING (grid_id, {key})), "
        "f AS (SELECT grid_id, i, j, k, t, " + ", ".join(f"max(CASE WHEN e = {e} THEN v_id END) AS v{e}" for e in range(3)) + " FROM n GROUP BY 1, 2, 3, 4, 5), "
        "faces AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY i, j, k, t) - 1 AS f_id FROM f)"
    )


@query(
    f"WITH {cubes_sql()} SELECT f.grid_id, f.f_id, f.v0, f.v1, f.v2, "
    + ", ".join(f"{settled(f'(v.p{i} * (1 - v.w) + v.q{i} * v.w)')} AS {a}" for a, i in zip("xyz", IJK)) + " FROM faces f JOIN v ON v.grid_id = f.grid_id AND v.v_id = f.v0"
)
def marching_cubes(spark, sf):
    """All faces, each with the place of its first vertex."""
    v, faces = mesh.marching_cubes(*balls(spark, sf))
    corner = v.select("grid_id", F.col("v_id").alias("v0"), *[settle(F.col(a)).alias(a) for a in "xyz"])
    n = ball_tasks(spark, sf)
    faces, corner = (x.repartition(n, "grid_id", "v0") for x in (faces, corner))
    return meet(faces, corner, ["grid_id", "v0"])


def depth_images(spark, sf):
    """A small depth image of exact binary fractions for each supplier, and its camera."""
    ids = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("grid_id"))
    p = ids.select("grid_id", F.explode(F.sequence(F.lit(0), F.lit(16 * 12 - 1))).alias("id")).selectExpr("grid_id", "id % 16 AS u", "id div 16 AS v")
    p = p.selectExpr("grid_id", "u", "cast(v AS int) AS v", "2.0D + ((u * 3 + v * 5 + grid_id) % 7) / 16.0D AS depth", "cast((u + v) % 3 AS double) AS weight", "cast(u AS double) AS red")
    pose = F.array(*[F.lit(float(n % 5 == 0)) for n in range(16)])
    cams = ids.selectExpr("grid_id", "16D AS fx", "16D AS fy", "8D AS cx", "6D AS cy").withColumn("pose", pose)
    return p, cams, ids


FUSED = (
    "px AS (SELECT CAST(s_suppkey AS INTEGER) AS grid_id, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, 2.0::DOUBLE + ((u * 3 + v * 5 + s_suppkey) % 7) / 16.0::DOUBLE AS depth, CAST((u + v) % 3 AS DOUBLE) AS weight FROM supplier, (SELECT unnest(range(16)) AS u), (SELECT unnest(range(12)) AS v)), "
    "p AS (SELECT grid_id, depth * (u - 8) / 16 AS x, depth * (v - 6) / 16 AS y, depth AS z FROM px), "
    f"b AS (SELECT DISTINCT grid_id, CAST(floor(x / 0.125::DOUBLE + 0.5) AS INTEGER) + di AS i, CAST(floor(y / 0.125::DOUBLE + 0.5) AS INTEGER) + dj AS j, CAST(floor(z / 0.125::DOUBLE + 0.5) AS INTEGER) + dk AS k FROM p, {box_sql(-2, 2)} o), "
    "c AS (SELECT *, i * 0.125::DOUBLE AS x, j * 0.125::DOUBLE AS y, k * 0.125::DOUBLE AS z FROM b), s AS (SELECT *, CAST(trunc((16 * x + 8 * z) / z) AS INTEGER) AS pu, CAST(trunc((16 * y + 6 * z) / z) AS INTEGER) AS pv FROM c), "
    "m AS (SELECT s.*, px.depth - s.z AS gap, px.weight, px.u AS red FROM s LEFT JOIN px ON px.grid_id = s.grid_id AND px.u = s.pu AND px.v = s.pv AND s.z > 0)"
)


@query(
    f"WITH {FUSED} "
    f"SELECT grid_id, i, j, k, {settled('CASE WHEN gap > -0.25 AND weight > 0 THEN least(1.0::DOUBLE, gap / 0.25::DOUBLE) ELSE 0 END')} AS tsdf, CAST(CASE WHEN gap > -0.25 AND weight > 0 THEN weight ELSE 0 END AS DOUBLE) AS weight FROM m"
)
def integrate_tsdf(spark, sf):
    p, cams, ids = depth_images(spark, sf)
    g = shared_grids(ids, spark.createDataFrame([], "grid_id int, i int, j int, k int"), 0.125)
    state = spark.createDataFrame([], "grid_id int, i int, j int, k int, tsdf double, weight double")
    out = tsdf.integrate_tsdf(g, state, p.drop("red"), cams, (16, 12), 0.25)[1]
    return out.withColumn("tsdf", settle(F.col("tsdf")))


@query(
    f"WITH {FUSED} SELECT grid_id, i, j, k, {settled('CASE WHEN gap > -0.25 AND weight > 0 THEN least(1.0::DOUBLE, gap / 0.25::DOUBLE) ELSE 0 END')} AS tsdf, "
    f"CAST(CASE WHEN gap > -0.25 AND weight > 0 THEN 2 * weight ELSE 0 END AS DOUBLE) AS weight, CAST(CASE WHEN gap > -0.25 AND weight > 0 THEN red ELSE 0 END AS DOUBLE) AS red FROM m"
)
def integrate_tsdf_with_features(spark, sf):
    """The same images twice: values stay, weights double."""
    p, cams, ids = depth_images(spark, sf)
    g = shared_grids(ids, spark.createDataFrame([], "grid_id int, i int, j int, k int"), 0.125)
    state = spark.createDataFrame([], "grid_id int, i int, j int, k int, tsdf double, weight double, red double")
    g, state = tsdf.integrate_tsdf(g, state, p, cams, (16, 12), 0.25, ("red",))
    out = tsdf.integrate_tsdf(g, state, p, cams, (16, 12), 0.25, ("red",))[1]
    return _rounded(out, "tsdf", "red", digits=6)


class Sweeps:
    """SQL of redistancing on dense boxes, stage by stage: a voxel's neighbours are the rows before and after it."""

    def __init__(self, first: str, band: int = 3):
        self.band, self.parts, self.n = float(band), [f"s0 AS MATERIALIZED ({first})"], 0

    def stage(self, columns: str) -> None:
        """A stage over the last one; ``columns`` may use ``phi``, ``sgn`` and the neighbours ``l0, h0`` to ``l2, h2`` of ``x``."""
        near = []
        for n, a in enumerate(IJK):
            others = ", ".join(c for c in IJK if c != a)
            for side, f in (("l", "lag"), ("h", "lead")):
                near.append(f"{f}(x, 1, {self.band}::DOUBLE) OVER (PARTITION BY grid_id, {others} ORDER BY {a}) AS {side}{n}")
        self.parts.append(f"n{self.n + 1} AS (SELECT *, {', '.join(near)} FROM s{self.n})")
        self.n += 1
        self.parts.append(f"s{self.n} AS MATERIALIZED (SELECT {', '.join(KEY)}, {columns} FROM n{self.n})")

    def sign(self) -> None:
        grad = " + ".join(f"power((h{n} - l{n}) / 2, 2)" for n in range(3))
        self.stage(f"phi, phi / sqrt(phi * phi + ({grad}) + {sdf.ROOT!r}::DOUBLE) AS sgn, phi AS x, phi AS y")

    def sweep(self, order: int) -> None:
        """One step; ``x`` is the stage's field and ``y`` the one before."""
        up = " + ".join(f"power(greatest(greatest(x - l{n}, 0), -least(h{n} - x, 0)), 2)" for n in range(3))
        down = " + ".join(f"power(greatest(-least(x - l{n}, 0), greatest(h{n} - x, 0)), 2)" for n in range(3))
        rate = f"{sdf.STEP!r}::DOUBLE * sgn * (1 - sqrt(CASE WHEN sgn > 0 THEN {up} ELSE {down} END))"
        hold = lambda e: f"greatest(-{self.band}::DOUBLE, least({self.band}::DOUBLE, {e}))"
        if order == 2:  # y keeps half of the first rate
            self.stage(f"phi, sgn, {hold(f'x + {rate}')} AS x, phi + 0.5 * {rate} AS y")
            last = hold(f"y + 0.5 * {rate}")
        else:
            self.stage(f"phi, sgn, {hold(f'x + {rate}')} AS x, phi AS y")
            self.stage(f"phi, sgn, {hold(f'0.75 * phi + 0.25 * x + 0.25 * {rate}')} AS x, phi AS y")
            last = hold(f"phi / 3 + 2.0::DOUBLE / 3 * x + 2.0::DOUBLE / 3 * {rate}")
        self.stage(f"{last} AS phi, sgn, {last} AS x, {last} AS y")

    def average(self, share: float) -> None:
        mean = "(" + " + ".join(f"l{n} + h{n}" for n in range(3)) + ") / 6"
        new = f"x + {share!r}::DOUBLE * ({mean} - x)"
        self.stage(f"{new} AS phi, sgn, {new} AS x, {new} AS y")

    def redistance(self, order: int, sweeps: int) -> None:
        self.sign()
        for _ in range(sweeps):
            self.sweep(order)


def reinitialized_sql() -> str:
    s = Sweeps(f"WITH {BALLS} SELECT grid_id, i, j, k, greatest(-3.0::DOUBLE, least(3.0::DOUBLE, 2 * f)) AS phi, 0.0::DOUBLE AS sgn, greatest(-3.0::DOUBLE, least(3.0::DOUBLE, 2 * f)) AS x, 0.0::DOUBLE AS y FROM ball")
    s.redistance(3, 10)
    return f"WITH {', '.join(s.parts)} SELECT grid_id, i, j, k, {settled('phi', 5)} AS f FROM s{s.n}"


@query(reinitialized_sql())
def reinitialize_sdf(spark, sf):
    g, f = balls(spark, sf)
    return sdf.reinitialize_sdf(g, f.withColumn("f", F.col("f") * 2)).withColumn("f", settle(F.col("f"), 5))


def retopologized_sql() -> str:
    wide = f"(SELECT CAST(s_suppkey AS INTEGER) AS grid_id, i, j, k FROM supplier, {box_sql(-HALF - 3, HALF + 3, ('i', 'j', 'k'))} b)"
    held = "greatest(-3.0::DOUBLE, least(3.0::DOUBLE, coalesce(f, 3.0::DOUBLE)))"
    s = Sweeps(f"WITH {BALLS} SELECT w.grid_id, w.i, w.j, w.k, {held} AS phi, 0.0::DOUBLE AS sgn, {held} AS x, 0.0::DOUBLE AS y FROM {wide} w LEFT JOIN ball USING (grid_id, i, j, k)")
    s.redistance(2, 10)
    for share in sdf.TAUBIN:
        s.average(share)
    s.redistance(2, 4)
    return f"WITH {', '.join(s.parts)} SELECT grid_id, i, j, k, {settled('phi', 5)} AS f FROM s{s.n} WHERE abs(phi) < 3 * {sdf.KEPT!r}::DOUBLE"


@query(retopologized_sql())
def retopologize_sdf(spark, sf):
    g, f = balls(spark, sf)
    return sdf.retopologize_sdf(g, f, smooth=1, taubin=True, order=2)[1].withColumn("f", settle(F.col("f"), 5))


# -- splats ---------------------------------------------------------------------------------------------------

SIZE = (64, 48)


def gaussians(spark, sf):
    """Gaussians in front of a camera, one from each vector."""
    e = table(spark, sf, "embeddings")
    x = lambda i: F.col("embedding")[i].cast("double")
    return e.select(
        F.col("vec_id").alias("id"), F.array(x(0) * 3, x(1) * 3, x(2) + 2.5).alias("mean"), F.array(x(3) + 1, x(4), x(5), x(6)).alias("quat"),
        F.array(x(7) - 2, x(8) - 2, x(9) - 2).alias("log_scale"), (x(10) * 4).alias("logit_opacity"), (0.5 + x(10)).alias("opacity"), x(11).alias("red"), (F.col("vec_id") % 5 + 1).cast("int").alias("ratio"),
    )


CAMS = {0: ([[50.0, 0, 32], [0, 50, 24], [0, 0, 1]], [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]), 1: ([[40.0, 0, 32], [0, 40, 24], [0, 0, 1]], [[0.8, 0, 0.6, 0], [0, 1, 0, 0], [-0.6, 0, 0.8, 0.5], [0, 0, 0, 1]])}


def _rounded(df, *names, digits=5):
    return df.withColumns({n: settle(F.col(n), digits) for n in names})


def gauss_sql() -> str:
    """The Gaussians and the parts of their rotation times scale, step by step."""
    x = lambda n: f"CAST(embedding[{n + 1}] AS DOUBLE)"
    rot = splats.rotation("q0", "q1", "q2", "q3")
    cells = ", ".join(f"({rot[r][c]}) * e{c} AS s{r}{c}" for r in range(3) for c in range(3))
    return (
        f"ga AS (SELECT vec_id AS id, {x(0)} * 3 AS m0, {x(1)} * 3 AS m1, {x(2)} + 2.5 AS m2, {x(3)} + 1 AS w0, {x(4)} AS w1, {x(5)} AS w2, {x(6)} AS w3, {x(7)} - 2 AS l0, {x(8)} - 2 AS l1, {x(9)} - 2 AS l2, "
        f"{x(10)} * 4 AS logit, 0.5 + {x(10)} AS opacity, {x(11)} AS red, vec_id % 5 + 1 AS ratio FROM embeddings), "
        "gb AS (SELECT *, sqrt(w0 * w0 + w1 * w1 + w2 * w2 + w3 * w3) AS wn, exp(l0) AS e0, exp(l1) AS e1, exp(l2) AS e2 FROM ga), gc AS (SELECT *, w0 / wn AS q0, w1 / wn AS q1, w2 / wn AS q2, w3 / wn AS q3 FROM gb), "
        f"gd AS (SELECT *, {cells} FROM gc)"
    )


def cams_sql() -> str:
    rows = []
    for c, (k, view) in CAMS.items():
        flat = [float(v) for row in view[:3] for v in row]
        rows.append(f"({c}, " + ", ".join(f"{float(v)!r}::DOUBLE" for v in (k[0][0], k[1][1], k[0][2], k[1][2], *flat)) + ")")
    names = ", ".join(f"v{r}{c}" for r in range(3) for c in range(4))
    return f"cams(cam, fx, fy, cx, cy, {names}) AS (VALUES {', '.join(rows)})"


def projected_sql(flat: bool = False, pairs: str = "gd, cams") -> str:
    """Footprints step by step; ``flat`` cameras are orthographic, ``pairs`` joins Gaussians and cameras."""
    if flat:
        jac = "l AS (SELECT * FROM t WHERE t2 BETWEEN 0.01 AND 1e10), j AS (SELECT *, fx AS a0, 0.0::DOUBLE AS a2, fy AS b1, 0.0::DOUBLE AS b2, fx * t0 + cx AS mx, fy * t1 + cy AS my FROM l), "
    else:
        jac = (
            "l AS (SELECT *, t2 * least((64 - cx) / fx + 0.15 * 64 / fx, greatest(-(cx / fx + 0.15 * 64 / fx), t0 / t2)) AS c0, t2 * least((48 - cy) / fy + 0.15 * 48 / fy, greatest(-(cy / fy + 0.15 * 48 / fy), t1 / t2)) AS c1 FROM t WHERE t2 BETWEEN 0.01 AND 1e10), "
            "j AS (SELECT *, fx / t2 AS a0, -fx * c0 / (t2 * t2) AS a2, fy / t2 AS b1, -fy * c1 / (t2 * t2) AS b2, fx * t0 / t2 + cx AS mx, fy * t1 / t2 + cy AS my FROM l), "
        )
    return (
        f"{gauss_sql()}, {cams_sql()}, t AS (SELECT *, " + ", ".join(f"v{r}0 * m0 + v{r}1 * m1 + v{r}2 * m2 + v{r}3 AS t{r}" for r in range(3)) + f" FROM {pairs}), {jac}"
        "v AS (SELECT *, " + ", ".join(f"a0 * v0{c} + a2 * v2{c} AS x{c}, b1 * v1{c} + b2 * v2{c} AS y{c}" for c in range(3)) + " FROM j), "
        "u AS (SELECT *, " + ", ".join(f"x0 * s0{c} + x1 * s1{c} + x2 * s2{c} AS g{c}, y0 * s0{c} + y1 * s1{c} + y2 * s2{c} AS h{c}" for c in range(3)) + " FROM v), "
        "k AS (SELECT *, g0 * g0 + g1 * g1 + g2 * g2 AS p0, g0 * h0 + g1 * h1 + g2 * h2 AS q, h0 * h0 + h1 * h1 + h2 * h2 AS r0 FROM u), "
        "d AS (SELECT *, p0 + 0.3 AS p, r0 + 0.3 AS r, (p0 + 0.3) * (r0 + 0.3) - q * q AS det, CAST(ceil(3.33 * sqrt(p0 + 0.3)) AS INTEGER) AS radius_x, CAST(ceil(3.33 * sqrt(r0 + 0.3)) AS INTEGER) AS radius_y FROM k), "
        "shown AS (SELECT * FROM d WHERE det > 0 AND mx + radius_x > 0 AND mx - radius_x < 64 AND my + radius_y > 0 AND my - radius_y < 48)"
    )


PROJECTED = projected_sql()
FOOT_COLUMNS = {"mx": "mx", "my": "my", "depth": "t2", "ca": "r / det", "cb": "-q / det", "cc": "p / det", "compensation": "sqrt(greatest(0.0::DOUBLE, (p0 * r0 - q * q) / det))"}


@query(
    f"WITH {PROJECTED} SELECT id, cam, radius_x, radius_y, "
    + ", ".join(f"{settled(f'({e})', 5)} AS {n}" for n, e in {**FOOT_COLUMNS, "opacity": "opacity", "logit_opacity": "logit"}.items())
    + " FROM shown"
)
def project_gaussians(spark, sf):
    return _rounded(splats.project(gaussians(spark, sf).drop("ratio", "red"), CAMS, SIZE), "mx", "my", "depth", "ca", "cb", "cc", "compensation", "opacity", "logit_opacity")


#: Lens coefficients of the query of distorted cameras.
LENS = {0: [0.1, -0.02, 0.003, 0.05, 0.01, 0.002, 0.004, -0.003, 0.002, 0.001, -0.001, 0.002], 1: [-0.05, 0.01, 0.0, 0.02, 0.0, 0.0, -0.002, 0.001, 0.0, 0.0, 0.001, 0.0]}


def lens_sql() -> str:
    """The thin-prism model with a fractional radial part, from normalised x, y to u, v."""
    rows = ", ".join(f"({c}, {', '.join(f'{k!r}::DOUBLE' for k in ks)})" for c, ks in LENS.items())
    return (
        f"lens(lc, k1, k2, k3, k4, k5, k6, p1, p2, s1, s2, s3, s4) AS (VALUES {rows}), n AS (SELECT *, CASE WHEN t2 > 1e-6 THEN t0 / t2 END AS nx, CASE WHEN t2 > 1e-6 THEN t1 / t2 END AS ny FROM t JOIN lens ON lc = cam), "
        "rr AS (SELECT *, nx * nx + ny * ny AS r2 FROM n), ra AS (SELECT *, (1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2) / (1 + k4 * r2 + k5 * r2 * r2 + k6 * r2 * r2 * r2) AS g FROM rr), "
        "w AS (SELECT *, fx * (nx * g + 2 * p1 * nx * ny + p2 * (r2 + 2 * nx * nx) + s1 * r2 + s2 * r2 * r2) + cx AS u, fy * (ny * g + p1 * (r2 + 2 * ny * ny) + 2 * p2 * nx * ny + s3 * r2 + s4 * r2 * r2) + cy AS v FROM ra), "
    )


def sigma_sql() -> str:
    """The seven sigma points of each Gaussian: x, y, z and the weights of mean and covariance."""
    lam = 0.01 * 3 - 3
    spread, points = math.sqrt(3 + lam), []
    for axis, sign in [(None, 0), *[(n, w) for n in range(3) for w in (1, -1)]]:
        at = [f"m{r}" + (f" + {sign * spread!r}::DOUBLE * s{r}{axis}" if sign else "") for r in range(3)]
        wm = lam / (3 + lam) if not sign else 0.5 / (3 + lam)
        wc = wm + (1 - 0.01 + 2.0 if not sign else 0.0)
        points.append(f"SELECT id, {', '.join(f'{e} AS {c}' for e, c in zip(at, 'xyz'))}, {wm!r}::DOUBLE AS wm, {wc!r}::DOUBLE AS wc FROM gd")
    return f"sigma AS ({' UNION ALL '.join(points)})"


def unscented_sql(pixels: str) -> str:
    return (
        f"WITH {gauss_sql()}, {cams_sql()}, {sigma_sql()}, t AS (SELECT *, " + ", ".join(f"v{r}0 * x + v{r}1 * y + v{r}2 * z + v{r}3 AS t{r}" for r in range(3)) + f" FROM sigma, cams), {pixels}"
        "m AS (SELECT id, cam, bool_and(coalesce(u >= -6.4 AND u < 64 * 1.1 AND v >= -4.8 AND v < 48 * 1.1, false)) AS ok, sum(wm * u) AS mx, sum(wm * v) AS my, sum(wm * t2) AS depth, sum(wc) AS sc, sum(wc * u) AS su, sum(wc * v) AS sv, "
        "sum(wc * u * u) AS uu, sum(wc * u * v) AS uv, sum(wc * v * v) AS vv FROM w GROUP BY 1, 2), "
        "c AS (SELECT *, uu - 2 * mx * su + sc * mx * mx + 0.3 AS p, uv - mx * sv - my * su + sc * mx * my AS q, vv - 2 * my * sv + sc * my * my + 0.3 AS r FROM m WHERE ok AND depth BETWEEN 0.01 AND 1e10), d AS (SELECT *, p * r - q * q AS det FROM c) "
        "SELECT id, cam, CAST(ceil(3.33 * sqrt(p)) AS INTEGER) AS radius_x, CAST(ceil(3.33 * sqrt(r)) AS INTEGER) AS radius_y, "
        + ", ".join(f"{settled(f'({e})', 3)} AS {n}" for n, e in {"mx": "mx", "my": "my", "depth": "depth", "ca": "r / det", "cb": "-q / det", "cc": "p / det"}.items()) + " FROM d WHERE det > 0"
    )


@query(unscented_sql("w AS (SELECT *, CASE WHEN t2 > 1e-6 THEN fx * t0 / t2 + cx END AS u, CASE WHEN t2 > 1e-6 THEN fy * t1 / t2 + cy END AS v FROM t), "))
def project_gaussians_unscented(spark, sf):
    return _rounded(splats.project_unscented(gaussians(spark, sf).select("id", "mean", "quat", "log_scale"), CAMS, SIZE), "mx", "my", "depth", "ca", "cb", "cc", digits=3)


@query(unscented_sql(lens_sql()))
def project_gaussians_through_lens(spark, sf):
    """Cameras with twelve lens coefficients each."""
    out = splats.project_unscented(gaussians(spark, sf).select("id", "mean", "quat", "log_scale"), CAMS, SIZE, model="thin_prism_12", distortion=LENS)
    return _rounded(out, "mx", "my", "depth", "ca", "cb", "cc", digits=3)


@query()
def project_gaussians_rolling(spark, sf):
    """Cameras that move to each other's place while rows are read."""
    ends = {c: CAMS[1 - c][1] for c in CAMS}
    out = splats.project_unscented(gaussians(spark, sf).select("id", "mean", "quat", "log_scale"), CAMS, SIZE, shutter="vertical", last_views=ends)
    return _rounded(out, "mx", "my", "depth", digits=3).select("id", "cam", "mx", "my", "depth")


#: Footprints with exact values, for what comes after projection: SQL makes the same ones.
FOOT = (
    "foot AS (SELECT 0 AS cam, vec_id AS id, CAST(vec_id * 7 % 64 AS DOUBLE) AS mx, CAST(vec_id * 11 % 48 AS DOUBLE) AS my, CAST(vec_id * 13 % 101 AS DOUBLE) AS depth, 0.125::DOUBLE AS ca, 0.0::DOUBLE AS cb, 0.0625::DOUBLE AS cc, CAST(3 + vec_id % 6 AS INTEGER) AS radius_x, "
    "CAST(4 + vec_id % 5 AS INTEGER) AS radius_y, 0.25::DOUBLE + (vec_id % 4) / 8.0::DOUBLE AS opacity, CAST(vec_id % 3 AS DOUBLE) AS red FROM embeddings)"
)


def footprints(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.selectExpr(
        "0 AS cam", "vec_id AS id", "cast(vec_id * 7 % 64 AS double) AS mx", "cast(vec_id * 11 % 48 AS double) AS my", "cast(vec_id * 13 % 101 AS double) AS depth", "0.125D AS ca", "0.0D AS cb", "0.0625D AS cc",
        "cast(3 + vec_id % 6 AS int) AS radius_x", "cast(4 + vec_id % 5 AS int) AS radius_y", "0.25D + (vec_id % 4) / 8.0D AS opacity", "cast(vec_id % 3 AS double) AS red",
    )


def world_sql() -> str:
    """Blending by rays from the origin: footprints say which tiles a Gaussian may touch."""
    span = ", ".join(
        f"CAST(greatest(0, least({n}, floor((m{a} - radius_{a}) / 16))) AS INTEGER) AS lo_{a}, CAST(greatest(0, least({n}, ceil((m{a} + radius_{a}) / 16))) AS INTEGER) AS hi_{a}" for a, n in (("x", 4), ("y", 3))
    )
    ball = ", ".join(f"-(s0{c} * m0 + s1{c} * m1 + s2{c} * m2) / n{c} AS o{c}, (s0{c} * dx + s1{c} * dy + s2{c} * dz) / n{c} AS d{c}" for c in range(3))
    length = ", ".join(f"s0{c} * s0{c} + s1{c} * s1{c} + s2{c} * s2{c} AS n{c}" for c in range(3))
    return (
        f"{PROJECTED}, span AS (SELECT *, {length}, {span} FROM shown WHERE cam = 0), tx AS (SELECT *, CAST(unnest(range(lo_x, hi_x)) AS INTEGER) AS tile_x FROM span), ty AS (SELECT *, CAST(unnest(range(lo_y, hi_y)) AS INTEGER) AS tile_y FROM tx), "
        "px AS (SELECT CAST(pu AS INTEGER) AS pu, CAST(pv AS INTEGER) AS pv, (pu + 0.5::DOUBLE - 32) / 50 AS dx, (pv + 0.5::DOUBLE - 24) / 50 AS dy, 1.0::DOUBLE AS dz FROM (SELECT unnest(range(64)) AS pu), (SELECT unnest(range(48)) AS pv)), "
        f"b AS (SELECT pu, pv, id, t2 AS depth, opacity, red, {ball} FROM ty JOIN px ON px.pu // 16 = tile_x AND px.pv // 16 = tile_y), "
        "f AS (SELECT *, o0 * o0 + o1 * o1 + o2 * o2 AS oo, o0 * d0 + o1 * d1 + o2 * d2 AS od, d0 * d0 + d1 * d1 + d2 * d2 AS dd FROM b), "
        "al AS (SELECT *, least(0.99::DOUBLE, opacity * exp(-0.5 * greatest(0.0::DOUBLE, oo - od * od / dd))) AS alpha FROM f), "
        "ac AS (SELECT *, sum(ln(1 - alpha)) OVER (PARTITION BY pu, pv ORDER BY depth, id ROWS UNBOUNDED PRECEDING) AS a FROM al WHERE alpha >= 1 / 255.0::DOUBLE), "
        "w AS (SELECT *, alpha * exp(a - ln(1 - alpha)) AS w FROM ac WHERE exp(a) > 1e-4), s AS (SELECT pu, pv, sum(w * red) AS red, sum(w) AS o FROM w GROUP BY 1, 2)"
    )


TILES = (
    "span AS (SELECT *, " + ", ".join(
        f"CAST(greatest(0, least({n}, floor((m{a} - radius_{a}) / 16))) AS INTEGER) AS lo_{a}, CAST(greatest(0, least({n}, ceil((m{a} + radius_{a}) / 16))) AS INTEGER) AS hi_{a}" for a, n in (("x", 4), ("y", 3))
    )
    + " FROM foot), tx AS (SELECT *, CAST(unnest(range(lo_x, hi_x)) AS INTEGER) AS tile_x FROM span), tiles AS (SELECT *, CAST(unnest(range(lo_y, hi_y)) AS INTEGER) AS tile_y FROM tx)"
)


@query(f"WITH {FOOT}, {TILES} SELECT cam, id, tile_x, tile_y, depth FROM tiles")
def intersect_gaussian_tiles(spark, sf):
    return splats.intersect_tiles(footprints(spark, sf), SIZE).select("cam", "id", "tile_x", "tile_y", "depth")


@query("SELECT 0 AS cam, CAST(x AS INTEGER) AS tile_x, CAST(y AS INTEGER) AS tile_y, 256::BIGINT AS n_pixels FROM (SELECT unnest(range(4)) AS x), (SELECT unnest(range(3)) AS y)")
def gaussian_tile_layout(spark, sf):
    return splats.tile_layout(splats.all_pixels(spark, [0], SIZE))


BLEND = (
    f"{FOOT}, {TILES}, px AS (SELECT 0 AS cam, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v FROM (SELECT unnest(range(64)) AS u), (SELECT unnest(range(48)) AS v)), "
    "al AS (SELECT t.*, u, v, least(0.99::DOUBLE, opacity * exp(-(0.5 * (ca * (mx - u - 0.5) * (mx - u - 0.5) + cc * (my - v - 0.5) * (my - v - 0.5)) + cb * (mx - u - 0.5) * (my - v - 0.5)))) AS alpha FROM tiles t JOIN px ON px.u // 16 = t.tile_x AND px.v // 16 = t.tile_y), "
    "ac AS (SELECT *, sum(ln(1 - alpha)) OVER w AS a, CAST(row_number() OVER w - 1 AS INTEGER) AS rank FROM al WHERE alpha >= 1 / 255.0::DOUBLE WINDOW w AS (PARTITION BY u, v ORDER BY depth, id ROWS UNBOUNDED PRECEDING)), "
    "bl AS (SELECT *, alpha * exp(a - ln(1 - alpha)) AS weight FROM ac WHERE exp(a) > 1e-4)"
)


@query(
    f"WITH {BLEND}, s AS (SELECT u, v, sum(weight * red) AS red, sum(weight) AS o, count(*) AS n, arg_max(id, rank) AS last_id FROM bl GROUP BY 1, 2) SELECT p.cam, p.u, p.v, {settled('coalesce(s.red, 0) + (1 - coalesce(s.o, 0)) * 0.5', 5)} AS red, "
    f"{settled('coalesce(s.o, 0)', 5)} AS opacity, s.last_id, coalesce(s.n, 0) AS n_blended FROM px p LEFT JOIN s USING (u, v)"
)
def rasterize(spark, sf):
    out = splats.rasterize(footprints(spark, sf), splats.all_pixels(spark, [0], SIZE), SIZE, ("red",), background=(0.5,))
    return _rounded(out, "red", "opacity")


@query(
    f"WITH {BLEND}, s AS (SELECT u, v, sum(weight * red) AS red, sum(weight) AS o FROM bl GROUP BY 1, 2) SELECT p.cam, p.u, p.v, {settled('coalesce(s.red, 0)', 5)} AS red, {settled('coalesce(s.o, 0)', 5)} AS opacity "
    "FROM px p LEFT JOIN s USING (u, v) WHERE (p.u * 5 + p.v * 3) % 7 = 0"
)
def rasterize_sparse(spark, sf):
    """Blending at requested pixels alone."""
    px = splats.all_pixels(spark, [0], SIZE).where("(u * 5 + v * 3) % 7 = 0")
    return _rounded(splats.rasterize(footprints(spark, sf), px, SIZE, ("red",)), "red", "opacity").select("cam", "u", "v", "red", "opacity")


def pixel_gradients(spark):
    return splats.all_pixels(spark, [0], SIZE).selectExpr("cam", "u", "v", "(u % 5 - 2) / 4.0D AS g_red", "(v % 3) / 2.0D AS g_opacity")


GRAD = (
    f"{BLEND}, gr AS (SELECT bl.*, (u % 5 - 2) / 4.0::DOUBLE AS g, (v % 3) / 2.0::DOUBLE - 0.5::DOUBLE * (u % 5 - 2) / 4.0::DOUBLE AS go, mx - u - 0.5 AS dx, my - v - 0.5 AS dy FROM bl), "
    "sg AS (SELECT *, red * g + go AS s FROM gr), "
    "ga AS (SELECT *, CASE WHEN alpha < 0.99 THEN weight / alpha * s - coalesce(sum(weight * s) OVER (PARTITION BY u, v ORDER BY depth, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) / (1 - alpha) ELSE 0 END AS f FROM sg)"
)


@query(
    f"WITH {GRAD} SELECT cam, id, "
    + ", ".join(f"{settled(f'sum({e})', 5)} AS {n}" for n, e in {"g_mx": "-f * alpha * (ca * dx + cb * dy)", "g_my": "-f * alpha * (cc * dy + cb * dx)", "g_ca": "-f * alpha * 0.5 * dx * dx", "g_cb": "-f * alpha * dx * dy", "g_cc": "-f * alpha * 0.5 * dy * dy", "g_opacity": "f * alpha / opacity", "g_red": "weight * g"}.items())
    + " FROM ga GROUP BY 1, 2"
)
def rasterize_backward(spark, sf):
    out = splat_grads.rasterize_backward(footprints(spark, sf), splats.all_pixels(spark, [0], SIZE), pixel_gradients(spark), SIZE, ("red",), background=(0.5,))
    return _rounded(out, "g_mx", "g_my", "g_ca", "g_cb", "g_cc", "g_opacity", "g_red")


@query()
def project_gaussians_backward(spark, sf):
    """From gradients of all parts of the footprints, whole multiples of 1/4."""
    g = gaussians(spark, sf).select("id", "mean", "quat", "log_scale")
    foot = splats.project(g.select("id", "mean", "quat", "log_scale"), CAMS, SIZE)
    grads = foot.selectExpr("cam", "id", *[f"(id % {n + 3} - 1) / 4.0D AS g_{c}" for n, c in enumerate(splat_grads.FOOT)])
    out = splat_grads.project_backward(g, grads, CAMS, SIZE)
    flat = [settle(F.col(c)[n], 4).alias(f"{c}_{n}") for c, w in (("g_mean", 3), ("g_quat", 4), ("g_log_scale", 3)) for n in range(w)]
    return out.select("id", *flat)


@query(f"WITH {BLEND} SELECT p.cam, p.u, p.v, count(b.id) AS n, {settled('coalesce(sum(b.weight), 0)', 5)} AS opacity FROM px p LEFT JOIN bl b USING (u, v) GROUP BY 1, 2, 3")
def count_contributing_gaussians(spark, sf):
    return _rounded(splats.count_contributing(footprints(spark, sf), splats.all_pixels(spark, [0], SIZE), SIZE), "opacity")


@query(f"WITH {BLEND} SELECT cam, u, v, rank, id, {settled('weight', 5)} AS weight FROM bl")
def contributing_gaussian_ids(spark, sf):
    return _rounded(splats.contributing_ids(footprints(spark, sf), splats.all_pixels(spark, [0], SIZE), SIZE), "weight")


@query(f"WITH {BLEND}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY u, v ORDER BY weight DESC, depth, id) AS INTEGER) AS n FROM bl) SELECT cam, u, v, n, {settled('weight', 5)} AS weight FROM r WHERE n <= 3")
def topk_contributors(spark, sf):
    return _rounded(splats.top_contributors(footprints(spark, sf), splats.all_pixels(spark, [0], SIZE), SIZE, 3), "weight").drop("id")


SH_NORM = {0: "0.5 * sqrt(1 / pi())", 1: "sqrt(3 / (4 * pi()))"}


@query(
    "WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), u AS (SELECT vec_id, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM e) "
    f"SELECT vec_id, {settled('0.5 + ' + SH_NORM[0] + ' + ' + SH_NORM[1] + ' * (-y * 2 + z * 3 - x * 4) + 5 * 0.5 * sqrt(15 / pi()) * x * y - 6 * 0.5 * sqrt(15 / pi()) * y * z + 7 * 0.25 * sqrt(5 / pi()) * (3 * z * z - 1) - 8 * 0.5 * sqrt(15 / pi()) * x * z + 9 * 0.25 * sqrt(15 / pi()) * (x * x - y * y)', 5)} AS c FROM u"
)
def spherical_harmonics(spark, sf):
    e = table(spark, sf, "embeddings")
    e = e.select("vec_id", *[F.col("embedding")[n].cast("double").alias("v" + a) for n, a in enumerate("xyz")], F.array(F.array(*[F.lit(float(n)) for n in range(1, 10)])).alias("sh"))
    return splats.evaluate_harmonics(e, 2).select("vec_id", settle(F.col("color")[0], 5).alias("c"))


@query(
    "WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), r AS (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM e), "
    "u AS (SELECT vec_id, r, x / r AS x, y / r AS y, z / r AS z, sqrt(3 / (4 * pi())) AS n, vec_id % 4 - 1.5 AS g FROM r), "
    "d AS (SELECT *, -n * 4 * g AS dx, -n * 2 * g AS dy, n * 3 * g AS dz FROM u) "
    f"SELECT vec_id, {settled('-n * y * g', 5)} AS g1, {settled('n * z * g', 5)} AS g2, {settled('-n * x * g', 5)} AS g3, "
    + ", ".join(f"{settled(f'(d{a} - (dx * x + dy * y + dz * z) * {a}) / r', 4)} AS g_v{a}" for a in "xyz") + " FROM d"
)
def spherical_harmonics_backward(spark, sf):
    e = table(spark, sf, "embeddings")
    e = e.select("vec_id", *[F.col("embedding")[n].cast("double").alias("v" + a) for n, a in enumerate("xyz")], F.array(F.array(*[F.lit(float(n)) for n in range(1, 5)])).alias("sh"), F.array(F.expr("vec_id % 4 - 1.5D")).alias("g_color"))
    out = splat_grads.harmonics_backward(e, 1)
    return out.select("vec_id", *[settle(F.col("g_sh")[0][n], 5).alias(f"g{n}") for n in (1, 2, 3)], *[settle(F.col(f"g_v{a}"), 4).alias(f"g_v{a}") for a in "xyz"])


@query("SELECT vec_id AS id, vec_id % 10 <> 3 AS finite FROM embeddings")
def gaussian_nan_mask(spark, sf):
    g = gaussians(spark, sf).withColumn("logit_opacity", F.when(F.col("id") % 10 == 3, F.lit(float("nan"))).otherwise(F.col("logit_opacity")))
    return splats.finite_mask(g)


@query(
    f"WITH {projected_sql(True, 'gd JOIN cams ON cams.cam = gd.id % 2')} SELECT id, CAST(id % 2 AS INTEGER) AS scene, cam, radius_x, radius_y, "
    + ", ".join(f"{settled(f'({e})', 5)} AS {n}" for n, e in FOOT_COLUMNS.items()) + " FROM shown"
)
def project_gaussians_by_scene(spark, sf):
    """Each camera sees the Gaussians of its own scene."""
    g = gaussians(spark, sf).select("id", "mean", "quat", "log_scale", (F.col("id") % 2).cast("int").alias("scene"))
    return _rounded(splats.project(g, CAMS, SIZE, scene="scene", orthographic=True), "mx", "my", "depth", "ca", "cb", "cc", "compensation")


@query(
    f"WITH {gauss_sql()}, o AS (SELECT *, 1 / (1 + exp(-logit)) AS o FROM gd), n AS (SELECT *, greatest(0.005::DOUBLE, least(1 - 2.220446049250313e-16::DOUBLE, 1 - pow(1 - o, 1.0::DOUBLE / ratio))) AS p FROM o), "
    "i AS (SELECT *, unnest(range(1, ratio + 1)) AS i FROM n), k AS (SELECT *, unnest(range(i)) AS k FROM i), "
    "c AS (SELECT id, sum(CAST(factorial(CAST(i - 1 AS INTEGER)) / (factorial(CAST(k AS INTEGER)) * factorial(CAST(i - 1 - k AS INTEGER))) AS DOUBLE) * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * pow(p, k + 1) / sqrt(k + 1)) AS total FROM k GROUP BY 1) "
    f"SELECT n.id, {settled('ln(p / (1 - p))', 5)} AS logit_opacity, {settled('ln(o / total) + l0', 5)} AS s0 FROM n JOIN c USING (id)"
)
def relocate_gaussians(spark, sf):
    out = splats.relocate(gaussians(spark, sf))
    return out.select("id", settle(F.col("logit_opacity"), 5).alias("logit_opacity"), settle(F.col("log_scale")[0], 5).alias("s0"))


@query(
    f"WITH {gauss_sql()}, f AS (SELECT *, 10.0 / (1 + exp(100 * (1 / (1 + exp(-logit)) - 0.005))) AS f FROM gd), z AS (SELECT *, s00 - s10 + 0.5 * s20 AS z0, s01 - s11 + 0.5 * s21 AS z1, s02 - s12 + 0.5 * s22 AS z2 FROM f) "
    "SELECT id, " + ", ".join(f"{settled(f'(m{r} + f * (s{r}0 * z0 + s{r}1 * z1 + s{r}2 * z2))', 5)} AS {a}" for r, a in enumerate("xyz")) + " FROM z"
)
def noisy_gaussian_means(spark, sf):
    g = gaussians(spark, sf).withColumn("noise", F.array(F.lit(1.0), F.lit(-1.0), F.lit(0.5)))
    out = splats.add_noise(g, 10.0, noise="noise")
    return out.select("id", *[settle(F.col("mean")[n], 5).alias(a) for n, a in enumerate("xyz")])


# -- metrics ----------------------------------------------------------------------------------------------------


def images(spark, sf):
    """Each vector's elements as an image of 8 by 8 pixels, in steps of 1/64 and, to compare with, of 1/8."""
    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("n", "e"))
    step = lambda n: f"floor(cast(e AS double) * {n}) / {float(n)}D"
    return p.selectExpr("image", "0 AS c", "cast(n div 8 AS int) AS y", "cast(n % 8 AS int) AS x", f"{step(64)} AS a", f"{step(8)} AS b")


IMG = (
    "flat AS (SELECT vec_id AS image, CAST(unnest(range(64)) AS INTEGER) AS n, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings), "
    "img AS (SELECT image, 0 AS c, n // 8 AS y, n % 8 AS x, floor(e * 64) / 64.0::DOUBLE AS a, floor(e * 8) / 8.0::DOUBLE AS b FROM flat)"
)


@query(f"WITH {IMG} SELECT image, {settled('-10 * log10(avg((a - b) * (a - b)))')} AS psnr FROM img GROUP BY 1")
def psnr(spark, sf):
    return _rounded(metrics.psnr(images(spark, sf)), "psnr", digits=6)


GW = "exp(-d * d / 4.5::DOUBLE)"


@query(
    f"WITH {IMG}, r AS (SELECT CAST(unnest(range(-5, 6)) AS INTEGER) AS d), g AS (SELECT d, {GW} / (SELECT sum({GW}) FROM r) AS w FROM r), "
    "m AS (SELECT p.image, p.y, p.x, sum(gx.w * gy.w * q.a) AS a, sum(gx.w * gy.w * q.b) AS b, sum(gx.w * gy.w * q.a * q.a) AS aa, sum(gx.w * gy.w * q.b * q.b) AS bb, sum(gx.w * gy.w * q.a * q.b) AS ab "
    "FROM (img p CROSS JOIN g gx CROSS JOIN g gy) JOIN img q ON q.image = p.image AND q.y = p.y + gy.d AND q.x = p.x + gx.d GROUP BY 1, 2, 3) "
    f"SELECT {settled('avg((2 * a * b + 0.0001::DOUBLE) * (2 * (ab - a * b) + 0.0009::DOUBLE) / ((a * a + b * b + 0.0001::DOUBLE) * (aa - a * a + bb - b * b + 0.0009::DOUBLE)))')} AS ssim FROM m"
)
def ssim(spark, sf):
    return _rounded(metrics.ssim(images(spark, sf)), "ssim", digits=6)


@query(
    f"WITH {IMG}, r AS (SELECT CAST(unnest(range(-5, 6)) AS INTEGER) AS d), g AS (SELECT d, {GW} / (SELECT sum({GW}) FROM r) AS w FROM r), k AS (SELECT gx.d AS dx, gy.d AS dy, gx.w * gy.w AS w FROM g gx, g gy), "
    "m AS (SELECT p.image, p.y, p.x, sum(w * q.a) AS a, sum(w * q.b) AS b, sum(w * q.a * q.a) AS aa, sum(w * q.b * q.b) AS bb, sum(w * q.a * q.b) AS ab "
    "FROM (img p CROSS JOIN k) JOIN img q ON q.image = p.image AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3), "
    "t AS (SELECT *, 2 * a * b + 0.0001::DOUBLE AS n1, 2 * (ab - a * b) + 0.0009::DOUBLE AS n2, a * a + b * b + 0.0001::DOUBLE AS d1, aa - a * a + bb - b * b + 0.0009::DOUBLE AS d2 FROM m), "
    "v AS (SELECT image, y, x, 2 * b * (n2 - n1) / (d1 * d2) - n1 * n2 / (d1 * d2) * 2 * a * (1 / d1 - 1 / d2) AS ga, -n1 * n2 / (d1 * d2 * d2) AS gaa, 2 * n1 / (d1 * d2) AS gab FROM t) "
    f"SELECT p.image, p.y, p.x, {settled('sum(w * (ga + 2 * p.a * gaa + p.b * gab))', 4)} AS g_a FROM (img p CROSS JOIN k) JOIN v ON v.image = p.image AND v.y = p.y + dy AND v.x = p.x + dx GROUP BY 1, 2, 3"
)
def ssim_backward(spark, sf):
    """The gradient of the sum of all pixels' similarities."""
    out = metrics.ssim_backward(images(spark, sf).withColumn("g", F.lit(1.0)), grad="g")
    return out.select("image", "y", "x", settle(F.col("g_a"), 4).alias("g_a"))


__all__ = ["FEAT_E", "KEY"]
