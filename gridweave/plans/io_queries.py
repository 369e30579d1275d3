"""Queries of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions.spatial import KEY, settle
from gridweave.operators import splats
from gridweave.sources import grid_io
from gridweave.sources.shared import shared_folder
from gridweave.streaming import merge

from .base import FEAT_E, emb_grid, feature, query, settled, table
from .list_queries import CAMS, SIZE, gaussians, world_sql


@query(f"WITH {FEAT_E} SELECT CASE grid_id WHEN 4 THEN 0 ELSE 1 END AS grid_id, i, j, k, CAST(f AS DOUBLE) AS f FROM feat WHERE grid_id IN (4, 1)")
def load_saved_grids(spark, sf):
    """Two grids of a saved batch, by name."""
    g, path = emb_grid(spark, sf), shared_folder(spark, "grids")
    grid_io.save_grids(g, path, feature(g.voxels), [f"grid{n}" for n in range(10)])
    picked, f = grid_io.load_grids(spark, path, names=["grid4", "grid1"])
    return picked.voxels.join(f, KEY)


@query(
    f"WITH {FEAT_E} SELECT grid_id, 'grid' || grid_id AS name, 0.1::DOUBLE AS sx, count(*) AS num_voxels, min(i) AS min_i, max(k) AS max_k FROM feat GROUP BY grid_id"
)
def saved_metadata(spark, sf):
    g, path = emb_grid(spark, sf), shared_folder(spark, "grids")
    grid_io.save_grids(g, path, None, [f"grid{n}" for n in range(10)])
    return grid_io.read_metadata(spark, path).select("grid_id", "name", "sx", "num_voxels", "min_i", "max_k")


EVT = (
    "p AS (SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS grid_id, epoch(ts - TIMESTAMP '2024-01-01') / 3600.0::DOUBLE AS x, user_id / 10.0::DOUBLE AS y, value / 50 AS z, ts, value FROM events)"
)
EVT_SIZE = (24.0, 5.0, 1.0)
CELL = "CAST(floor(x / 24.0::DOUBLE + 0.5) AS INTEGER) AS i, CAST(floor(y / 5.0::DOUBLE + 0.5) AS INTEGER) AS j, CAST(floor(z / 1.0::DOUBLE + 0.5) AS INTEGER) AS k"


def event_points(e):
    grid = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 1e6 / 3600.0
    return e.select(grid.alias("grid_id"), hours.alias("x"), (F.col("user_id") / 10.0).alias("y"), (F.col("value") / 50).alias("z"), "ts", "value")


@query(f"WITH {EVT} SELECT grid_id, {CELL}, count(*) AS n, {settled('avg(value)', 5)} AS value FROM p GROUP BY 1, 2, 3, 4")
def voxel_means(spark, sf):
    m = merge.voxel_moments(event_points(table(spark, sf, "events")), ("value",), EVT_SIZE)
    return merge.means(m, ("value",)).withColumn("value", settle(F.col("value"), 5))


@query(f"WITH {EVT} SELECT grid_id, {CELL}, count(*) AS n, {settled('sum(value)', 4)} AS value FROM p GROUP BY 1, 2, 3, 4")
def stream_voxel_merge(spark, sf):
    """The events as a stream, merged batch by batch."""
    folder = shared_folder(spark, "stream")
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events.parquet*")
    out = event_points(stream).writeStream.foreachBatch(merge.merger(folder, ("value",), EVT_SIZE)).option("checkpointLocation", f"{folder}-log")
    out.trigger(availableNow=True).start().awaitTermination()
    return merge.merged(spark, folder, ("value",)).select(*KEY, "n", settle(F.col("value"), 4).alias("value"))


@query(f"WITH {EVT} SELECT CAST(epoch(time_bucket(INTERVAL 6 hours, ts)) AS BIGINT) AS start, grid_id, count(*) AS n, {settled('sum(value)', 4)} AS value FROM p GROUP BY 1, 2")
def windowed_voxel_moments(spark, sf):
    """Tumbling windows; over a table the watermark drops nothing."""
    m = merge.windowed_moments(event_points(table(spark, sf, "events")), ("value",), "ts", "6 hours", "1 day", EVT_SIZE)
    return m.groupBy(F.unix_timestamp("window.start").alias("start"), "grid_id").agg(F.sum("n").alias("n"), settle(F.sum("value"), 4).alias("value"))


@query(f"WITH {world_sql()} SELECT 0 AS cam, px.pu AS u, px.pv AS v, {settled('coalesce(s.red, 0)', 4)} AS red, {settled('coalesce(s.o, 0)', 4)} AS opacity FROM px LEFT JOIN s USING (pu, pv)")
def rasterize_world_space(spark, sf):
    g = gaussians(spark, sf).drop("ratio", "logit_opacity")
    foot = splats.project(g, {0: CAMS[0]}, SIZE).select("cam", "id", "mx", "my", "depth", "radius_x", "radius_y", "opacity", "red")
    px = splats.all_pixels(spark, [0], SIZE)
    eye = px.selectExpr("cam", "u", "v", "0.0D AS ox", "0.0D AS oy", "0.0D AS oz", "(u + 0.5D - 32) / 50 AS dx", "(v + 0.5D - 24) / 50 AS dy", "1.0D AS dz")
    out = splats.rasterize_world(g.select("id", "mean", "quat", "log_scale"), foot, eye, SIZE, ("red",))
    return out.withColumns({"red": settle(F.col("red"), 4), "opacity": settle(F.col("opacity"), 4)})


@query(f"WITH {FEAT_E} SELECT grid_id, i, j, k, 0.1::DOUBLE AS sx FROM feat")
def serialized_grids(spark, sf):
    """A batch as rows of bytes, and back."""
    g = grid_io.deserialize(grid_io.serialize(emb_grid(spark, sf)))
    return g.attach(g.voxels).select(*KEY, "sx")


@query(f"WITH {FEAT_E}, n AS (SELECT grid_id, count(*) AS n FROM feat GROUP BY 1) SELECT grid_id, CAST(n * 16 + 52 AS BIGINT) AS num_bytes FROM n")
def grid_bytes(spark, sf):
    return emb_grid(spark, sf).num_bytes()


@query(f"WITH {FEAT_E} SELECT grid_id, 'grid' || grid_id AS name FROM feat GROUP BY grid_id")
def saved_names(spark, sf):
    g, path = emb_grid(spark, sf), shared_folder(spark, "grids")
    grid_io.save_grids(g, path, None, [f"grid{n}" for n in range(10)])
    return grid_io.grid_names(spark, path)
