"""Voxel state merged from streams: occupancy counts and running weighted means."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.spatial import IJK, KEY, Triple, nearest
from gridweave.operators.build import _over


def voxel_moments(points: DataFrame, values: Sequence[str], size: Triple = 1.0, origin: Triple = 0.0, weight: str | None = None) -> DataFrame:
    """Points ``grid_id, x, y, z`` by nearest voxel: count, sum of weights, weighted sums of values.

    Works on streams too: everything is one grouped aggregate, so ``writeStream`` in
    update or complete mode keeps the state.
    """
    v = _over(points, size, origin, None).world_to_voxel(points.withColumn("grid_id", F.col("grid_id").cast("int")))
    w = F.col(weight) if weight else F.lit(1.0)
    v = v.withColumns({n: nearest(F.col("v" + a)) for a, n in zip("xyz", IJK)} | {"_w": w})
    return v.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("_w").alias("weight"), *[F.sum(F.col("_w") * F.col(c)).alias(c) for c in values])


def windowed_moments(points: DataFrame, values: Sequence[str], time: str, length: str, late: str, size: Triple = 1.0, origin: Triple = 0.0, slide: str | None = None) -> DataFrame:
    """The same by time window, with a watermark: rows later than ``late`` are dropped and old windows leave the state."""
    v = _over(points, size, origin, None).world_to_voxel(points.withColumn("grid_id", F.col("grid_id").cast("int")))
    v = v.withColumns({n: nearest(F.col("v" + a)) for a, n in zip("xyz", IJK)}).withWatermark(time, late)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return v.groupBy(window.alias("window"), *KEY).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in values])


def merge_moments(state: DataFrame, batch: DataFrame, values: Sequence[str]) -> DataFrame:
    """Sum of two tables of moments: batches may come in any order and split."""
    both = state.select(*KEY, "n", "weight", *values).unionByName(batch.select(*KEY, "n", "weight", *values))
    return both.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("n", "weight", *values)])


def means(moments: DataFrame, values: Sequence[str]) -> DataFrame:
    """Weighted means from moments."""
    return moments.select(*KEY, "n", *[F.when(F.col("weight") != 0, F.col(c) / F.when(F.col("weight") != 0, F.col("weight"))).alias(c) for c in values])


def merger(folder: str, values: Sequence[str], size: Triple = 1.0, origin: Triple = 0.0) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that appends each batch's moments as a part under ``folder``.

    Parts are named by batch, so a batch that is replayed replaces itself; reading
    the folder and summing gives the state.  No batch rewrites another's.
    """

    def run(batch: DataFrame, number: int) -> None:
        voxel_moments(batch, values, size, origin).write.mode("overwrite").parquet(f"{folder}/part={number}")

    return run


def merged(spark, folder: str, values: Sequence[str]) -> DataFrame:
    """The state from all parts so far."""
    parts = spark.read.parquet(folder)
    return parts.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("n", "weight", *values)])
