"""The registry of queries, the point sets they use, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.spatial import IJK, KEY
from gridweave.operators.build import from_points
from gridweave.operators.grids import Grids

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Voxel sizes of the two point sets.
EMB_SIZE, LINE_SIZE = 0.1, (5.0, 10000.0, 0.02)


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    at = [F.col("embedding")[n].cast("double").alias(a) for n, a in enumerate("xyz")]
    return e.select(F.col("label").alias("grid_id"), F.col("vec_id").alias("point_id"), *at)


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem")
    grid = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return n.select(
        grid.alias("grid_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"),
        F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"),
    )


def emb_grid(spark: SparkSession, sf_dir: str) -> Grids:
    return from_points(emb_points(spark, sf_dir), EMB_SIZE)


def line_grid(spark: SparkSession, sf_dir: str) -> Grids:
    return from_points(line_points(spark, sf_dir), LINE_SIZE)


def feature(df: DataFrame, name: str = "f", turn: int = 0) -> DataFrame:
    """A value of each voxel from its coordinates, a multiple of 1/4."""
    value = F.pmod(F.col("i") * 7 + F.col("j") * 13 + F.col("k") * 29 + turn, F.lit(17)) / 4.0
    return df.withColumn(name, value)


#: SQL of the point sets, their voxels and the voxels' values.
PTS_E = "pts AS (SELECT label AS grid_id, vec_id AS point_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
PTS_L = (
    "pts AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS grid_id, l_orderkey * 8 + l_linenumber AS point_id, "
    "l_quantity AS x, l_extendedprice AS y, l_discount AS z FROM lineitem)"
)
SCALE_E, SCALE_L = ("0.1::DOUBLE",) * 3, ("5.0::DOUBLE", "10000.0::DOUBLE", "0.02::DOUBLE")


def _near(scale) -> str:
    return ", ".join(f"CAST(floor({a} / {s} + 0.5) AS INTEGER) AS {i}" for a, i, s in zip("xyz", IJK, scale))


VOX_E = f"{PTS_E}, vox AS (SELECT DISTINCT grid_id, {_near(SCALE_E)} FROM pts)"
VOX_L = f"{PTS_L}, vox AS (SELECT DISTINCT grid_id, {_near(SCALE_L)} FROM pts)"


def feat_sql(turn: int = 0) -> str:
    return f"((((i * 7 + j * 13 + k * 29 + {turn}) % 17) + 17) % 17) / 4.0::DOUBLE"


FEAT_E = f"{VOX_E}, feat AS (SELECT *, {feat_sql()} AS f FROM vox)"
FEAT_L = f"{VOX_L}, feat AS (SELECT *, {feat_sql()} AS f FROM vox)"


def settled(x: str, digits: int = 6) -> str:
    return f"CASE WHEN abs({x}) < 0.5e-{digits} THEN 0.0::DOUBLE ELSE round({x}, {digits}) END"


def box_sql(low: int, high: int, names=("di", "dj", "dk")) -> str:
    """SQL for a table of offsets."""
    parts = ", ".join(f"(SELECT CAST(unnest(range({low}, {high + 1})) AS INTEGER) AS {n})" for n in names)
    return f"(SELECT * FROM {parts})"


__all__ = ["KEY"]
