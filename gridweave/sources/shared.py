"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names in ``spark.checkpoint.dir``.

    One is set only where there is none and all tasks run in this process, as in tests;
    on a cluster without one this fails.  What lies there goes when the driver's JVM ends.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    folder = f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4()}"
    files, path = _at(spark, folder)
    files.deleteOnExit(path)
    return folder


def _at(spark: SparkSession, folder: str) -> tuple:
    """A folder's file system and its path, as Hadoop has them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def written(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, which cuts its lineage.

    ``instead_of`` is an earlier table that this function gave and nothing reads any more: it is deleted.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "table")
    df.write.parquet(folder)
    if instead_of is not None:
        for old in {f.rsplit("/", 1)[0] for f in instead_of.inputFiles()}:
            files, path = _at(spark, old)
            files.delete(path, True)
    return spark.read.schema(df.schema).parquet(folder)
