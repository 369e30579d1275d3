"""Helpers shared by the text operators: table access, cuts of lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Keys with more than a share of one in HOT_KEYS of the rows are joined by broadcast: fewer than HOT_KEYS rows.
HOT_KEYS = 1000
#: Spark's setting by which shuffle files go at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Null ids count as the largest long where ids are compared.
LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` as string, whatever other columns there are."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def ascii_lower(col):
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(col, UPPER, LOWER)


def text_digest(text):
    """256 bits of a text, in hex; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def rows_of(docs: DataFrame, keep: DataFrame, digest, once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` and ``digest`` are in ``keep`` (``doc_id``, ``digest``), columns unchanged.

    A null id equals a null id.  With ``once``, one row of those that share both stays.
    """
    # plain equalities, so that repeated rows are found in the join's own partitions
    keys = lambda i, d: {"_none": F.isnull(i), "_id": F.coalesce(i, F.lit(0)), "_digest": d}
    names = ["_none", "_id", "_digest"]
    keep = keep.withColumns(keys(keep["doc_id"], keep["digest"])).select(names).distinct()
    named = docs.withColumns(keys(docs["doc_id"].cast("long"), digest))
    kept = named.join(keep, [named[n] == keep[n] for n in names], "left_semi")
    return (kept.dropDuplicates(names) if once else kept).drop(*names)


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder for cuts of lineage, shared by all executors: what the session names in ``spark.checkpoint.dir``.

    One is set here only where there is none and all tasks run in this process, as in
    tests; on a cluster without one this fails.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that few texts at a time are Python objects."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), rows):
            yield b.slice(at, rows)


def _at(spark: SparkSession, path: str) -> tuple:
    """A path's file system and the path, as Hadoop has them."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder; for many rows, smaller than a checkpoint.

    What its job shuffled is deleted once it is written.  The table goes when the
    driver's JVM ends, if not before (``drop_written``).
    """
    spark = df.sparkSession
    path = f"{_checkpoint_dir(spark)}/table-{uuid.uuid4()}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    files, p = _at(df.sparkSession, path)
    files.deleteOnExit(p)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table that ``written`` made and nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        files, p = _at(df.sparkSession, path)
        files.delete(p, True)


def learn(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with what ``facts`` says of their ``keys``: null where it says nothing.

    ``facts`` has one row a key, and in ``n`` how many of the ``total`` rows have it.  A key
    of more than ``total / HOT_KEYS`` rows would meet in one task.  There are fewer than
    ``HOT_KEYS`` of these, whatever the input, so their facts are broadcast, and their
    rows go through the join under keys of their own, spread over all tasks.
    """
    names = [c for c in facts.columns if c not in keys and c != "n"]
    hot = facts.where(F.col("n") > max(1, total) / HOT_KEYS).select(*[F.col(k).alias("_h" + k) for k in keys], F.struct(*names).alias("_hot"))
    r = rows.join(F.broadcast(hot), [rows[k] == hot["_h" + k] for k in keys], "left").drop(*["_h" + k for k in keys])
    own = F.shiftleft(F.xxhash64(*rows.columns), 1) + 1  # odd; the same whenever a lost task runs again
    r = r.withColumn("_spread", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(own))
    # zero, but not to the optimizer, which would take a constant out of the join's keys
    zero = F.when(F.col("n") < 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    f = facts.select(*[F.col(k).alias("_f" + k) for k in keys], zero.alias("_zero"), F.struct(*names).alias("_cold"))
    j = r.join(f, [*[r[k] == f["_f" + k] for k in keys], r["_spread"] == f["_zero"]], "left")
    said = F.coalesce("_hot", "_cold")
    return j.select(*rows.columns, *[said[c].alias(c) for c in names])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable vertex of each vertex that has an edge.

    ``edges`` has two columns ``a`` and ``b`` of one type that has an order;
    direction, repeats and self loops don't matter.  Alternates large-star and
    small-star rounds: each is a grouped minimum (combined before the shuffle, so a
    hub costs one row per task) and an equi-join in which a hub's rows are spread
    (``learn``).  Each round's edges are a table that goes when the next is written.
    Returns ``id``, ``component``; vertices without edges are not in it.
    """

    def stars(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = sign(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stars(both).select("u", F.least("u", "m").alias("m"), "n")
        large = learn(both.where("v > u"), low, ["u"], 2 * seen[0])
        large = large.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = stars(large)
        hung = learn(large, low, ["u"], seen[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = written(hung.union(low.select("u", F.col("m").alias("v"))).distinct())
        now = sign(small)
        drop_written(e)
        e = small
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds")
    out = e.groupBy("u").agg(F.min("v").alias("v"))
    return out.select(F.col("u").alias("id"), F.col("v").alias("component")).union(out.select("v", "v").distinct())
