"""Grids and Gaussians in files: Parquet tables of a batch, and PLY point clouds of splats."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gridweave.functions.spatial import KEY, morton
from gridweave.operators.grids import META_SCHEMA, VOXEL_SCHEMA, Grids, check_columns

from .shared import written

#: Characters a grid's name may have.
MAX_NAME = 255


def save_grids(
    g: Grids, path: str, features: DataFrame | None = None, names: Sequence[str] | None = None, codec: str = "zstd", mode: str = "errorifexists"
) -> None:
    """Write a batch as tables ``meta``, ``voxels`` and ``features`` under ``path``.

    Voxels are clustered on a Z-order curve, so that files and row groups cover
    small boxes and bounds on i, j, k skip most of them.  Names may repeat.
    """
    names = list(names or [])
    if any(len(n) > MAX_NAME for n in names):
        raise ValueError(f"a name is longer than {MAX_NAME} characters")
    spark = g.meta.sparkSession
    named = spark.createDataFrame([(n, x) for n, x in enumerate(names)], "grid_id int, name string")
    n = g.voxels.groupBy("grid_id").agg(F.count("*").alias("num_voxels"), *[f(a).alias(f"{m}_{a}") for m, f in (("min", F.min), ("max", F.max)) for a in "ijk"])
    meta = g.meta.join(named, "grid_id", "left").join(n, "grid_id", "left")
    meta = meta.withColumns({"name": F.coalesce("name", F.lit("")), "num_voxels": F.coalesce("num_voxels", F.lit(0).cast("long"))})
    meta.write.mode(mode).option("compression", codec).parquet(f"{path}/meta")
    for name, df in (("voxels", g.voxels), ("features", features)):
        if df is not None:
            z = df.withColumn("_z", morton(*[F.col(a) + (1 << 20) for a in "ijk"]))
            z = z.repartitionByRange("grid_id", "_z").sortWithinPartitions("grid_id", "_z").drop("_z")
            z.write.mode(mode).option("compression", codec).parquet(f"{path}/{name}")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row a grid: name, transform, voxel count and bounds; no voxel is read."""
    return spark.read.parquet(f"{path}/meta")


def grid_names(spark: SparkSession, path: str) -> DataFrame:
    """Names in order of the grids; they may repeat."""
    return read_metadata(spark, path).select("grid_id", "name").orderBy("grid_id")


def load_grids(
    spark: SparkSession, path: str, index: int | None = None, indices: Sequence[int] | None = None, name: str | None = None,
    names: Sequence[str] | None = None,
) -> tuple[Grids, DataFrame | None]:
    """A batch and its features: all grids, or those chosen in one of four ways, numbered anew from 0."""
    ways = [x for x in (index, indices, name, names) if x is not None]
    if len(ways) > 1:
        raise ValueError("choose by index, indices, name or names, not by several")
    meta = read_metadata(spark, path)
    base = Grids(meta.select("grid_id", "sx", "sy", "sz", "ox", "oy", "oz"), spark.read.parquet(f"{path}/voxels"))
    try:
        features = spark.read.parquet(f"{path}/features")
    except Exception as e:  # the batch was saved without features
        if "PATH_NOT_FOUND" not in str(e):
            raise
        features = None
    if not ways:
        return base, features
    if index is not None or indices is not None:
        chosen = [index] if index is not None else list(indices)
    else:
        wanted = [name] if name is not None else list(names)
        # one row for each name asked for
        found = {r.name: r.g for r in meta.where(F.col("name").isin(wanted)).groupBy("name").agg(F.min("grid_id").alias("g")).collect()}
        missing = [w for w in wanted if w not in found]
        if missing:
            raise ValueError(f"no grids named {missing}")
        chosen = [found[w] for w in wanted]
    picked = base.pick(chosen)
    if features is not None:
        carrier = Grids(base.meta, features)
        features = carrier.pick(chosen).voxels
    return picked, features


# -- PLY ---------------------------------------------------------------------------------

KINDS = {"float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8", "uchar": "<u1", "uint8": "<u1", "int": "<i4", "int32": "<i4"}
GAUSSIAN_SCHEMA = (
    "path string, id long, mean array<double>, quat array<double>, log_scale array<double>, logit_opacity double, "
    "sh array<array<double>>, metadata map<string,string>"
)


def parse_ply(data: bytes) -> tuple[np.ndarray, dict[str, str]]:
    """Vertices of a binary little-endian PLY file as a record array, and its comments ``key value``."""
    end = data.index(b"end_header\n") + len(b"end_header\n")
    lines = data[:end].decode("ascii").splitlines()
    if lines[0] != "ply" or not any(x.startswith("format binary_little_endian") for x in lines):
        raise ValueError("only binary little-endian PLY is read")
    count, fields, inside, notes = 0, [], False, {}
    for line in lines:
        words = line.split()
        if words[0] == "element":
            inside = words[1] == "vertex"
            count = int(words[2]) if inside else count
        elif words[0] == "property" and inside:
            fields.append((words[2], KINDS[words[1]]))
        elif words[0] == "comment" and len(words) > 2:
            notes[words[1]] = " ".join(words[2:])
    return np.frombuffer(data, np.dtype(fields), count, end), notes


def read_gaussian_ply(spark: SparkSession, path: str) -> DataFrame:
    """Gaussians of PLY files, one task for each file: means, rotations, log scales, logit opacities, harmonics by channel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                v, notes = parse_ply(data)
                get = lambda *names: np.stack([v[n].astype(float) for n in names], 1)
                rest = sorted((n for n in v.dtype.names if n.startswith("f_rest_")), key=lambda n: int(n[7:]))
                per = len(rest) // 3
                sh = [get(f"f_dc_{c}", *rest[c * per : (c + 1) * per]) for c in range(3)]
                for a in range(0, len(v), 10_000):
                    part = slice(a, a + 10_000)
                    n = len(v[part])
                    cols = [[name] * n, list(range(a, a + n)), get("x", "y", "z")[part].tolist(), get(*[f"rot_{i}" for i in range(4)])[part].tolist()]
                    cols += [get(*[f"scale_{i}" for i in range(3)])[part].tolist(), v["opacity"][part].astype(float).tolist()]
                    cols += [[[s[r].tolist() for s in sh] for r in range(a, a + n)], [list(notes.items())] * n]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _ply_types())], [x.split(" ")[0] for x in re.split(r", (?=\w+ )", GAUSSIAN_SCHEMA)])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, GAUSSIAN_SCHEMA)


def _ply_types() -> list[pa.DataType]:
    three = pa.list_(pa.float64())
    return [pa.string(), pa.int64(), three, three, three, pa.float64(), pa.list_(three), pa.map_(pa.string(), pa.string())]


def ply_bytes(rows: Sequence, metadata: dict[str, str] | None = None) -> bytes:
    """A PLY file of Gaussians (rows with mean, quat, log_scale, logit_opacity, sh); for what fits one file."""
    per = len(rows[0].sh[0]) - 1 if rows else 0
    names = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", *[f"f_rest_{n}" for n in range(3 * per)], "opacity"]
    names += [f"scale_{n}" for n in range(3)] + [f"rot_{n}" for n in range(4)]
    body = [
        [*r.mean, *[c[0] for c in r.sh], *[x for c in r.sh for x in c[1:]], r.logit_opacity, *r.log_scale, *r.quat] for r in rows
    ]
    head = ["ply", "format binary_little_endian 1.0", *[f"comment {k} {v}" for k, v in (metadata or {}).items()], f"element vertex {len(rows)}"]
    head += [f"property float {n}" for n in names] + ["end_header\n"]
    return "\n".join(head).encode("ascii") + np.array(body, "<f4").reshape(len(rows), len(names)).tobytes()


def save_gaussian_ply(gaussians: DataFrame, folder: str, metadata: dict[str, str] | None = None, rows_per_file: int = 1 << 20) -> DataFrame:
    """PLY files of at most ``rows_per_file`` Gaussians each, in order of ``id``, under a folder that all executors reach.

    Every task writes its own files, through Arrow's file systems; a task that runs
    again replaces them.  Returns ``path`` and ``n`` of each file.
    """
    rows = check_columns(gaussians, "id", "mean", "quat", "log_scale", "logit_opacity", "sh").select("id", "mean", "quat", "log_scale", "logit_opacity", "sh")
    ordered = rows.orderBy("id").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        files.create_dir(base)
        held: list[Row] = []
        part = nth = 0

        def put(own: list[Row]) -> pa.RecordBatch:
            name = f"{base}/part-{part:05d}-{nth:05d}.ply"
            with files.open_output_stream(name) as f:
                f.write(ply_bytes(own, metadata))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(own)], pa.int64())], ["path", "n"])

        for b in batches:
            for r in b.to_pylist():
                part = r["part"]
                held.append(Row(**r))
                if len(held) == rows_per_file:
                    yield put(held)
                    held, nth = [], nth + 1
        if held:
            yield put(held)

    return written(ordered.mapInArrow(run, "path string, n long"))


def save_one_gaussian_ply(gaussians: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """One local PLY file; the rows are gathered and must fit the driver."""
    rows = check_columns(gaussians, "id", "mean", "quat", "log_scale", "logit_opacity", "sh").orderBy("id").collect()
    with open(path, "wb") as f:
        f.write(ply_bytes(rows, metadata))



# -- batches as bytes ---------------------------------------------------------------------


def serialize(g: Grids) -> DataFrame:
    """A batch as rows of bytes, ``kind`` and ``payload``: each an Arrow stream of some of its rows.

    No task holds more than one batch of rows, however large the grids.
    """

    def pack(kind: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as out:
                    out.write_batch(b)
                yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["kind", "payload"])

        return run

    schema = "kind string, payload binary"
    meta = g.meta.select(*META_SCHEMA.replace(",", " ").split()[::2])
    return meta.mapInArrow(pack("meta"), schema).union(g.voxels.select(*KEY).mapInArrow(pack("voxels"), schema))


def deserialize(data: DataFrame) -> Grids:
    """The batch whose rows ``serialize`` gave, in any order."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload in b.column("payload"):
                yield from pa.ipc.open_stream(payload.as_buffer())

    part = lambda kind, schema: data.where(F.col("kind") == kind).select("payload").mapInArrow(unpack, schema)
    return Grids(part("meta", META_SCHEMA), part("voxels", VOXEL_SCHEMA))


__all__ = ["KEY", "deserialize", "grid_names", "load_grids", "parse_ply", "ply_bytes", "read_gaussian_ply", "read_metadata", "save_gaussian_ply", "save_grids", "save_one_gaussian_ply", "serialize"]
