"""Batches of sparse voxel grids as relations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.functions.spatial import IJK, KEY, TRANSFORM, Triple, triple

META_SCHEMA = "grid_id int, sx double, sy double, sz double, ox double, oy double, oz double"
VOXEL_SCHEMA = "grid_id int, i int, j int, k int"
#: Grids whose table of transforms is small enough to broadcast: it is made of a driver-side list of at most this many.
MAX_LISTED = 1024
#: Neighbouring ids that are summed together in running sums.
SLAB_BITS = 12
#: Rows that a task sorts or holds, where their number is known.
ROWS_A_TASK = 1 << 20
#: Grids of at most so many voxels are solved whole, and about so many rows of them at a time.
WHOLE, GATHERED = 1 << 17, 1 << 16


def check_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df``, if it has the columns; raises before any job runs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    return df


def meet(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join of two tables that grow with the input, by a shuffle.

    Spark takes a table for about as large as the file it was made from, however many
    voxels or pixels were made of each row, so left to itself it would broadcast them.
    """
    return left.join(right.hint("merge"), on, how)


def tasks_for(df: DataFrame, rows: float) -> int:
    """As many tasks as leave about ``ROWS_A_TASK`` rows to each, and no fewer than the session's own number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / ROWS_A_TASK))


def by_grids(df: DataFrame, rows: float, solve: Callable[[pa.Table], Iterable[pa.RecordBatch]], schema: str, gathered: int = GATHERED) -> DataFrame:
    """Run ``solve`` on the rows of whole grids, many grids at a time: one shuffle whatever it does.

    A grid meets in one task, so this is for grids of at most ``WHOLE`` voxels.  ``rows`` tells how many tasks there are.
    """

    def run(batches):
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n < gathered:
                continue
            t = pa.Table.from_batches(held)
            ids = t.column("grid_id").to_numpy()
            whole = int(np.searchsorted(ids, ids[-1]))  # the last grid may go on
            if whole:
                yield from solve(t.slice(0, whole).combine_chunks())
            held = t.slice(whole).to_batches()
            n = t.num_rows - whole
        if n:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return df.repartition(tasks_for(df, rows), "grid_id").sortWithinPartitions("grid_id").mapInArrow(run, schema)


def close_steps(x: np.ndarray, grid: np.ndarray | None = None) -> np.ndarray:
    """Coordinates numbered closely: neighbours stay one apart, gaps shrink to two, and so do steps between grids."""
    order = np.argsort(x, kind="stable") if grid is None else np.lexsort((x, grid))
    step = np.minimum(np.diff(x[order].astype(np.int64), prepend=x[order[:1]]), 2)
    if grid is not None:
        step[1:][np.diff(grid[order]) != 0] = 2
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(step)
    return out


def distinct_rows(cols: Sequence[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of whole numbers, in order, and where each given row is among them."""
    low = [int(c.min()) for c in cols]
    span = [int(c.max()) - n + 1 for c, n in zip(cols, low)]
    if math.prod(span) < 1 << 62:
        code = np.zeros(len(cols[0]), np.int64)
        for c, n, s in zip(cols, low, span):
            code = code * s + (c - n)
        code, at = np.unique(code, return_inverse=True)
        out = []
        for n, s in zip(low[::-1], span[::-1]):
            code, rest = np.divmod(code, s)
            out.append(rest + n)
        return out[::-1], at
    order = np.lexsort(cols[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(c[order]) != 0 for c in cols], axis=0)
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return [c[order[new]] for c in cols], at


def numbered(df: DataFrame, slab: str, order: Sequence[str], name: str) -> DataFrame:
    """Rows numbered from 0 within their grid, in order of ``slab`` and then ``order``.

    Counts of the slabs give where each begins, so rows are ranked slab by slab and
    a large grid doesn't meet in one task.
    """
    n = df.groupBy("grid_id", slab).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("grid_id").orderBy(slab).rowsBetween(Window.unboundedPreceding, -1)
    n = n.select("grid_id", slab, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("grid_id", slab).orderBy(*order))
    out = meet(df.withColumn("_rank", rank), n, ["grid_id", slab])
    return out.withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("long")).select(*df.columns, name)


def running_sums(df: DataFrame, key: str, order: Sequence[str], value: str, before: str, nth: str | None = None) -> DataFrame:
    """Rows with the sum of ``value`` over all rows that come before, by ``key`` (an int) and then ``order``.

    With ``nth``, also how many come before.  Sums of slabs of 2 ** ``SLAB_BITS``
    neighbouring keys give where each slab begins, and rows are summed slab by slab.
    An int has at most 2 ** (32 - ``SLAB_BITS``) slabs: what meets in one task, and is
    broadcast, is bounded by the type of the key, whatever the input.
    """
    rows = df.withColumn("_slab", F.shiftright(F.col(key).cast("int"), SLAB_BITS))
    slabs = rows.groupBy("_slab").agg(F.sum(value).alias("_n"), F.count("*").alias("_c"))
    earlier = Window.orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    begin = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c + "0") for c in ("_n", "_c")]
    slabs = slabs.select(F.col("_slab"), *begin)
    within = Window.partitionBy("_slab").orderBy(*order)
    here = F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"_n1": here, "_c1": F.row_number().over(within) - 1}).join(F.broadcast(slabs), "_slab")
    added = {before: (F.col("_n0") + F.col("_n1")).cast("long")}
    if nth:
        added[nth] = (F.col("_c0") + F.col("_c1")).cast("long")
    return rows.withColumns(added).select(*df.columns, *added)


@dataclass(frozen=True)
class Grids:
    """A batch of grids: ``meta`` with each grid's voxel size and origin, ``voxels`` with its distinct active voxels.

    Both are lazy.  Where all grids share one transform it is kept in ``shared``
    and enters expressions as literals; otherwise rows learn it by a join, which is
    broadcast only if the table came from a list of at most ``MAX_LISTED`` grids.
    A grid without voxels is a row of ``meta`` alone.
    """

    meta: DataFrame
    voxels: DataFrame
    shared: tuple[tuple, tuple] | None = None
    listed: bool = False

    # -- transforms -----------------------------------------------------------------

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` with the transform of each row's grid."""
        if self.shared is not None:
            size, origin = self.shared
            return df.withColumns({n: F.lit(float(v)) for n, v in zip(TRANSFORM, (*size, *origin))})
        meta = self.meta.select("grid_id", *TRANSFORM)
        return df.join(F.broadcast(meta) if self.listed else meta, "grid_id")

    def world_to_voxel(self, points: DataFrame, names: Sequence[str] = ("x", "y", "z"), out=("vx", "vy", "vz")) -> DataFrame:
        """Voxel coordinates ``p / size - origin / size`` of world points, as new columns."""
        df = self.attach(check_columns(points, "grid_id", *names))
        cols = {o: F.col(n) / F.col(s) - F.col(g) / F.col(s) for o, n, s, g in zip(out, names, TRANSFORM[:3], TRANSFORM[3:])}
        return df.withColumns(cols).drop(*TRANSFORM)

    def voxel_to_world(self, points: DataFrame, names: Sequence[str] = ("i", "j", "k"), out=("x", "y", "z")) -> DataFrame:
        """World coordinates ``(v + origin / size) * size`` of voxel coordinates, as new columns."""
        df = self.attach(check_columns(points, "grid_id", *names))
        cols = {o: (F.col(n) + F.col(g) / F.col(s)) * F.col(s) for o, n, s, g in zip(out, names, TRANSFORM[:3], TRANSFORM[3:])}
        return df.withColumns(cols).drop(*TRANSFORM)

    def moved(self, size, origin, voxels: DataFrame | None = None) -> Grids:
        """The batch with sizes and origins computed per axis from columns s and o; other voxels if given."""
        voxels = self.voxels if voxels is None else voxels
        cols = {}
        for a, s, o in zip(range(3), TRANSFORM[:3], TRANSFORM[3:]):
            cols[s], cols[o] = size(a, F.col(s), F.col(o)), origin(a, F.col(s), F.col(o))
        meta = self.meta.withColumns(cols)
        return Grids(meta, voxels, None, self.listed)

    def with_voxels(self, voxels: DataFrame) -> Grids:
        """The same grids and transforms over other voxels (distinct already)."""
        return Grids(self.meta, voxels, self.shared, self.listed)

    # -- properties --------------------------------------------------------------------

    def indexed(self, name: str = "idx") -> DataFrame:
        """Voxels with their number in their grid, from 0 in order of i, j, k."""
        return numbered(self.voxels.select(*KEY), "i", ["j", "k"], name)

    def num_voxels(self) -> DataFrame:
        """Voxels of each grid, 0 for empty ones."""
        n = self.voxels.groupBy("grid_id").agg(F.count("*").alias("num_voxels"))
        return self.meta.select("grid_id").join(n, "grid_id", "left").select("grid_id", F.coalesce("num_voxels", F.lit(0).cast("long")).alias("num_voxels"))

    def offsets(self) -> DataFrame:
        """For each grid its voxels, how many grids up to it have (``cum_voxels``), and where its own begin (``joffset``)."""
        n = running_sums(self.num_voxels(), "grid_id", ["grid_id"], "num_voxels", "joffset")
        return n.select("grid_id", "num_voxels", (F.col("joffset") + F.col("num_voxels")).alias("cum_voxels"), "joffset")

    def total_voxels(self) -> DataFrame:
        return self.voxels.agg(F.count("*").alias("total_voxels"))

    def bboxes(self, dual: bool = False) -> DataFrame:
        """Least and largest voxel of each grid with voxels; for the dual grid the largest plus one."""
        add = 1 if dual else 0
        aggs = [F.min(a).alias(f"min_{a}") for a in IJK] + [(F.max(a) + add).alias(f"max_{a}") for a in IJK]
        return self.voxels.groupBy("grid_id").agg(*aggs)

    def total_bbox(self) -> DataFrame:
        return self.voxels.agg(*[F.min(a).alias(f"min_{a}") for a in IJK], *[F.max(a).alias(f"max_{a}") for a in IJK])

    def leaf_counts(self) -> DataFrame:
        """Blocks of 8 cubed voxels that hold a voxel, by grid."""
        blocks = self.voxels.select("grid_id", *[F.shiftright(a, 3).alias(a) for a in IJK]).distinct()
        return blocks.groupBy("grid_id").agg(F.count("*").alias("num_leaf_nodes"))

    def num_bytes(self) -> DataFrame:
        """Bytes of each grid's rows: four ints a voxel, and an int and six doubles of the grid itself."""
        return self.num_voxels().select("grid_id", (F.col("num_voxels") * 16 + 52).alias("num_bytes"))

    def emptiness(self) -> DataFrame:
        """One row: whether there is no grid, every grid is empty, some grid is."""
        n = self.num_voxels()
        empty = F.col("num_voxels") == 0
        return n.agg(
            (F.count("*") == 0).alias("has_zero_grids"),
            F.coalesce(F.bool_and(empty), F.lit(True)).alias("all_have_zero_voxels"),
            F.coalesce(F.bool_or(empty), F.lit(False)).alias("any_have_zero_voxels"),
        )

    def matrices(self) -> DataFrame:
        """Row-major 4 by 4 matrices of the transforms, for column vectors."""
        zero, one = F.lit(0.0), F.lit(1.0)

        def rows(diagonal: list[Column], shift: list[Column]) -> Column:
            body = [[diagonal[a] if a == b else zero for b in range(3)] + [shift[a]] for a in range(3)]
            return F.array(*[c for r in body for c in r], zero, zero, zero, one)

        s, o = [F.col(c) for c in TRANSFORM[:3]], [F.col(c) for c in TRANSFORM[3:]]
        return self.meta.select(
            "grid_id",
            rows(s, o).alias("voxel_to_world"),
            rows([1 / x for x in s], [-b / a for a, b in zip(s, o)]).alias("world_to_voxel"),
        )

    def is_same(self, other: Grids) -> DataFrame:
        """One row: whether both have the same grids, transforms and voxels."""
        cols = ["grid_id", *TRANSFORM]
        differ = [
            a.exceptAll(b)
            for x, y, c in ((self.meta, other.meta, cols), (self.voxels, other.voxels, KEY))
            for a, b in ((x.select(*c), y.select(*c)), (y.select(*c), x.select(*c)))
        ]
        counts = [d.select(F.lit(1).alias("n")) for d in differ]
        every = counts[0].union(counts[1]).union(counts[2]).union(counts[3])
        return every.agg((F.count("*") == 0).alias("is_same"))

    # -- choosing grids -------------------------------------------------------------------

    def pick(self, ids: Sequence[int] | Sequence[bool] | slice | int, count: int | None = None) -> Grids:
        """Grids by number, list, mask or slice, numbered anew in the order given; a slice or a negative number needs ``count``."""
        if isinstance(ids, bool):
            raise ValueError("a single truth value picks nothing")
        if isinstance(ids, slice):
            if count is None:
                raise ValueError("a slice needs the number of grids")
            ids = list(range(count))[ids]
        ids = [ids] if isinstance(ids, int) else list(ids)
        if ids and all(isinstance(x, bool) for x in ids):
            ids = [n for n, keep in enumerate(ids) if keep]
        if any(x < 0 for x in ids):
            if count is None:
                raise ValueError("a negative number needs the number of grids")
            ids = [x + count if x < 0 else x for x in ids]
        spark = self.meta.sparkSession
        order = spark.createDataFrame([(int(x), n) for n, x in enumerate(ids)], "grid_id int, new_id int")
        hint = F.broadcast if len(ids) <= MAX_LISTED else (lambda d: d)

        def renumber(df: DataFrame) -> DataFrame:
            rest = [c for c in df.columns if c != "grid_id"]
            return df.join(hint(order), "grid_id").select(F.col("new_id").alias("grid_id"), *rest)

        return Grids(renumber(self.meta), renumber(self.voxels), self.shared, self.listed)


def listed_meta(spark: SparkSession, sizes: Sequence[Triple], origins: Sequence[Triple]) -> DataFrame:
    """Transforms of grids 0, 1, ... from driver-side lists."""
    rows = []
    for n, (s, o) in enumerate(zip(sizes, origins, strict=True)):
        s, o = triple(s), triple(o)
        if min(s) <= 0:
            raise ValueError("voxel sizes must be positive")
        rows.append((n, *map(float, s), *map(float, o)))
    return spark.createDataFrame(rows, META_SCHEMA)


def shared_meta(ids: DataFrame, size: Triple, origin: Triple) -> DataFrame:
    """One transform for every distinct ``grid_id`` of ``ids``."""
    size, origin = triple(size), triple(origin)
    if min(size) <= 0:
        raise ValueError("voxel sizes must be positive")
    cols = {n: F.lit(float(v)) for n, v in zip(TRANSFORM, (*size, *origin))}
    return ids.select(F.col("grid_id").cast("int").alias("grid_id")).distinct().withColumns(cols)


def shared_grids(ids: DataFrame, voxels: DataFrame, size: Triple = 1.0, origin: Triple = 0.0) -> Grids:
    return Grids(shared_meta(ids, size, origin), voxels, (triple(size), triple(origin)))
