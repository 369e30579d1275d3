"""The operators as methods: batches of grids, single grids, and jagged lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.functions import elementwise
from gridweave.functions.spatial import KEY
from gridweave.operators import build, jagged, mesh, pool, query, rays, sample, sdf, topology, tsdf
from gridweave.operators.conv import ConvPlan
from gridweave.operators.grids import Grids
from gridweave.sources import grid_io


def _bound(function, place: int):
    """A method that calls ``function`` with the batch's grids as argument number ``place``."""

    def method(self, *args, **named):
        rest = list(args)
        rest.insert(place, self.grids)
        rest = [a.grids if isinstance(a, GridBatch) else a for a in rest]
        named = {k: v.grids if isinstance(v, GridBatch) else v for k, v in named.items()}
        out = function(*rest, **named)
        if isinstance(out, Grids):
            return type(self)(out)
        if isinstance(out, tuple):
            return tuple(type(self)(o) if isinstance(o, Grids) else o for o in out)
        return out

    method.__doc__, method.__name__ = function.__doc__, function.__name__
    return method


def _maker(function):
    def make(cls, *args, **named):
        return cls(function(*args, **named))

    make.__doc__, make.__name__ = function.__doc__, function.__name__
    return classmethod(make)


@dataclass(frozen=True)
class GridBatch:
    """A batch of sparse grids; immutable and lazy.  Methods take and give DataFrames keyed by ``grid_id, i, j, k``."""

    grids: Grids

    from_points = _maker(build.from_points)
    from_nearest_voxels_to_points = _maker(build.from_nearest_voxels_to_points)
    from_ijk = _maker(build.from_ijk)
    from_dense = _maker(build.from_dense)
    from_dense_axis_aligned_bounds = _maker(build.from_dense_axis_aligned_bounds)
    from_mesh = _maker(build.from_mesh)
    from_zero_grids = _maker(build.from_zero_grids)
    from_zero_voxels = _maker(build.from_zero_voxels)

    @classmethod
    def from_cat(cls, batches: Sequence[tuple[GridBatch, int]]) -> GridBatch:
        return cls(build.concatenate([(b.grids, n) for b, n in batches]))

    @classmethod
    def load(cls, spark: SparkSession, path: str, **choice) -> tuple[GridBatch, DataFrame | None]:
        grids, features = grid_io.load_grids(spark, path, **choice)
        return cls(grids), features

    def save(self, path: str, features: DataFrame | None = None, names: Sequence[str] | None = None, **options) -> None:
        grid_io.save_grids(self.grids, path, features, names, **options)

    # -- properties
    @property
    def ijk(self) -> DataFrame:
        return self.grids.voxels

    @property
    def meta(self) -> DataFrame:
        return self.grids.meta

    @property
    def voxel_sizes(self) -> DataFrame:
        return self.grids.meta.select("grid_id", "sx", "sy", "sz")

    @property
    def origins(self) -> DataFrame:
        return self.grids.meta.select("grid_id", "ox", "oy", "oz")

    @property
    def num_voxels(self) -> DataFrame:
        return self.grids.num_voxels()

    @property
    def cum_voxels(self) -> DataFrame:
        return self.grids.offsets().select("grid_id", "cum_voxels")

    @property
    def joffsets(self) -> DataFrame:
        return self.grids.offsets().select("grid_id", "joffset")

    @property
    def jidx(self) -> DataFrame:
        return self.grids.indexed().select("grid_id", "idx")

    @property
    def total_voxels(self) -> DataFrame:
        return self.grids.total_voxels()

    @property
    def grid_count(self) -> DataFrame:
        return self.grids.meta.agg(F.count("*").alias("grid_count"))

    @property
    def bboxes(self) -> DataFrame:
        return self.grids.bboxes()

    @property
    def dual_bboxes(self) -> DataFrame:
        return self.grids.bboxes(dual=True)

    @property
    def total_bbox(self) -> DataFrame:
        return self.grids.total_bbox()

    @property
    def num_leaf_nodes(self) -> DataFrame:
        return self.grids.leaf_counts()

    @property
    def total_leaf_nodes(self) -> DataFrame:
        return self.grids.leaf_counts().agg(F.coalesce(F.sum("num_leaf_nodes"), F.lit(0)).alias("total_leaf_nodes"))

    @property
    def voxel_to_world_matrices(self) -> DataFrame:
        return self.grids.matrices().select("grid_id", "voxel_to_world")

    @property
    def world_to_voxel_matrices(self) -> DataFrame:
        return self.grids.matrices().select("grid_id", "world_to_voxel")

    @property
    def num_bytes(self) -> DataFrame:
        return self.grids.num_bytes()

    def emptiness(self) -> DataFrame:
        return self.grids.emptiness()

    def serialize(self) -> DataFrame:
        return grid_io.serialize(self.grids)

    @classmethod
    def deserialize(cls, data: DataFrame) -> GridBatch:
        return cls(grid_io.deserialize(data))

    def num_voxels_at(self, grid: int) -> DataFrame:
        return self.num_voxels.where(F.col("grid_id") == grid)

    def cum_voxels_at(self, grid: int) -> DataFrame:
        return self.cum_voxels.where(F.col("grid_id") == grid)

    def voxel_size_at(self, grid: int) -> DataFrame:
        return self.voxel_sizes.where(F.col("grid_id") == grid)

    def origin_at(self, grid: int) -> DataFrame:
        return self.origins.where(F.col("grid_id") == grid)

    def bbox_at(self, grid: int) -> DataFrame:
        return self.bboxes.where(F.col("grid_id") == grid)

    def dual_bbox_at(self, grid: int) -> DataFrame:
        return self.dual_bboxes.where(F.col("grid_id") == grid)

    def has_zero_voxels_at(self, grid: int) -> DataFrame:
        return self.num_voxels_at(grid).select((F.col("num_voxels") == 0).alias("has_zero_voxels"))

    def is_same(self, other: GridBatch) -> DataFrame:
        return self.grids.is_same(other.grids)

    def pick(self, ids, count: int | None = None) -> GridBatch:
        return type(self)(self.grids.pick(ids, count))

    __getitem__ = pick

    def jagged_like(self, values: DataFrame) -> DataFrame:
        """Values attached to the voxels by key."""
        return self.grids.voxels.join(values, KEY, "left")

    def contiguous(self) -> GridBatch:
        """The batch itself: a relation has no gaps to close."""
        return self

    # -- lookups and transforms
    points_in_grid = _bound(query.points_in_grid, 1)
    coords_in_grid = _bound(query.coords_in_grid, 1)
    cubes_in_grid = _bound(query.cubes_in_grid, 1)
    cubes_intersect_grid = _bound(query.cubes_intersect_grid, 1)
    ijk_to_index = _bound(query.ijk_to_index, 1)
    ijk_to_inv_index = _bound(query.ijk_to_inv_index, 1)
    neighbor_indexes = _bound(query.neighbor_indexes, 1)
    active_in_bounds = _bound(query.active_in_bounds, 0)
    world_to_voxel = _bound(Grids.world_to_voxel, 0)
    voxel_to_world = _bound(Grids.voxel_to_world, 0)

    # -- topology
    merged_grid = _bound(topology.merged_grid, 0)
    pruned_grid = _bound(topology.pruned_grid, 0)
    clipped_grid = _bound(topology.clipped_grid, 0)
    clip = _bound(topology.clip, 0)
    dilated_grid = _bound(topology.dilated_grid, 0)
    padded_grid = _bound(topology.padded_grid, 0)
    dual_grid = _bound(topology.dual_grid, 0)
    coarsened_grid = _bound(topology.coarsened_grid, 0)
    refined_grid = _bound(topology.refined_grid, 0)
    conv_grid = _bound(topology.conv_grid, 0)
    conv_transpose_grid = _bound(topology.conv_transpose_grid, 0)
    edge_network = _bound(topology.edge_network, 0)

    def morton(self, offset=None) -> DataFrame:
        return topology.curve_codes(self.grids, "morton", offset)

    def morton_zyx(self, offset=None) -> DataFrame:
        return topology.curve_codes(self.grids, "morton_zyx", offset)

    def hilbert(self, offset=None) -> DataFrame:
        return topology.curve_codes(self.grids, "hilbert", offset)

    def hilbert_zyx(self, offset=None) -> DataFrame:
        return topology.curve_codes(self.grids, "hilbert_zyx", offset)

    # -- features
    def sample_trilinear(self, points: DataFrame, features: DataFrame, values=("f",), **named) -> DataFrame:
        return sample.sample(points, self.grids, features, values, "trilinear", **named)

    def sample_trilinear_with_grad(self, points: DataFrame, features: DataFrame, values=("f",), **named) -> DataFrame:
        return sample.sample(points, self.grids, features, values, "trilinear", True, **named)

    def sample_bezier(self, points: DataFrame, features: DataFrame, values=("f",), **named) -> DataFrame:
        return sample.sample(points, self.grids, features, values, "bezier", **named)

    def sample_bezier_with_grad(self, points: DataFrame, features: DataFrame, values=("f",), **named) -> DataFrame:
        return sample.sample(points, self.grids, features, values, "bezier", True, **named)

    def splat_trilinear(self, points: DataFrame, values=("f",)) -> DataFrame:
        return sample.splat(points, self.grids, values, "trilinear")

    def splat_bezier(self, points: DataFrame, values=("f",)) -> DataFrame:
        return sample.splat(points, self.grids, values, "bezier")

    sample_nearest = _bound(sample.sample_nearest, 1)
    max_pool = _bound(pool.max_pool, 0)
    avg_pool = _bound(pool.avg_pool, 0)
    refine = _bound(pool.refine, 0)
    inject_from = _bound(pool.inject, 0)
    inject_from_ijk = _bound(pool.inject_from_ijk, 0)
    inject_from_dense = _bound(pool.inject_from_dense, 0)

    def inject_to(self, dst: GridBatch, features: DataFrame, **named) -> DataFrame:
        return pool.inject(dst.grids, features, **named)

    def inject_to_dense(self, features: DataFrame, num_grids: int, low, size, values=("f",)) -> DataFrame:
        return pool.inject_to_dense(self.grids.meta.sparkSession, features, num_grids, low, size, values)

    def conv_plan(self, kernel, stride=1, target: GridBatch | None = None, transposed: bool = False, **options) -> ConvPlan:
        return ConvPlan.build(self.grids, kernel, stride, target.grids if target else None, transposed, **options)

    # -- rays and surfaces
    voxels_along_rays = _bound(rays.voxels_along_rays, 1)
    segments_along_rays = _bound(rays.segments_along_rays, 1)
    uniform_ray_samples = _bound(rays.uniform_ray_samples, 1)
    ray_implicit_intersection = _bound(rays.ray_implicit_intersection, 1)
    rays_intersect_voxels = _bound(rays.rays_intersect_voxels, 1)
    marching_cubes = _bound(mesh.marching_cubes, 0)
    integrate_tsdf = _bound(tsdf.integrate_tsdf, 0)
    reinitialize_sdf = _bound(sdf.reinitialize_sdf, 0)
    retopologize_sdf = _bound(sdf.retopologize_sdf, 0)


def _numbered(x):
    """Rows of a single grid as rows of grid 0."""
    if isinstance(x, DataFrame) and "grid_id" not in x.columns:
        return x.withColumn("grid_id", F.lit(0))
    return x


def _plain(x):
    """Rows of grid 0 without its number."""
    if isinstance(x, tuple):
        return tuple(map(_plain, x))
    return x.drop("grid_id") if isinstance(x, DataFrame) else x


def _single(function):
    """A method of a batch for a single grid: rows go in and come out without ``grid_id``."""

    def method(self, *args, **named):
        return _plain(function(self, *map(_numbered, args), **{k: _numbered(v) for k, v in named.items()}))

    method.__doc__, method.__name__ = function.__doc__, function.__name__
    return method


class Grid(GridBatch):
    """One grid, number 0 of its batch.  Its methods and properties take and give rows without ``grid_id``."""

    @classmethod
    def of(cls, batch: GridBatch, grid: int = 0) -> Grid:
        return cls(batch.grids.pick([grid]))

    def to_gridbatch(self) -> GridBatch:
        return GridBatch(self.grids)


def _twins() -> None:
    batch_only = {"of", "to_gridbatch", "from_cat", "load", "save", "pick", "__getitem__", "from_zero_grids", "serialize", "deserialize"}
    for name, member in vars(GridBatch).items():
        if name.startswith("_") or name in batch_only:
            continue
        if isinstance(member, property):
            setattr(Grid, name, property(_single(member.fget), doc=member.__doc__))
        elif isinstance(member, classmethod):
            setattr(Grid, name, classmethod(_single(member.__func__)))
        elif callable(member):
            setattr(Grid, name, _single(member))


_twins()


@dataclass(frozen=True)
class JaggedFrame:
    """Jagged lists: rows ``outer_idx, inner_idx, row_idx, v`` and, where empty lists matter, their ``shape``."""

    rows: DataFrame
    shape: DataFrame | None = None

    @classmethod
    def from_lists(cls, spark: SparkSession, lists: Sequence, depth: int = 1, kind: str = "double") -> JaggedFrame:
        sizes = [len(x) for x in lists] if depth == 1 else [[len(y) for y in x] for x in lists]
        return cls(jagged.from_lists(spark, lists, depth, kind), jagged.structure_of(spark, sizes, depth))

    @classmethod
    def filled(cls, shape: DataFrame, how: str = "zeros", seed: int = 0) -> JaggedFrame:
        return cls(jagged.filled(shape, how, seed), shape)

    def _like(self, rows: DataFrame) -> JaggedFrame:
        return JaggedFrame(rows, self.shape)

    def jsum(self) -> DataFrame:
        return jagged.jsum(self.rows, self.shape)

    def jmax(self) -> DataFrame:
        return jagged.jmax(self.rows, self.shape)

    def jmin(self) -> DataFrame:
        return jagged.jmin(self.rows, self.shape)

    def jargsort(self, descending: bool = False) -> DataFrame:
        return jagged.jargsort(self.rows, descending=descending)

    def _shape(self) -> DataFrame:
        return self.shape if self.shape is not None else jagged.structure(self.rows)

    def joffsets(self) -> DataFrame:
        return jagged.joffsets(self._shape())

    def jidx(self) -> DataFrame:
        return jagged.jidx(self.rows, self._shape())

    def sizes(self) -> DataFrame:
        return jagged.sizes(self._shape())

    def lshape(self) -> DataFrame:
        return jagged.lshape(self._shape())

    def rshape(self) -> DataFrame:
        return jagged.rshape(self.rows)

    def eshape(self) -> DataFrame:
        return jagged.eshape(self.rows)

    def jflatten(self, dim: int = 0) -> JaggedFrame:
        return JaggedFrame(jagged.jflatten(self.rows, dim))

    def jreshape(self, shape: DataFrame) -> JaggedFrame:
        return JaggedFrame(jagged.jreshape(self.rows, shape), shape)

    def jreshape_as(self, other: JaggedFrame) -> JaggedFrame:
        return self.jreshape(other.shape if other.shape is not None else jagged.structure(other.rows))

    def rmask(self, mask: DataFrame, keep: str = "keep") -> JaggedFrame:
        return self._like(jagged.rmask(self.rows, mask, keep))

    def unbind(self) -> DataFrame:
        return jagged.unbind(self.rows)

    def __getitem__(self, ids) -> JaggedFrame:
        if isinstance(ids, JaggedFrame):
            return JaggedFrame(jagged.jindex(self.rows, ids.rows))
        return JaggedFrame(jagged.jpick(self.rows, [ids] if isinstance(ids, int) else list(ids)))

    def map(self, name: str) -> JaggedFrame:
        """A named unary function of every value."""
        return self._like(self.rows.withColumn("v", elementwise.unary(name, F.col("v"))))

    def cast(self, kind: str) -> JaggedFrame:
        return self._like(jagged.cast(self.rows, kind))

    def int(self) -> JaggedFrame:
        return self.cast("int")

    def long(self) -> JaggedFrame:
        return self.cast("long")

    def float(self) -> JaggedFrame:
        return self.cast("float")

    def double(self) -> JaggedFrame:
        return self.cast("double")

    def bool(self) -> JaggedFrame:
        return self.cast("boolean")

    def round(self, decimals: int = 0) -> JaggedFrame:
        return self._like(self.rows.withColumn("v", elementwise.round_to(F.col("v"), decimals)))

    def clamp(self, low: float | None = None, high: float | None = None) -> JaggedFrame:
        return self._like(self.rows.withColumn("v", elementwise.clamp(F.col("v"), low, high)))

    def binary(self, name: str, other: JaggedFrame | float) -> JaggedFrame:
        """A named binary function with a number, or row by row with lists of the same structure."""
        if isinstance(other, JaggedFrame):
            return self._like(jagged.combine(self.rows, other.rows, elementwise.BINARY[name], strict=True))
        return self._like(self.rows.withColumn("v", elementwise.binary(name, F.col("v"), other)))

    def __add__(self, other):
        return self.binary("add", other)

    def __sub__(self, other):
        return self.binary("sub", other)

    def __mul__(self, other):
        return self.binary("mul", other)

    def __truediv__(self, other):
        return self.binary("true_divide", other)

    def __floordiv__(self, other):
        return self.binary("floor_divide", other)

    def __mod__(self, other):
        return self.binary("remainder", other)

    def __pow__(self, other):
        return self.binary("pow", other)

    def __neg__(self):
        return self.map("neg")

    def __abs__(self):
        return self.map("abs")


def jcat(parts: Sequence[JaggedFrame], dim: int | None = None) -> JaggedFrame:
    return JaggedFrame(jagged.jcat([p.rows for p in parts], dim))


def gcat(batches: Sequence[tuple[GridBatch, int]]) -> GridBatch:
    return GridBatch.from_cat(batches)
