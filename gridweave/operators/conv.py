"""Sparse convolution as a relation of edges between input and output voxels."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.spatial import IJK, KEY, floor_div, triple, with_box

from .grids import Grids, check_columns
from .topology import conv_grid, conv_pad, conv_transpose_grid

#: The most weights that go to every task; they don't grow with the grids, only with kernel and channels.
BROADCAST_WEIGHTS = 1 << 23
#: Channel pairs that may be columns, and targets whose arrays are multiplied at once.
MOST_PAIRS, ROWS = 64, 1024


def edges(source: Grids, target: Grids, kernel, stride=1, transposed: bool = False) -> DataFrame:
    """The pairs of active voxels with fine = stride * coarse + tap - pad.

    Forward, the source is fine and the target coarse; transposed, the other way
    round.  Columns: ``grid_id``, ``tap`` (x-major), source ``si, sj, sk``, target
    ``di, dj, dk``.
    """
    k, s = triple(kernel), triple(stride)
    pad = conv_pad(k)
    t = with_box(target.voxels, (0, 0, 0), [n - 1 for n in k], ("ti", "tj", "tk"))
    if transposed:  # coarse source = (fine target + pad - tap) / stride, where it divides
        own = {a: F.col(a) + p - F.col("t" + a) for a, p in zip(IJK, pad)}
        for a, n in zip(IJK, s):
            t = t.where(F.pmod(own[a], F.lit(n)) == 0)
        at = {"s" + a: floor_div(own[a], n) for a, n in zip(IJK, s)}
    else:
        at = {"s" + a: F.col(a) * n + F.col("t" + a) - p for a, n, p in zip(IJK, s, pad)}
    t = t.select("grid_id", "tap", *[c.alias(n) for n, c in at.items()], *[F.col(a).alias("d" + a) for a in IJK])
    return t.join(source.voxels.select("grid_id", *[F.col(a).alias("s" + a) for a in IJK]), ["grid_id", "si", "sj", "sk"], "left_semi")


def reversed_edges(e: DataFrame) -> DataFrame:
    """The same edges with source and target exchanged."""
    return e.select("grid_id", "tap", *[F.col("d" + a).alias("s" + a) for a in IJK], *[F.col("s" + a).alias("d" + a) for a in IJK])


def apply_edges(e: DataFrame, features: DataFrame, weights: DataFrame, values: Sequence[str], out: Sequence[str]) -> DataFrame:
    """Weighted sums along edges: ``weights`` has ``tap, ci, co, w``; input and output channels are columns.

    An edge meets its tap's weights as one row with a column for each pair of
    channels, so the join adds no rows, and sums are combined before the shuffle.  For
    more than a few channels keep them in arrays (``apply_edges_arrays``).
    """
    check_columns(weights, "tap", "ci", "co", "w")
    if len(values) * len(out) > MOST_PAIRS:
        raise ValueError(f"{len(values)} by {len(out)} channels as columns; keep them in arrays")
    pairs = [(a, b) for a in range(len(values)) for b in range(len(out))]
    row = weights.groupBy("tap").agg(
        *[F.coalesce(F.sum(F.when((F.col("ci") == a) & (F.col("co") == b), F.col("w"))), F.lit(0.0)).alias(f"w{a}_{b}") for a, b in pairs]
    )
    f = check_columns(features, *KEY, *values).select("grid_id", *[F.col(a).alias("s" + a) for a in IJK], *[F.col(v).alias(f"x{n}") for n, v in enumerate(values)])
    # one row a tap, of at most MOST_PAIRS weights
    j = e.join(f, ["grid_id", "si", "sj", "sk"]).join(F.broadcast(row), "tap")
    sums = [F.sum(sum(F.col(f"w{a}_{b}") * F.col(f"x{a}") for a in range(len(values)))).alias(o) for b, o in enumerate(out)]
    return j.groupBy("grid_id", *["d" + a for a in IJK]).agg(*sums).select("grid_id", *[F.col("d" + a).alias(a) for a in IJK], *out)


def weight_array(weights: DataFrame | np.ndarray, taps: int) -> np.ndarray:
    """Weights by tap, input and output channel, on the driver: given so, or as rows ``tap, ci, co, w``."""
    if isinstance(weights, np.ndarray):
        w = np.asarray(weights, np.float64)
    else:
        rows = check_columns(weights, "tap", "ci", "co", "w").select("tap", "ci", "co", "w").limit(BROADCAST_WEIGHTS + 1).toArrow()
        tap, ci, co, x = (rows.column(c).to_numpy() for c in ("tap", "ci", "co", "w"))
        if len(x) > BROADCAST_WEIGHTS:
            raise ValueError(f"more than {BROADCAST_WEIGHTS} weights")
        w = np.zeros((taps, int(ci.max(initial=0)) + 1, int(co.max(initial=0)) + 1))
        np.add.at(w, (tap, ci, co), x)
    if w.ndim != 3 or w.shape[0] != taps:
        raise ValueError(f"weights of {taps} taps are needed, not of shape {w.shape}")
    if w.size > BROADCAST_WEIGHTS:
        raise ValueError(f"{w.size} weights; at most {BROADCAST_WEIGHTS} go to every task")
    return w


def _channels(column: pa.Array, width: int) -> np.ndarray:
    """Arrays of ``width`` numbers as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != width * len(column):
        raise ValueError(f"{width} channels are needed in every row")
    return flat.reshape(len(column), width)


def apply_edges_arrays(e: DataFrame, features: DataFrame, weights: np.ndarray, value: str = "x", out: str = "y") -> DataFrame:
    """Weighted sums along edges; channels are the elements of array columns.

    Every target gathers its sources' arrays (at most one a tap) in one grouped
    aggregate, and batches of targets are multiplied tap by tap as matrices.
    """
    taps, width, depth = weights.shape
    f = check_columns(features, *KEY, value).select("grid_id", *[F.col(a).alias("s" + a) for a in IJK], F.col(value).cast("array<double>").alias("_x"))
    j = e.join(f, ["grid_id", "si", "sj", "sk"])
    per = j.groupBy("grid_id", *["d" + a for a in IJK]).agg(F.collect_list(F.struct("tap", "_x")).alias("_l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), ROWS):
                b = whole.slice(at, ROWS)
                lists = b.column("_l")
                flat, n = lists.flatten(), lists.value_lengths().to_numpy()
                row, tap = np.repeat(np.arange(b.num_rows), n), flat.field(0).to_numpy()
                x, total = _channels(flat.field(1), width), np.zeros((b.num_rows, depth))
                for t in range(taps):
                    own = np.flatnonzero(tap == t)
                    total[row[own]] += x[own] @ weights[t]
                sums = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * depth, pa.int32()), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("grid_id", "di", "dj", "dk")), sums], [*KEY, out])

    return per.mapInArrow(run, f"grid_id int, i int, j int, k int, {out} array<double>")


def weight_gradient_arrays(e: DataFrame, features: DataFrame, grads: DataFrame, value: str = "x", grad: str = "y") -> DataFrame:
    """Gradient by the weights for array channels: ``tap``, ``ci``, ``co``, ``w``.

    Each task multiplies its edges' arrays tap by tap and adds them up, so what is
    shuffled is one set of weights a task.
    """
    f = features.select("grid_id", *[F.col(a).alias("s" + a) for a in IJK], F.col(value).cast("array<double>").alias("_x"))
    g = grads.select("grid_id", *[F.col(a).alias("d" + a) for a in IJK], F.col(grad).cast("array<double>").alias("_y"))
    j = e.join(f, ["grid_id", "si", "sj", "sk"]).join(g, ["grid_id", "di", "dj", "dk"]).select("tap", "_x", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            tap = b.column("tap").to_numpy()
            x, y = (_channels(c, len(c[0])) for c in (b.column("_x"), b.column("_y")))
            for t in np.unique(tap).tolist():
                own = tap == t
                sums[t] = sums.get(t, 0) + x[own].T @ y[own]
        for t, w in sums.items():
            ci, co = np.indices(w.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(w.size, t, np.int32)), pa.array(ci.astype(np.int32)), pa.array(co.astype(np.int32)), pa.array(w.ravel())], ["tap", "ci", "co", "w"])

    return j.mapInArrow(run, "tap int, ci int, co int, w double").groupBy("tap", "ci", "co").agg(F.sum("w").alias("w"))


def weight_gradient(e: DataFrame, features: DataFrame, grads: DataFrame, values: Sequence[str], out: Sequence[str]) -> DataFrame:
    """Gradient by the weights: ``tap, ci, co, w``, sums over edges of input times output gradient."""
    f = features.select("grid_id", *[F.col(a).alias("s" + a) for a in IJK], *[F.col(v).alias(f"x{n}") for n, v in enumerate(values)])
    g = grads.select("grid_id", *[F.col(a).alias("d" + a) for a in IJK], *[F.col(v).alias(f"y{n}") for n, v in enumerate(out)])
    j = e.join(f, ["grid_id", "si", "sj", "sk"]).join(g, ["grid_id", "di", "dj", "dk"])
    pairs = [(a, b) for a in range(len(values)) for b in range(len(out))]
    sums = j.groupBy("tap").agg(*[F.sum(F.col(f"x{a}") * F.col(f"y{b}")).alias(f"w{a}_{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("ci"), F.lit(b).alias("co"), F.col(f"w{a}_{b}").alias("w")) for a, b in pairs])
    return sums.select("tap", F.inline(rows))


COMPLETE, RESTRICTED = "complete", "restricted"


def uncovered_axes(kernel: tuple, stride: tuple) -> list[int]:
    """Axes on which some fine coordinates meet no tap, whatever is active: the taps leave out remainders by the stride."""
    pad = conv_pad(kernel)
    return [a for a in range(3) if len({(t - pad[a]) % stride[a] for t in range(kernel[a])}) < stride[a]]


@dataclass(frozen=True)
class ConvPlan:
    """A source, a target, and the edges between them, kept for use with many features.

    Kept edges are released by ``release`` or at the end of a ``with`` block.
    """

    source: Grids
    target: Grids
    kernel: tuple
    stride: tuple
    transposed: bool
    edges: DataFrame
    policy: str = COMPLETE
    channel_pairs: tuple = ()

    @classmethod
    def build(
        cls, source: Grids, kernel, stride=1, target: Grids | None = None, transposed: bool = False, keep: bool = True, policy: str | None = None,
        strict: bool = False, acknowledged: bool = False, channel_pairs: Sequence[tuple[int, int]] = (),
    ) -> ConvPlan:
        """Forward or transposed; without a target, the complete one: all voxels an edge can reach.

        ``policy`` says which is meant (``complete`` without a target, ``restricted`` with
        one).  ``strict`` refuses targets with voxels that no edge reaches.  Kernels
        smaller than the stride leave out coordinates, which is warned of unless
        ``acknowledged``.  ``channel_pairs`` lists the channel counts the plan is for; none
        means any.
        """
        k, s = triple(kernel), triple(stride)
        if min(k) < 1 or min(s) < 1:
            raise ValueError("kernel and stride must be positive")
        inferred = COMPLETE if target is None else RESTRICTED
        if policy not in (None, COMPLETE, RESTRICTED):
            raise ValueError(f"unknown policy {policy!r}")
        if policy is not None and policy != inferred:
            raise ValueError("a complete plan has no target of its own, a restricted one needs a target")
        if any(min(pair) < 1 for pair in channel_pairs):
            raise ValueError("channel counts must be positive")
        left_out = uncovered_axes(k, s)
        if left_out and not acknowledged:
            warnings.warn(f"taps leave out remainders by the stride on axes {left_out}; some voxels may have no edge", stacklevel=2)
        if target is None:
            target = (conv_transpose_grid if transposed else conv_grid)(source, k, s)
        elif target.shared is not None and source.shared is not None:
            want = tuple(w / n if transposed else w * n for w, n in zip(source.shared[0], s))
            if any(abs(a - b) > 1e-9 * abs(a) for a, b in zip(want, target.shared[0])) or target.shared[1] != source.shared[1]:
                raise ValueError(f"the target's transform should be {want} at {source.shared[1]}")
        e = edges(source, target, k, s, transposed)
        plan = cls(source, target, k, s, transposed, e.persist() if keep else e, inferred, tuple(map(tuple, channel_pairs)))
        if strict:
            bare = plan.target.voxels.join(e.select("grid_id", *[F.col("d" + a).alias(a) for a in IJK]), KEY, "left_anti").count()
            if bare:
                plan.release()
                raise ValueError(f"{bare} target voxels have no edge")
        return plan

    def release(self) -> None:
        """Let go of kept edges."""
        self.edges.unpersist()

    def __enter__(self) -> ConvPlan:
        return self

    def __exit__(self, *exc) -> None:
        self.release()

    def valid_usage(self, in_channels: int, out_channels: int, kernel, stride, transposed: bool) -> bool:
        """Whether the plan is for such a convolution."""
        pair = not self.channel_pairs or (in_channels, out_channels) in self.channel_pairs
        return pair and triple(kernel) == self.kernel and triple(stride) == self.stride and transposed == self.transposed

    def reverse(self) -> ConvPlan:
        """The plan of the transposed convolution over the same edges: source and target, and channel pairs, exchanged."""
        pairs = tuple((b, a) for a, b in self.channel_pairs)
        return ConvPlan(self.target, self.source, self.kernel, self.stride, not self.transposed, reversed_edges(self.edges), RESTRICTED, pairs)

    def _check_channels(self, in_channels: int, out_channels: int) -> None:
        if self.channel_pairs and (in_channels, out_channels) not in self.channel_pairs:
            raise ValueError(f"the plan is not for {in_channels} to {out_channels} channels")

    def execute(self, features: DataFrame, weights: DataFrame, values=("f",), out=("f",), bias: Sequence[float] | None = None) -> DataFrame:
        """The convolution at every target voxel; without edges 0, or the bias."""
        self._check_channels(len(values), len(out))
        got = apply_edges(self.edges, features, weights, values, out)
        full = self.target.voxels.join(got, KEY, "left")
        bias = bias or [0.0] * len(out)
        return full.select(*KEY, *[(F.coalesce(o, F.lit(0.0)) + F.lit(float(b))).alias(o) for o, b in zip(out, bias)])

    def execute_arrays(self, features: DataFrame, weights: DataFrame | np.ndarray, value: str = "x", out: str = "y", bias: Sequence[float] | None = None) -> DataFrame:
        """The same with the channels as elements of array columns; ``weights`` by tap, input and output channel."""
        w = weight_array(weights, math.prod(self.kernel))
        self._check_channels(*w.shape[1:])
        got = apply_edges_arrays(self.edges, features, w, value, out)
        full = self.target.voxels.join(got, KEY, "left")
        none = F.array_repeat(F.lit(0.0), w.shape[2])
        y = F.coalesce(out, none)
        if bias is not None:
            y = F.zip_with(y, F.array(*[F.lit(float(b)) for b in bias]), lambda a, b: a + b)
        return full.select(*KEY, y.alias(out))

    def input_gradient_arrays(self, grads: DataFrame, weights: DataFrame | np.ndarray, value: str = "y", out: str = "x") -> DataFrame:
        """Gradient by the inputs: the reversed edges with weights transposed."""
        w = weight_array(weights, math.prod(self.kernel))
        return self.reverse().execute_arrays(grads, w.transpose(0, 2, 1).copy(), value, out)

    def weight_gradient_arrays(self, features: DataFrame, grads: DataFrame, value: str = "x", grad: str = "y") -> DataFrame:
        return weight_gradient_arrays(self.edges, features, grads, value, grad)

    def input_gradient(self, grads: DataFrame, weights: DataFrame, values=("f",), out=("f",)) -> DataFrame:
        """Gradient by the inputs: the reversed edges with weights transposed."""
        turned = weights.select("tap", F.col("co").alias("ci"), F.col("ci").alias("co"), "w")
        return self.reverse().execute(grads, turned, out, values)

    def weight_gradient(self, features: DataFrame, grads: DataFrame, values=("f",), out=("f",)) -> DataFrame:
        return weight_gradient(self.edges, features, grads, values, out)

    def coverage(self) -> DataFrame:
        """How many voxels of each side have how many edges: ``side``, ``degree``, ``n``."""
        parts = []
        for side, grid, p in (("input", self.source, "s"), ("output", self.target, "d")):
            n = self.edges.groupBy("grid_id", *[F.col(p + a).alias(a) for a in IJK]).agg(F.count("*").alias("degree"))
            full = grid.voxels.join(n, KEY, "left").select(F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
            parts.append(full.groupBy("degree").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "degree", "n"))
        return parts[0].union(parts[1])


def linear(features: DataFrame, matrix: Sequence[Sequence[float]], values: Sequence[str], out: Sequence[str], bias=None) -> DataFrame:
    """A linear map of each row's channels: the 1x1x1 convolution, as a projection."""
    bias = bias or [0.0] * len(out)
    cols = [sum((F.col(v) * float(w) for v, w in zip(values, row)), F.lit(float(b))).alias(o) for row, b, o in zip(matrix, bias, out)]
    return check_columns(features, *KEY, *values).select(*KEY, *cols)
