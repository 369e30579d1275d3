"""Layers over voxel features: norms, activations, pooling and a small U-shaped network for inference."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.spatial import KEY

from .conv import ConvPlan
from .grids import Grids, check_columns
from .pool import avg_pool, inject, max_pool, refine
from .topology import dilated_grid


def group_norm(
    features: DataFrame, values: Sequence[str], groups: int, eps: float = 1e-5, weight: Sequence[float] | None = None,
    bias: Sequence[float] | None = None,
) -> DataFrame:
    """Each grid's groups of channels, shifted and scaled to mean 0 and variance 1 over voxels and channels.

    Moments are sums by grid, combined before the shuffle; rows learn them by one
    join on ``grid_id``.
    """
    n, size = len(values), len(values) // max(groups, 1)
    if groups < 1 or n % groups:
        raise ValueError("the channels must divide into the groups")
    check_columns(features, *KEY, *values)
    aggs = []
    for g in range(groups):
        own = [F.col(v) for v in values[g * size : (g + 1) * size]]
        aggs += [F.sum(sum(own, F.lit(0.0))).alias(f"_s{g}"), F.sum(sum((c * c for c in own), F.lit(0.0))).alias(f"_q{g}")]
    stats = features.groupBy("grid_id").agg(F.count("*").alias("_n"), *aggs)
    out = features.join(stats, "grid_id")
    cols = []
    for c, v in enumerate(values):
        g = c // size
        mean = F.col(f"_s{g}") / (F.col("_n") * size)
        var = F.col(f"_q{g}") / (F.col("_n") * size) - mean * mean
        x = (F.col(v) - mean) / F.sqrt(F.greatest(var, F.lit(0.0)) + eps)
        cols.append((x * float(weight[c] if weight else 1.0) + float(bias[c] if bias else 0.0)).alias(v))
    return out.select(*KEY, *cols)


def batch_norm(
    features: DataFrame, values: Sequence[str], eps: float = 1e-5, weight: Sequence[float] | None = None,
    bias: Sequence[float] | None = None, running: Sequence[tuple[float, float]] | None = None,
) -> DataFrame:
    """Each channel normalised over the whole batch, or by given running means and variances.

    On a cluster the moments are global by nature, so this is the synchronised form too.
    """
    check_columns(features, *KEY, *values)
    if running is None:
        aggs = [x for v in values for x in (F.avg(v).alias("_m" + v), F.var_pop(v).alias("_v" + v))]
        out = features.crossJoin(F.broadcast(features.agg(*aggs)))  # one row
        moments = {v: (F.col("_m" + v), F.col("_v" + v)) for v in values}
    else:
        out, moments = features, {v: (F.lit(m), F.lit(s)) for v, (m, s) in zip(values, running)}
    cols = []
    for c, v in enumerate(values):
        m, s = moments[v]
        x = (F.col(v) - m) / F.sqrt(s + eps)
        cols.append((x * float(weight[c] if weight else 1.0) + float(bias[c] if bias else 0.0)).alias(v))
    return out.select(*KEY, *cols)


def relu(features: DataFrame, values: Sequence[str]) -> DataFrame:
    return features.select(*KEY, *[F.greatest(v, F.lit(0.0)).alias(v) for v in values])


@dataclass(frozen=True)
class SparseConv3d:
    """A convolution layer: ``weights`` as ``tap, ci, co, w``."""

    weights: DataFrame
    kernel: tuple
    stride: tuple = (1, 1, 1)
    bias: tuple | None = None
    transposed: bool = False

    def __call__(self, g: Grids, x: DataFrame, values, out, target: Grids | None = None) -> tuple[Grids, DataFrame]:
        plan = ConvPlan.build(g, self.kernel, self.stride, target, self.transposed, keep=False)
        return plan.target, plan.execute(x, self.weights, values, out, self.bias)


@dataclass(frozen=True)
class WideConv3d:
    """A convolution layer over array channels: ``weights`` by tap, input and output channel."""

    weights: np.ndarray
    kernel: tuple
    stride: tuple = (1, 1, 1)
    bias: tuple | None = None
    transposed: bool = False

    def __call__(self, g: Grids, x: DataFrame, value: str = "x", out: str = "y", target: Grids | None = None) -> tuple[Grids, DataFrame]:
        plan = ConvPlan.build(g, self.kernel, self.stride, target, self.transposed, keep=False)
        return plan.target, plan.execute_arrays(x, self.weights, value, out, self.bias)


@dataclass(frozen=True)
class SimpleUNet:
    """Pad, convolve, pool, convolve, upsample, join the skipped features, convolve, drop the padding.

    ``down``, ``middle`` and ``up`` map ``width`` channels to ``width``; ``first`` maps the
    input's, ``last`` back from them.  Inference only.
    """

    first: SparseConv3d
    down: SparseConv3d
    middle: SparseConv3d
    up: SparseConv3d
    last: SparseConv3d
    width: int
    pad: int = 1

    def __call__(self, g: Grids, x: DataFrame, values: Sequence[str], out: Sequence[str]) -> DataFrame:
        names = [f"h{c}" for c in range(self.width)]
        wide = dilated_grid(g, self.pad)
        h = inject(wide, x, values=values)
        _, h = self.first(wide, h, values, names, wide)
        h = relu(batch_norm(h, names), names)
        _, skip = self.down(wide, h, names, names, wide)
        skip = relu(skip, names)
        half, low = max_pool(wide, skip, 2, values=names)
        _, low = self.middle(half, low, names, names, half)
        _, back = refine(half, relu(low, names), 2, fine=wide, values=names)
        both = skip.join(back.select(*KEY, *[F.col(n).alias("b" + n) for n in names]), KEY)
        both = both.select(*KEY, *[(F.col(n) + F.col("b" + n)).alias(n) for n in names])
        _, h = self.up(wide, both, names, names, wide)
        _, y = self.last(wide, relu(h, names), names, out, wide)
        return y.join(g.voxels, KEY, "left_semi")


__all__ = ["SimpleUNet", "SparseConv3d", "WideConv3d", "avg_pool", "batch_norm", "group_norm", "max_pool", "refine", "relu"]
