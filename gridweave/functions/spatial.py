"""Column expressions of sparse voxel geometry: keys, rounding, offsets and space-filling curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What identifies a voxel.
KEY = ["grid_id", "i", "j", "k"]
IJK = ["i", "j", "k"]
TRANSFORM = ["sx", "sy", "sz", "ox", "oy", "oz"]
#: Bits per axis of a curve code.
CURVE_BITS = 21

Triple = Sequence[float] | float


def triple(x: Triple) -> tuple:
    """Three values from one or three."""
    out = tuple(x) if isinstance(x, (list, tuple)) else (x, x, x)
    if len(out) != 3:
        raise ValueError(f"one or three values are needed, not {len(out)}")
    return out


def nearest(x: Column) -> Column:
    """The nearest whole number; halves go up on both sides of zero."""
    return F.floor(x + 0.5).cast("int")


def floor_div(x: Column, by: int) -> Column:
    """Whole-number division that rounds down for negative numbers too."""
    return F.floor(x / F.lit(by)).cast("int") if by != 1 else x.cast("int")


def settle(x: Column, digits: int = 6) -> Column:
    """A sum rounded so that the order of addition doesn't show; never minus zero."""
    return F.when(F.abs(x) < 0.5 * 10.0**-digits, F.lit(0.0)).otherwise(F.round(x, digits))


def box_size(low: Sequence[int], high: Sequence[int]) -> tuple[int, int, int]:
    return tuple(h - a + 1 for a, h in zip(low, high))


def with_box(df: DataFrame, low: Sequence[int], high: Sequence[int], names=("di", "dj", "dk"), tap: str = "tap") -> DataFrame:
    """One row for each offset of the box ``low..high`` (inclusive), numbered in x-major order by ``tap``."""
    nx, ny, nz = box_size(low, high)
    if min(nx, ny, nz) < 1:
        raise ValueError("an empty box")
    out = df.withColumn(tap, F.explode(F.sequence(F.lit(0), F.lit(nx * ny * nz - 1))))
    at = F.col(tap)
    return out.withColumns({
        names[0]: F.floor(at / (ny * nz)).cast("int") + low[0],
        names[1]: F.floor(at / nz).cast("int") % ny + low[1],
        names[2]: at % nz + low[2],
    })


def _spread(x: Column) -> Column:
    """The low 21 bits of a number, two zero bits between neighbours."""
    x = x.cast("long").bitwiseAND(F.lit((1 << CURVE_BITS) - 1))
    # Shifts and masks of the usual bit-spreading cascade.
    for shift, mask in (
        (32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249),
    ):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(i: Column, j: Column, k: Column) -> Column:
    """Bits of i, j and k interleaved, i lowest; 0 to 2**21 - 1 on each axis."""
    return _spread(i).bitwiseOR(F.shiftleft(_spread(j), 1)).bitwiseOR(F.shiftleft(_spread(k), 2))


def hilbert(i: str, j: str, k: str) -> Column:
    """Index on the Hilbert curve of three columns (SQL expressions), 0 to 2**21 - 1 each.

    Skilling's transform, as a fold over the bits from the top: where a
    coordinate has the bit, the first one's lower bits are inverted, else they
    are swapped with its own.  The transposed Gray code is then interleaved and
    decoded by a prefix of exclusive ors.
    """
    def step(state: str, axis: str) -> str:
        low = "(shiftleft(1L, p) - 1L)"
        if axis == "a":
            return f"transform(array({state}), s -> named_struct('a', IF(shiftright(s.a, p) & 1L = 1L, s.a ^ {low}, s.a), 'b', s.b, 'c', s.c))[0]"
        swap = f"((s.a ^ s.{axis}) & {low})"
        has = f"shiftright(s.{axis}, p) & 1L = 1L"
        fields = {"a": f"IF({has}, s.a ^ {low}, s.a ^ {swap})", axis: f"IF({has}, s.{axis}, s.{axis} ^ {swap})"}
        body = ", ".join(f"'{x}', {fields.get(x, f's.{x}')}" for x in "abc")
        return f"transform(array({state}), s -> named_struct({body}))[0]"

    state = "s0"
    for axis in "abc":
        state = step(state, axis)
    top = CURVE_BITS - 1
    start = f"named_struct('a', cast({i} AS bigint), 'b', cast({j} AS bigint), 'c', cast({k} AS bigint))"
    bits = "array(shiftright(s.a, p) & 1L, shiftright(s.b, p) & 1L, shiftright(s.c, p) & 1L)"
    gray = f"flatten(transform(sequence({top}, 0, -1), p -> {bits}))"
    decode = (
        f"aggregate({gray}, named_struct('v', 0L, 'x', 0L), "
        "(g, b) -> named_struct('v', shiftleft(g.v, 1) | (g.x ^ b), 'x', g.x ^ b), g -> g.v)"
    )
    return F.expr(f"aggregate(sequence({top}, 0, -1), {start}, (s0, p) -> {state}, s -> {decode})")
