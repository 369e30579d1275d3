"""Elementwise functions and reductions over feature arrays, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def erf(x: Column) -> Column:
    """The error function, to 1e-14: a series for small arguments, a continued fraction for others."""
    a, x2 = F.abs(x), x * x
    series = F.lit(0.0)
    for n in range(40, 0, -1):  # sum of (2 x^2)^n / (1*3*...*(2n+1))
        series = (series + 1.0) * (2 * x2 / (2 * n + 1))
    small = 2 / 3.141592653589793**0.5 * x * F.exp(-x2) * (1 + series)
    frac = a
    for n in range(60, 0, -1):
        frac = a + (n / 2.0) / frac
    large = F.signum(x) * (1 - F.exp(-x2) / (frac * 3.141592653589793**0.5))
    return F.when(a < 2.5, small).when(a > 6.0, F.signum(x)).otherwise(large)


UNARY = {
    "abs": F.abs,
    "neg": lambda x: -x,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "tanh": F.tanh,
    "silu": lambda x: x / (1 + F.exp(-x)),
    "gelu": lambda x: 0.5 * x * (1 + erf(x / 2**0.5)),
    "exp": F.exp,
    "expm1": F.expm1,
    "log": lambda x: F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(NAN)),
    "log1p": lambda x: F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(float("-inf"))).otherwise(F.lit(NAN)),
    "sqrt": F.sqrt,
    "rsqrt": lambda x: F.when(x == 0, F.lit(float("inf"))).otherwise(1 / F.sqrt(F.when(x != 0, x))),
    "floor": lambda x: F.floor(x).cast("double"),
    "ceil": lambda x: F.ceil(x).cast("double"),
    "trunc": lambda x: F.signum(x) * F.floor(F.abs(x)),
}


def unary(name: str, x: Column) -> Column:
    return UNARY[name](x)


def round_to(x: Column, decimals: int = 0) -> Column:
    """Rounding with halves to even."""
    return F.bround(x, decimals)


def nan_to_num(x: Column, nan: float = 0.0, posinf: float = 1.7976931348623157e308, neginf: float = -1.7976931348623157e308) -> Column:
    x = F.when(F.isnan(x), F.lit(nan)).otherwise(x)
    return F.when(x == float("inf"), F.lit(posinf)).when(x == float("-inf"), F.lit(neginf)).otherwise(x)


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Between bounds; NaN stays."""
    out = x
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when((out > high) & ~F.isnan(out), F.lit(high)).otherwise(out)
    return out


def _divided(a: Column, b: Column) -> Column:
    """Division by the rules of floating point: by zero it gives an infinity or NaN."""
    zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(F.signum(a) * float("inf"))
    return F.when(b == 0, zero).otherwise(a / F.when(b != 0, b))


def _floor(x: Column) -> Column:
    finite = ~F.isnan(x) & (F.abs(x) < 9e15)
    return F.when(finite, F.floor(F.when(finite, x)).cast("double")).otherwise(x)


def minimum(a: Column, b: Column) -> Column:
    """The smaller; NaN if either is."""
    return F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).otherwise(F.least(a, b))


BINARY = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "true_divide": _divided,
    "floor_divide": lambda a, b: _floor(_divided(a, b)),
    "remainder": lambda a, b: F.when(b == 0, F.lit(NAN)).otherwise(a - b * _floor(a / F.when(b != 0, b))),
    "fmod": lambda a, b: F.when(b == 0, F.lit(NAN)).otherwise(a % F.when(b != 0, b)),
    "pow": F.pow,
    "maximum": F.greatest,  # NaN counts as largest
    "minimum": minimum,
    "fmax": lambda a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b)),
    "fmin": F.least,  # NaN counts as largest, so the other is taken
    "eq": lambda a, b: (a == b) & ~F.isnan(a),
    "ne": lambda a, b: (a != b) | F.isnan(a),
    "lt": lambda a, b: (a < b) & ~F.isnan(b),
    "le": lambda a, b: (a <= b) & ~F.isnan(b),
    "gt": lambda a, b: (a > b) & ~F.isnan(a),
    "ge": lambda a, b: (a >= b) & ~F.isnan(a),
}


def binary(name: str, a, b) -> Column:
    return BINARY[name](_c(a), _c(b))


def where(test: Column, a, b) -> Column:
    return F.when(test, _c(a)).otherwise(_c(b))


def lerp(a, b, weight) -> Column:
    return _c(a) + (_c(b) - _c(a)) * _c(weight)


def _fold(x: Column, start: float, step) -> Column:
    return F.aggregate(x, F.lit(start), step)


def _spread(x: Column, unbiased: bool) -> Column:
    mean = _fold(x, 0.0, lambda s, v: s + v) / F.size(x)
    squares = F.aggregate(F.transform(x, lambda v: (v - mean) * (v - mean)), F.lit(0.0), lambda s, v: s + v)
    return squares / (F.size(x) - (1 if unbiased else 0))


#: Over the feature axis: one value from each array.
REDUCE = {
    "sum": lambda x: _fold(x, 0.0, lambda s, v: s + v),
    "prod": lambda x: _fold(x, 1.0, lambda s, v: s * v),
    "mean": lambda x: _fold(x, 0.0, lambda s, v: s + v) / F.size(x),
    "amax": F.array_max,
    "amin": F.array_min,
    "argmax": lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("long"),
    "argmin": lambda x: (F.array_position(x, F.array_min(x)) - 1).cast("long"),
    "all": lambda x: F.forall(x, lambda v: v != 0),
    "any": lambda x: F.exists(x, lambda v: v != 0),
    "norm": lambda x: F.sqrt(_fold(x, 0.0, lambda s, v: s + v * v)),
    "var": lambda x: _spread(x, True),
    "std": lambda x: F.sqrt(_spread(x, True)),
}


def reduce_features(name: str, x: Column) -> Column:
    return REDUCE[name](x)


def map_features(name: str, x: Column) -> Column:
    """A unary function of each element of an array."""
    return F.transform(x, UNARY[name])


def zip_features(name: str, a: Column, b: Column) -> Column:
    """A binary function of the elements of two arrays."""
    return F.zip_with(a, b, BINARY[name])
