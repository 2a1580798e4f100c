"""Column functions over vectors (arrays of numbers), computed in double from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least norm, least scales of symmetric and asymmetric codes, floor and bounds of smoothing scales.
NORM_EPS = 1e-12
SYMMETRIC_EPS = 1e-12
ROW_EPS = 1e-10
SMOOTH_FLOOR, SMOOTH_LEAST, SMOOTH_MOST = 1e-5, 1e-2, 1e2


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """``v`` over its length, a zero vector unchanged."""
    return _with(F.greatest(norm(v), F.lit(NORM_EPS)), lambda n: F.transform(doubles(v), lambda x: x / n))


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row: the only element of an array that is transformed."""
    return F.element_at(F.transform(F.array(value), use), 1)


def abs_max(v: Column) -> Column:
    return F.array_max(F.transform(doubles(v), lambda x: F.abs(x)))


def symmetric_scale(v: Column) -> Column:
    return F.greatest(abs_max(v) / 127, F.lit(SYMMETRIC_EPS))


def symmetric_codes(v: Column, scale: Column) -> Column:
    """Codes from -127 to 127, halves rounded to even."""
    return F.transform(doubles(v), lambda x: F.greatest(F.least(F.rint(x / scale), F.lit(127.0)), F.lit(-127.0)).cast("int"))


def row_range(v: Column) -> tuple[Column, Column]:
    """(smallest, largest) with 0 among the values."""
    return F.least(F.array_min(doubles(v)), F.lit(0.0)), F.greatest(F.array_max(doubles(v)), F.lit(0.0))


def asymmetric_scale(v: Column) -> Column:
    low, high = row_range(v)
    return F.greatest((high - low) / 255, F.lit(ROW_EPS))


def zero_point(v: Column, scale: Column) -> Column:
    return F.rint(-row_range(v)[0] / scale).cast("int")


def asymmetric_codes(v: Column, scale: Column, zero: Column) -> Column:
    """Unsigned codes from 0 to 255, halves rounded to even and then saturated."""
    return F.transform(doubles(v), lambda x: F.greatest(F.least(F.rint(x / scale) + zero, F.lit(255.0)), F.lit(0.0)).cast("int"))


def row_symmetric_scale(v: Column) -> Column:
    """The scale of unsigned codes around a zero point of 128."""
    return F.greatest(abs_max(v) / 127, F.lit(ROW_EPS))


def dequantized(codes: Column, scale: Column, zero: Column | int = 0) -> Column:
    return F.transform(codes, lambda q: (q - zero) * scale)


def smoothing_scale(x_max: Column, w_max: Column, alpha: float = 0.5) -> Column:
    """x_max^alpha / w_max^(1 - alpha), both floored, within bounds."""
    a = F.pow(F.greatest(x_max, F.lit(SMOOTH_FLOOR)), F.lit(alpha))
    b = F.pow(F.greatest(w_max, F.lit(SMOOTH_FLOOR)), F.lit(1 - alpha))
    return F.least(F.greatest(a / b, F.lit(SMOOTH_LEAST)), F.lit(SMOOTH_MOST))


def hybrid(dense: Column, sparse: Column, colbert: Column, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[Column, Column]:
    """(sparse with dense, all three), each averaged by its weights; the order of weights is dense, sparse, colbert."""
    if len(weights) != 3:
        raise ValueError("three weights are needed: dense, sparse, colbert")
    d, s, c = weights
    return (sparse * s + dense * d) / (d + s), (colbert * c + sparse * s + dense * d) / (d + s + c)


def zero_point_product(product: Column, column_sum: Column, scale: Column, weight_scale: Column, zero: Column) -> Column:
    """A product of shifted codes in real numbers: the zero point's share, itself times the sum of the weights' codes, is taken off."""
    return scale * weight_scale * (product - zero * column_sum)
