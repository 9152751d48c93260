"""Column expressions over vectors (``ARRAY<FLOAT|DOUBLE>``), accumulated in DOUBLE from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def inner_product(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))))


def scaled(v: Column, factor: Column) -> Column:
    return F.transform(as_double(v), lambda x: x * factor)


#: Spacing of half-precision values by binary exponent, from the subnormals' -14 up to 15.
_HALF_STEPS = [2.0 ** (exponent - 10) for exponent in range(-14, 16)]


def _half_step(x: Column) -> Column:
    exponent = F.least(F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)), F.lit(15))
    return F.get(F.lit(_HALF_STEPS).cast("array<double>"), (exponent + 14).cast("int"))


def _on_grid(x: Column, step: Column) -> Column:
    return (
        F.when(F.isnan(x) | (x == 0), x)
        .when(F.abs(x) >= 65520.0, F.when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
        .otherwise(F.rint(x / step) * step)
    )


def half(x: Column) -> Column:
    """A DOUBLE rounded to the nearest IEEE half-precision value, ties to even.

    Magnitudes from 65520 on round to infinity.
    """
    return _on_grid(x, _half_step(x))


def to_half(v: Column) -> Column:
    """Each component rounded to half precision, stored in FLOAT (Spark SQL has no half type)."""
    return F.transform(v, lambda x: half(x.cast("double")).cast("float"))
