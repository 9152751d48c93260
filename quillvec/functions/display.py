"""Display columns: sizes, marks, number formats and the table rounding rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB = 1024.0


def bytes_to_gb(size: Column) -> Column:
    return size / F.lit(KB**3)


def seconds_to_minutes(seconds: Column) -> Column:
    return seconds / F.lit(60.0)


def human_size(size: Column) -> Column:
    def scaled(unit: float, name: str) -> Column:
        return F.concat(fixed(size / F.lit(unit), 2), F.lit(f" {name}"))

    return (
        F.when(size < KB, F.format_string("%d bytes", size))
        .when(size < KB**2, scaled(KB, "KB"))
        .when(size < KB**3, scaled(KB**2, "MB"))
        .otherwise(scaled(KB**3, "GB"))
    )


def expected_mark(total: Column, expected: Column | int) -> Column:
    return F.when(total == expected, F.lit("✓")).otherwise(F.lit("✗"))


def thousands(count: Column) -> Column:
    return F.format_string("%,d", count)


def fixed(value: Column, places: int) -> Column:
    """A number with ``places`` decimals, exact ties to even.

    Nine decimals are kept before rounding, so that the order in which a mean was summed does
    not decide a tie.
    """
    exact = value.try_cast("decimal(38,9)")
    return F.coalesce(F.bround(exact, places).cast("string"), value.cast("string"))


def round_half_even(value: Column, places: int = 4) -> Column:
    return F.bround(value, places)
