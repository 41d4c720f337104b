"""Clamping, rounding and formatting of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r4(x: Column) -> Column:
    """Rounded to four decimals, halves upwards."""
    return F.floor(x * 10000.0 + 0.5).cast("double") / 10000.0


def settled(x: Column) -> Column:
    """For figures that two engines add up in different orders: what ends in 5 but for the last bits goes up in both."""
    return F.floor(x * 10000.0 + 0.500001).cast("double") / 10000.0


def unit(x: Column) -> Column:
    """Into [0, 1]; null and non-finite values are 0."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def round4(x: Column) -> Column:
    return r4(unit(x))


def non_negative(x: Column) -> Column:
    """A whole number of 0 or more."""
    return F.greatest(F.lit(0), F.coalesce(F.floor(x.cast("double")), F.lit(0))).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by; two decimals."""
    return F.when(whole > 0, F.floor(part / whole * 100.0 + 0.5).cast("double") / 100.0).otherwise(0.0)


def percent(x: Column) -> Column:
    return F.concat(F.floor(x * 100.0 + 0.5).cast("long").cast("string"), F.lit("%"))


def bytes_text(n: Column) -> Column:
    """12 B, 3.4 KB, 5.0 MB, 1.2 GB."""
    scaled = lambda by, name: F.concat(F.format_string("%.1f", n / by), F.lit(f" {name}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1024.0, "KB")).when(n < 1024**3, scaled(1024.0**2, "MB")).otherwise(scaled(1024.0**3, "GB"))


def compact(n: Column) -> Column:
    """950, 1.2K, 3.4M."""
    return F.when(n < 1000, n.cast("string")).when(n < 1_000_000, F.concat(F.format_string("%.1f", n / 1000.0), F.lit("K"))).otherwise(F.concat(F.format_string("%.1f", n / 1_000_000.0), F.lit("M")))


def median_of(values: Column) -> Column:
    """The middle of an array of numbers, of an even number the mean of the two; null for none."""
    at = lambda x, i: F.get(x, F.call_function("div", i, F.lit(2)).cast("int"))
    return F.transform(F.array(F.sort_array(values)), lambda x: (at(x, F.size(x) - 1) + at(x, F.size(x))) / 2)[0]
