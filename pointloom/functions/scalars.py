"""Scalar functions on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def identity(*cols: str) -> Column:
    """The first 16 hex digits of the SHA-256 of the columns' text."""
    return F.substring(F.sha2(F.concat_ws("|", *cols), 256), 1, 16)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + t * (b - a)


def wrap_degrees(x: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def null_if_not_finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def hypot(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def median_of(values: Column) -> Column:
    """The median of an array of numbers."""
    s = F.array_sort(values)
    n = F.size(s)
    return F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.ceil((n + 1) / 2).cast("int"))) / 2)
