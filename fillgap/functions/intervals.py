"""Half-open intervals [start, end) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fillgap.schema import COORD_MAX


def end_of(start: Column, size: Column) -> Column:
    """start + size, not above the largest coordinate."""
    return F.least(start + size, F.lit(COORD_MAX))


def length(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """An empty interval overlaps what it lies strictly inside of."""
    return (a_start < b_end) & (b_start < a_end)


def contains(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """a holds all of b."""
    return (a_start <= b_start) & (b_end <= a_end)
