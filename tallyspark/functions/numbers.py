"""Rounding and ratios as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(column: Column | str) -> Column:
    """Money and quantities: four places, exact."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(14,4)")


def total(column: Column | str) -> Column:
    """A sum that is zero for no rows."""
    return F.coalesce(F.sum(column), F.lit(0).cast("decimal(24,4)"))


def money(column: Column | str) -> Column:
    """Two places, half up, as a double for output."""
    return F.round(F.col(column) if isinstance(column, str) else column, 2).cast("double")


def units(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """As doubles; null where the denominator is null or zero."""
    whole = whole.cast("double")
    return F.when(whole != 0, part.cast("double") / whole)


def share(part: Column, whole: Column) -> Column:
    """Four places; null where the denominator is null or zero."""
    return F.round(ratio(part, whole), 4)
