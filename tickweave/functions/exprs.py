"""Column helpers that keep one kind of missing value (NULL) and never raise under ANSI rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """A double; what is no finite number is NULL."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero or either is missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def flag(condition: Column) -> Column:
    """A condition that is false where it can't be decided."""
    return F.coalesce(condition, F.lit(False))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def add_up(*values: Column) -> Column:
    return reduce(lambda a, b: a + b, values)


def tidy(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison: exact halves go up in every engine, and zero has no sign."""
    return F.round(value + F.lit(1e-10), digits) + F.lit(0.0)
