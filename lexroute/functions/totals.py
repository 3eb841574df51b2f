"""Sums and means of doubles that do not depend on the order of rows, nor on how files are split.

A plain sum of doubles rounds at each step, so two runs may differ in the last bit, and with it whether two means are equal or reach a bound.
Here each value is added up as a decimal of PLACES places, exactly, and what lies beyond these places as a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = 18


def total_sql(x: str) -> str:
    """The sum of x as SQL; values that no such decimal holds (1e20 and more, infinite, NaN) lead back to the plain sum."""
    d = f"try_cast({x} as decimal(38, {PLACES}))"
    return f"coalesce(case when count({x}) = count({d}) then cast(try_sum({d}) as double) + sum({x} - cast({d} as double)) end, sum({x}))"


def mean_sql(x: str) -> str:
    return f"({total_sql(x)} / nullif(count({x}), 0))"


def mean(x: Column) -> Column:
    """The same as a column; x is a double."""
    d = x.try_cast(f"decimal(38, {PLACES})")
    exact = F.when(F.count(x) == F.count(d), F.try_sum(d).cast("double") + F.sum(x - d.cast("double")))
    return F.try_divide(F.coalesce(exact, F.sum(x)), F.count(x))
