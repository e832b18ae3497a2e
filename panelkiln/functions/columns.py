"""Columns that several operators are made of."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b as floating-point hardware does it: 0/0 is NaN, x/0 infinite; NULL stays NULL. (ANSI mode would raise.)"""
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, at_zero).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def rounded(x: Column, digits: int) -> Column:
    """A double to so many decimals as SQL engines do it on doubles: scaled, half away from zero, scaled back. (Spark's round goes by the shortest decimal, and parts at ties such as -333/640.)"""
    scale = F.lit(10.0**digits)
    out = F.round(x * scale, 0) / scale
    return F.when(F.abs(out) < F.lit(float("inf")), out).otherwise(x)


def average_rank(x: Column, group: WindowSpec, ties: WindowSpec) -> Column:
    """Rank within a group, ties sharing their mean; NULL for NULL. `ties` is the group's window with x among its keys."""
    rank = F.rank().over(group.orderBy(x.asc_nulls_last()))
    return F.when(x.isNotNull(), rank + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))


def share_not_above(x: Column, trailing: WindowSpec) -> Column:
    """The share of a window's rows whose value is at most the current one. NULLs count as rows, never as values; a NULL current value gives 0."""
    held = F.filter(F.collect_list(x).over(trailing), lambda e: e <= x)
    return F.when(x.isNull(), F.lit(0.0)).otherwise(F.size(held) / F.count(F.lit(1)).over(trailing))


def finite(x: Column) -> Column:
    """Neither NULL nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
