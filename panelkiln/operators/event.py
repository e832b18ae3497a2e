"""Counts of a condition, and the time since it last held."""

from pyspark.sql import functions as F

from panelkiln.plans.types import Kind

from .spec import operator


@operator("Count", (Kind.BOOL,), Kind.INT, literals=1, window="rows")
def count(frame, held, n):
    return F.sum(held.cast("int")).over(frame.trailing(int(n)))


@operator("DaysSince", (Kind.BOOL,), Kind.NUMERIC)
def days_since(frame, held):
    last = F.max(F.when(held, F.col(frame.date))).over(frame.so_far())
    return F.datediff(F.col(frame.date), last).cast("double")
