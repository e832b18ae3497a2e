"""Arithmetic of two numbers, within a source and across sources."""

from pyspark.sql import functions as F

from panelkiln.plans.types import Kind

from .spec import operator


def _two(name: str, gives: Kind = Kind.NUMERIC):
    return operator(name, (Kind.NUMERIC, Kind.NUMERIC), gives)


_two("Add")(lambda frame, a, b: a + b)
_two("Subtract")(lambda frame, a, b: a - b)
_two("Multiply")(lambda frame, a, b: a * b)
_two("Min")(lambda frame, a, b: F.least(a, b))
_two("Max")(lambda frame, a, b: F.greatest(a, b))
_two("Ratio", Kind.RATIO)(lambda frame, a, b: F.try_divide(a, b))


@_two("Inconsistency", Kind.RATIO)
def inconsistency(frame, a, b):
    middle = (F.abs(a) + F.abs(b)) / F.lit(2.0)
    return F.when(middle == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(a - b), middle))
