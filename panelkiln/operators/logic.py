"""Thresholds, comparisons and three-valued logic."""

from pyspark.sql import functions as F

from panelkiln.plans.types import Kind

from .spec import number, operator

_N, _B = Kind.NUMERIC, Kind.BOOL

operator("GT", (_N,), _B, literals=1)(lambda frame, x, least: x > number(least))
operator("LT", (_N,), _B, literals=1)(lambda frame, x, most: x < number(most))
operator("AND", (_B, _B), _B)(lambda frame, a, b: a & b)
operator("OR", (_B, _B), _B)(lambda frame, a, b: a | b)
operator("NOT", (_B,), _B)(lambda frame, a: ~a)
operator("IfThenElse", (_B, _N, _N), _N)(lambda frame, held, a, b: F.when(held, a).otherwise(b))
operator("Gt2", (_N, _N), _B)(lambda frame, a, b: a > b)
operator("Lt2", (_N, _N), _B)(lambda frame, a, b: a < b)
