"""Windows over an entity's rows, in the order of dates. N counts rows, not months."""

from pyspark.sql import functions as F

from panelkiln.functions.columns import ieee_divide, share_not_above
from panelkiln.plans.types import Kind

from .spec import operator


def _over_rows(name: str, gives: Kind = Kind.NUMERIC):
    return operator(name, (Kind.NUMERIC,), gives, literals=1, window="rows")


@_over_rows("Delta")
def delta(frame, x, n):
    return x - F.lag(x, int(n)).over(frame.history())


@_over_rows("PctChange", Kind.RATIO)
def pct_change(frame, x, n):
    before = F.lag(x, int(n)).over(frame.history())
    return ieee_divide(x - before, before)


@_over_rows("Mean")
def mean(frame, x, n):
    return F.avg(x).over(frame.trailing(int(n)))


@_over_rows("Std")
def std(frame, x, n):
    return F.stddev_samp(x).over(frame.trailing(int(n)))


@_over_rows("ZScore")
def zscore(frame, x, n):
    return ieee_divide(x - mean(frame, x, n), std(frame, x, n))


@_over_rows("Slope")
def slope(frame, x, n):
    if int(n) < 2:
        raise ValueError("Slope needs a window of at least 2 rows")
    return (x - F.lag(x, int(n) - 1).over(frame.history())) / F.lit(float(int(n) - 1))


@_over_rows("TsRank", Kind.RATIO)
def ts_rank(frame, x, n):
    return share_not_above(x, frame.trailing(int(n)))
