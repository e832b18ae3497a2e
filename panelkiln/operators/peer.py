"""An entity among those of its industry on the same date."""

from pyspark.sql import functions as F

from panelkiln.functions.columns import average_rank, ieee_divide
from panelkiln.plans.types import Kind

from .spec import operator


@operator("PeerRank", (Kind.NUMERIC,), Kind.RATIO)
def peer_rank(frame, x):
    return average_rank(x, frame.cohort(), frame.cohort(x)) / F.count(F.lit(1)).over(frame.cohort())


@operator("PeerDeviation", (Kind.NUMERIC,), Kind.NUMERIC)
def peer_deviation(frame, x):
    return ieee_divide(x - F.avg(x).over(frame.cohort()), F.stddev_samp(x).over(frame.cohort()))
