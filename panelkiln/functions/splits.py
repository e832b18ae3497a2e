"""Splits by date, and lagged features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cuts:
    """Last dates of the parts."""

    train: date
    valid: date
    oot: date


def cuts(df: DataFrame, train: float = 0.6, valid: float = 0.2, on: str = "observation_date") -> Cuts:
    """From the different dates in order: a share for training, the next for validation, the rest out of time. Every part has a date, else ValueError."""
    if not (0 < train < 1 and 0 < valid < 1 and train + valid < 1):
        raise ValueError("the shares lie between 0 and 1 and leave something over")
    days = sorted(r[0] for r in df.select(on).distinct().where(F.col(on).isNotNull()).collect())  # a calendar: it doesn't grow with the entities
    a, b = int(len(days) * train), int(len(days) * (train + valid))
    if not 1 <= a < b < len(days):
        raise ValueError(f"{len(days)} dates don't fill three parts")
    return Cuts(days[a - 1], days[b - 1], days[-1])


def with_split(df: DataFrame, c: Cuts, on: str = "observation_date") -> DataFrame:
    """Adds `split`: train, valid or oot."""
    return df.withColumn("split", F.when(F.col(on) <= F.lit(c.train), "train").when(F.col(on) <= F.lit(c.valid), "valid").otherwise("oot"))


def time_split(df: DataFrame, train: float = 0.6, valid: float = 0.2, on: str = "observation_date") -> tuple[DataFrame, DataFrame, DataFrame, Cuts]:
    c = cuts(df, train, valid, on)
    parts = with_split(df.where(F.col(on).isNotNull()), c, on)
    return (*(parts.where(F.col("split") == s).drop("split") for s in ("train", "valid", "oot")), c)


def lag_features(df: DataFrame, columns: Sequence[str], rows: int, entity: str = "entity_id", on: str = "observation_date") -> DataFrame:
    """The columns as they were some rows (not months) before, within each entity."""
    w = Window.partitionBy(entity).orderBy(on)
    return df.withColumns({c: F.lag(c, rows).over(w) for c in columns})
