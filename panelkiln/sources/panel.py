"""Long and wide panels.

Long: entity_id, observation_date, industry, metric_id, value (double), one row a cell. Wide: one column a metric.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.plans.types import NOT_NUMBERS

from .registry import Registry

log = logging.getLogger(__name__)

KEYS = ("entity_id", "observation_date", "industry")
SCHEMA = "entity_id string, observation_date date, industry string, metric_id string, value double"


class DuplicateCells(ValueError):
    """Cells that the long panel has more than once."""


def read_long(spark: SparkSession, path: str, metric_ids: Sequence[str] | None = None) -> DataFrame:
    """The five columns; with metric_ids, a filter that reaches the Parquet scan."""
    df = spark.read.schema(SCHEMA).parquet(path)
    return df if metric_ids is None else df.where(F.col("metric_id").isin(list(metric_ids)))


def write_long(df: DataFrame, path: str, registry: Registry) -> DataFrame:
    """Checks the columns and that every known metric can be a double (unknown ones are logged), then writes."""
    wanted = [c.split()[0] for c in SCHEMA.split(", ")]
    if sorted(df.columns) != sorted(wanted):
        raise ValueError(f"a long panel has the columns {wanted}, not {df.columns}")
    ids = [r[0] for r in df.select("metric_id").distinct().collect()]  # as many as the inventory has metrics
    wrong = [m for m in ids if m in registry and registry.by_id[m].business in NOT_NUMBERS]
    if wrong:
        raise ValueError(f"metrics that a number can't hold: {sorted(wrong)}")
    unknown = [m for m in ids if m not in registry]
    if unknown:
        log.warning("metrics not in the inventory: %s", sorted(unknown))
    out = df.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMA.split(", ")])
    out.write.mode("overwrite").parquet(path)
    return out


def duplicate_cells(long: DataFrame) -> DataFrame:
    """entity, date and metric of cells with several rows (the industry is no part of a cell's key), with their number."""
    return long.groupBy("entity_id", "observation_date", "metric_id").agg(F.count("*").alias("n")).where("n > 1")


def dirty_rows(long: DataFrame) -> DataFrame:
    """All rows of duplicate cells."""
    return long.join(duplicate_cells(long), ["entity_id", "observation_date", "metric_id"], "left_semi")


def to_wide(long: DataFrame, metric_ids: Sequence[str], duplicates: str = "strict", dirty_path: str | None = None) -> DataFrame:
    """One column a metric, in the order given; absent cells are NULL, duplicate ones give their largest value.

    duplicates: `strict` raises DuplicateCells with five of them, `warn` logs how many there are (and writes their rows to dirty_path), `max` doesn't look.
    """
    long = long.where(F.col("metric_id").isin(list(metric_ids)))
    if duplicates not in ("strict", "warn", "max"):
        raise ValueError(f"duplicates: strict, warn or max, not {duplicates}")
    if duplicates != "max":
        some = duplicate_cells(long).limit(5).collect()
        if some and duplicates == "strict":
            raise DuplicateCells(f"for example {[tuple(r) for r in some]}")
        if some:
            log.warning("duplicate cells, taking the largest values; for example %s", [tuple(r) for r in some])
            if dirty_path:
                dirty_rows(long).write.mode("overwrite").parquet(dirty_path)
    return long.groupBy(*KEYS).pivot("metric_id", list(metric_ids)).agg(F.max("value"))


def join_labels(panel: DataFrame, labels: DataFrame, label: str, as_: str = "label") -> DataFrame:
    """The panel's rows that have the label, with its value."""
    own = labels.where(F.col("label_name") == label).select("entity_id", "observation_date", F.col("label_value").alias(as_))
    return panel.join(own, ["entity_id", "observation_date"])
