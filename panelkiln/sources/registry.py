"""The inventory of metrics."""

from __future__ import annotations

import csv
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from panelkiln.plans.types import BUSINESS_KINDS, GRAINS, MISSING, Kind

#: The inventory file's columns, in its order (fixed values).
COLUMNS = ("metric_id", "source", "name_cn", "dtype", "time_grain", "update_freq", "value_range", "business_tag", "null_semantics")


@dataclass(frozen=True)
class Metric:
    id: str
    source: str
    name: str
    business: str
    grain: str
    freq: str = ""
    range: str = ""
    tag: str = ""
    missing: str = "other"

    @property
    def kind(self) -> Kind:
        return BUSINESS_KINDS[self.business]


class Registry:
    """Metrics by id; a key is an id first, then a name (of equal names the first)."""

    def __init__(self, metrics: Iterable[Metric]) -> None:
        self.by_id: dict[str, Metric] = {}
        self.by_name: dict[str, Metric] = {}
        for m in metrics:
            if m.id in self.by_id:
                raise ValueError(f"metric {m.id} is there twice")
            self.by_id[m.id] = m
            self.by_name.setdefault(m.name, m)

    def __len__(self) -> int:
        return len(self.by_id)

    def __iter__(self) -> Iterator[Metric]:
        return iter(self.by_id.values())

    def __contains__(self, metric_id: str) -> bool:
        return metric_id in self.by_id

    def resolve(self, key: str) -> Metric:
        found = self.by_id.get(key) or self.by_name.get(key)
        if found is None:
            raise KeyError(f"unknown metric {key}")
        return found

    def where(self, **wanted) -> list[Metric]:
        """Metrics with the given attributes, such as source, business or tag."""
        return [m for m in self if all(getattr(m, k) == v for k, v in wanted.items())]

    def source_counts(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for m in self:
            out[m.source] = out.get(m.source, 0) + 1
        return out

    def names_longest_first(self) -> list[str]:
        return sorted((n for n in self.by_name if n), key=len, reverse=True)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(m.id, m.source, m.name, m.business, str(m.kind), m.grain, m.freq, m.range, m.tag, m.missing) for m in self]
        return spark.createDataFrame(rows, "metric_id string, source string, name string, business string, kind string, grain string, freq string, value_range string, tag string, missing string")


def read_registry(path: str | Path) -> Registry:
    """From a CSV file in UTF-8, with or without a byte-order mark."""

    def metric(row: dict[str, str]) -> Metric:
        v = {c: (row.get(c) or "").strip() for c in COLUMNS}
        if v["dtype"] not in BUSINESS_KINDS:
            raise ValueError(f"metric {v['metric_id']}: unknown dtype {v['dtype']!r}")
        if v["time_grain"] not in GRAINS:
            raise ValueError(f"metric {v['metric_id']}: unknown time_grain {v['time_grain']!r}")
        return Metric(v["metric_id"], v["source"], v["name_cn"], v["dtype"], GRAINS[v["time_grain"]], v["update_freq"], v["value_range"], v["business_tag"], MISSING.get(v["null_semantics"], "other"))

    with open(path, encoding="utf-8-sig", newline="") as f:
        return Registry(metric(row) for row in csv.DictReader(f))


@lru_cache(1)
def default_registry() -> Registry:
    """From the file that PANELKILN_REGISTRY names, else the metrics of the synthetic panel."""
    path = os.environ.get("PANELKILN_REGISTRY")
    if path:
        return read_registry(path)
    from .synthetic import METRICS

    return Registry(METRICS)
