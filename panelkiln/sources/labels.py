"""Forward-looking labels: whether an event of a kind falls into the time after an observation date."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MONTH_DAYS = 31


@dataclass(frozen=True)
class Label:
    name: str
    days: int
    events: tuple[str, ...]


# The labels, their horizons in months and the events they look for.
LABELS = tuple(
    Label(name, months * MONTH_DAYS, events)
    for name, months, events in (
        ("Y_overdue_3m", 3, ("overdue30",)),
        ("Y_downgrade_6m", 6, ("downgrade",)),
        ("Y_npl_12m", 12, ("npl",)),
        ("Y_early_signal", 6, ("judicial_adverse", "credit_adverse")),
    )
)


def build_labels(events: DataFrame, dates: DataFrame, labels: Sequence[Label] = LABELS, entities: DataFrame | None = None) -> DataFrame:
    """entity_id, observation_date, label_name, label_value (0/1): 1 if an event falls into (date, date + days].

    The grid has every entity with an event (or those given) on every date. The date of the next event after each grid date
    decides every horizon, so there is no range join: grid rows and events are sorted together by entity, latest date first, and the
    next event is a running minimum, which goes on from row to row. One shuffle by entity serves all labels.

    dates: one column, observation_date; a calendar, whose length doesn't grow with the entities.
    """
    who = (events if entities is None else entities).select("entity_id").distinct()
    calendar = dates.select(F.col("observation_date").cast("date").alias("at")).distinct().agg(F.collect_list("at").alias("at"))
    grid = who.join(F.broadcast(calendar)).select("entity_id", F.explode("at").alias("at"))
    kinds = [F.col("event_type").isin(*x.events).alias(f"is{k}") for k, x in enumerate(labels)]
    log = events.select("entity_id", F.col("event_date").cast("date").alias("at"), F.lit(False).alias("grid"), *kinds)
    both = grid.select("entity_id", "at", F.lit(True).alias("grid"), *[F.lit(False).alias(f"is{k}") for k in range(len(labels))]).unionByName(log)
    later = Window.partitionBy("entity_id").orderBy(F.datediff("at", F.lit("1970-01-01").cast("date")).desc()).rangeBetween(Window.unboundedPreceding, -1)
    found = [F.min(F.when(F.col(f"is{k}"), F.col("at"))).over(later).alias(f"next{k}") for k in range(len(labels))]
    rows = both.select("entity_id", "at", "grid", *found).where("grid")
    each = F.array(*[
        F.struct(F.lit(x.name).alias("label_name"), F.coalesce(F.datediff(f"next{k}", "at") <= x.days, F.lit(False)).cast("tinyint").alias("label_value"))
        for k, x in enumerate(labels)
    ])
    return rows.select("entity_id", F.col("at").alias("observation_date"), F.inline(each))
