"""Event counts over a stream of events, with late data bounded by a watermark.

The batch operators count over rows of a panel; over a stream the same questions are asked of event time: how many events of a
kind an entity had in each sliding window. Windows close, and their rows come out once, when the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, kinds: Sequence[str], length: str = "30 days", slide: str = "1 day", late: str = "7 days", entity: str = "entity_id", time: str = "event_time", kind: str = "event_type") -> DataFrame:
    """entity, window_start, window_end, n: events of the kinds in each window that has any."""
    some = events.where(F.col(kind).isin(list(kinds))).withWatermark(time, late)
    got = some.groupBy(F.window(time, length, slide), entity).agg(F.count("*").alias("n"))
    return got.select(entity, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")


def start(counts: DataFrame, path: str, checkpoint: str, once: bool = False):
    """Appends closed windows to Parquet; the checkpoint makes it exactly once. once: what is there now, then stops."""
    writer = counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if once else writer).start()
