"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Targets: every source gets its weight's share of the wanted total; a source whose share exceeds `max_epochs` times its own
size is clamped there, and what it leaves is dealt again by weight until no source is above its clamp. Sorted by clamp per
weight, the clamped sources are a prefix, so running sums over the (small) table of sources give the level directly.

Repetitions: a source's rows are taken target/size times: the whole part for each row, and one more copy for a fraction of
the rows, spread evenly over the rows in the order (size class, seeded hash), so that the extra copies stay near the
wanted number of words for small sources too. Places in that order come from counts of cells (source, size class, hash
prefix): no source, however large, is ordered in one task.

NULL texts have size 0, a NULL source is a source of its own, rows are told apart by their place in the stored table. Texts of any
length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, words

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MAX_EPOCHS = 2
SEED = 17


def targets(sizes: DataFrame, source: str = "source", size: str = "source_size", weights=WEIGHTS, total: float = TOTAL, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds `target` to one row a source. Weights repeat over the sources by code point, NULL last.

    The windows have no partition: their input has one row for each source.
    """
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    by_clamp = Window.orderBy(F.col("__clamp") / F.col("__w"), F.col("__i"))
    everything = Window.partitionBy()
    df = sizes.withColumn("__i", F.row_number().over(by_name))
    df = df.withColumn("__w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("__i") - 1) % len(weights) + 1).cast("int")))
    df = df.withColumn("__clamp", F.col(size) * F.lit(float(max_epochs)))
    before = by_clamp.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(size).over(everything) * F.lit(float(total)) - F.coalesce(F.sum("__clamp").over(before), F.lit(0.0))
    weight = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    df = df.withColumn("__level", left / weight)
    # the first source, by clamp per weight, that stays below its clamp sets the level for all that follow
    free = F.when(F.col("__level") * F.col("__w") < F.col("__clamp"), F.col("__level"))
    df = df.withColumn("__level", F.first(free, ignorenulls=True).over(by_clamp.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    df = df.withColumn("target", F.least(F.col("__clamp"), F.coalesce(F.col("__level") * F.col("__w"), F.col("__clamp"))))
    return df.drop("__i", "__w", "__clamp", "__level")


def repetitions(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = SEED, digits: int = 2, **of) -> DataFrame:
    """One light row for each row of docs: __row, key, source, size, source_size, target, repeats (how often it is taken).

    digits: of the hash prefix in a cell's name; each digit divides the rows of a cell by 16.
    """
    h = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed))))
    rows = keyed(docs) if "__row" not in docs.columns else docs
    rows = rows.select("__row", F.col(key), F.col(source), F.size(words(F.col(text))).cast("long").alias("size"))
    rows = rows.withColumn("__h", h).withColumn("__class", F.length(F.bin("size"))).withColumn("__cell", F.substring("__h", 1, digits))
    cell = [source, "__class", "__cell"]
    place = Window.partitionBy(*cell).orderBy("__h", "size", "__row")
    rows = rows.withColumn("__n", F.row_number().over(place))
    cells = rows.groupBy(*cell).agg(F.count("*").alias("__rows"), F.sum("size").alias("__words"))
    sized = targets(cells.groupBy(source).agg(F.sum("__words").alias("source_size")), source, **of)
    upto = Window.partitionBy(source).orderBy("__class", "__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("__rows").over(upto), F.lit(0)))
    cells = _join(cells, sized, [source])
    rows = _join(rows, cells.drop("__rows", "__words"), cell)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("__rate", rate)
    whole, i = F.floor("__rate"), F.col("__before") + F.col("__n")
    part = F.col("__rate") - whole
    extra = F.floor(i * part + F.lit(0.5)) - F.floor((i - 1) * part + F.lit(0.5))
    return rows.withColumn("repeats", whole + extra).select("__row", key, source, "size", "source_size", "target", "repeats")


def _join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which NULL keys match; b has one row for a key."""
    b = b.select(*[F.col(c).alias(f"__on_{c}") if c in on else F.col(c) for c in b.columns])
    same: Column = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    return a.join(b, same).drop(*[f"__on_{c}" for c in on])


def mix(docs: DataFrame, **of) -> DataFrame:
    """The mixed table: every row as often as it is taken, with the columns it came with."""
    rows = keyed(docs)
    taken = repetitions(rows, **of).where("repeats > 0").select("__row", F.col("repeats").cast("int").alias("__repeats"))
    out = rows.join(taken, "__row")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__repeats")))).select(*[F.col(f"`{c}`") for c in docs.columns])
