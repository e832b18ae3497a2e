"""The front of all runs: entries that no other entry dominates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dominates(a: str, b: str) -> Column:
    """Column a (an array) dominates column b; arrays of different lengths never compare."""
    pairs = F.arrays_zip(F.col(a).alias("p"), F.col(b).alias("q"))
    no_less = F.forall(pairs, lambda x: x["p"] >= x["q"])
    more = F.exists(pairs, lambda x: x["p"] > x["q"])
    return (F.size(a) == F.size(b)) & no_less & more


def local_front(v: np.ndarray) -> np.ndarray:
    """Which rows no other row dominates; strongest sums first, so that most fall at the first comparison."""
    keep, held = np.zeros(len(v), bool), []
    for i in np.argsort(-v.sum(axis=1), kind="stable"):
        h = v[held]
        if not len(held) or not ((h >= v[i]).all(axis=1) & (h > v[i]).any(axis=1)).any():
            held.append(i)
            keep[i] = True
    return keep


#: Survivors that may be sent to all tasks; with more of them the last comparison is a nested loop over both sides' partitions.
FEW = 100_000


def skyline(df: DataFrame, fitness: str = "fitness") -> DataFrame:
    """The rows of df whose fitness (an array of doubles, each to be maximised) no other dominates.

    Each partition keeps its own front, which loses nothing: what it drops is dominated by what it keeps. Fronts are merged eight to one for as long as
    that drops a tenth of them; if one partition is left, it holds the whole front, else the survivors, counted, meet in
    an anti join. NULL, NaN and empty arrays stay out of comparisons and are kept.
    """
    schema = df.schema

    def thin(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            values = held.column(fitness).to_pylist()
            keep = np.ones(len(values), bool)
            by_size: dict[int, list[int]] = {}
            for i, x in enumerate(values):
                if x and not any(y is None or y != y for y in x):
                    by_size.setdefault(len(x), []).append(i)
            for at in by_size.values():
                keep[at] = local_front(np.array([values[i] for i in at], float))
            held = held.filter(pa.array(keep))
        if held is not None:
            yield from held.to_batches()

    front = df.mapInArrow(thin, schema).persist()
    parts, n = front.rdd.getNumPartitions(), front.count()
    while parts > 1 and n:
        parts = -(-parts // 8)
        merged = front.repartition(parts).mapInArrow(thin, schema).persist()
        left = merged.count()
        front.unpersist()
        front = merged
        if parts > 1 and left > 0.9 * n:
            other = front.select(F.col(fitness).alias("__other")).distinct()
            return front.join(F.broadcast(other) if left <= FEW else other, _dominates("__other", fitness), "left_anti")
        n = left
    return front


def dominated_by(df: DataFrame, front: DataFrame, fitness: str = "fitness") -> DataFrame:
    """The rows of df that some row of a front dominates."""
    return df.join(front.select(F.col(fitness).alias("__other")), _dominates("__other", fitness), "left_semi")


def expansion(old: DataFrame, new: DataFrame, fitness: str = "fitness", signature: str = "panel_signature") -> dict:
    """What a run's entries change on the front of the earlier ones: new_on_front, existing_dominated and net_added; same_panel: no earlier entry has another
    signature than the run's; usual_panel: the run has the one that most earlier entries have (ties: the smallest)."""
    before = skyline(old, fitness)
    together = skyline(old.select(fitness, F.lit(False).alias("new")).unionByName(new.select(fitness, F.lit(True).alias("new"))), fitness)
    added = together.where("new").count()
    lost = dominated_by(before, new, fitness).count()
    same, usual = True, True
    if signature in old.columns:
        own = {r[0] for r in new.select(signature).distinct().limit(2).collect()}
        counts = old.where(F.col(signature).isNotNull()).groupBy(signature).agg(F.count("*").alias("n"))
        same = counts.join(new.select(signature).distinct(), signature, "left_anti").limit(1).count() == 0
        mode = counts.orderBy(F.desc("n"), signature).limit(1).collect()
        usual = not mode or own == {mode[0][0]}
    return {"new_on_front": added, "existing_dominated": lost, "net_added": added - lost, "same_panel": same, "usual_panel": usual}


def markdown(rows: Sequence, title: str = "Frontier") -> str:
    """A table of entries (expr_sexpr, fitness, run_id, label, industry), best IV first."""
    head = ["#", "IV", "KS", "stability", "monotonicity", "leaves", "redundancy", "expression", "label", "industry", "run"]
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    for i, r in enumerate(sorted(rows, key=lambda r: -r["fitness"][0]), 1):
        f = [*r["fitness"], *[0.0] * 6][:6]
        cells = [str(i), *(f"{x:.3f}" for x in f[:4]), f"{-f[4]:.0f}", f"{-f[5]:.3f}", f"`{r['expr_sexpr']}`", r["label"], r["industry"], r["run_id"][:8]]
        lines.append("| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |")
    return "\n".join(lines) + "\n"
