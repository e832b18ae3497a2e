"""Fitness of many candidates in one job.

Candidates become columns of one projection over the cached panel, so those with equal windows share a sort; the columns are
stacked to (candidate, value) and at once counted by value and class. Rules that are true or false, as most are, have two rows
there, from which everything follows on the driver. Other candidates' statistics are grouped aggregations of that table; as many
rows as candidates reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.functions import splits, stats
from panelkiln.functions.columns import finite
from panelkiln.operators import Frame
from panelkiln.plans.compiler import Compiler
from panelkiln.plans.tree import Node, canonical, leaf_count
from panelkiln.plans.typecheck import TypeCheckError, check
from panelkiln.plans.types import Kind
from panelkiln.sources.registry import Registry

OBJECTIVES = ("iv", "ks", "stability", "monotonicity", "complexity_neg", "redundancy_neg")
INVALID = (-1.0,) * 6
LEAST_ROWS = 20


def of_two(zero: tuple, one: tuple) -> dict:
    """The statistics of a 0/1 value, from (pos, neg, expected) of both values; the same numbers as from the general aggregations."""
    (p0, n0, e0), (p1, n1, e1) = zero, one
    pos, neg, n = p0 + p1, n0 + n1, p0 + n0 + p1 + n1
    iv = 0.0
    for a, b in ((p0, n0), (p1, n1)):
        if a + b:
            x, y = (a + stats.SMOOTH) / (pos + stats.GUARD), (b + stats.SMOOTH) / (neg + stats.GUARD)
            iv += (x - y) * math.log(x / y)
    both = p0 + n0 > 0 and p1 + n1 > 0
    out = {"n": n, "n_pos": pos, "iv": iv, "ks": abs(p0 / pos - n0 / neg) if pos and neg else 0.0, "monotonicity": abs(p1 / (p1 + n1) - p0 / (p0 + n0)) if both else 0.0, "n_expected": e0 + e1, "psi": 0.0}
    if not n or not e0 + e1:
        return out | {"psi": math.nan}
    edges = sorted({_decile(k / stats.BINS, e0, e0 + e1) for k in range(stats.BINS + 1)})
    if len(edges) > 2:  # a decile between the values: what is 0 falls below it, what is 1 above
        at = lambda v: sum(x <= v for x in edges[1:-1])
        p, q = [stats.FLOOR] * (len(edges) - 1), [stats.FLOOR] * (len(edges) - 1)
        for v, e, a in ((0.0, e0, p0 + n0), (1.0, e1, p1 + n1)):
            p[at(v)] += e
            q[at(v)] += a
        out["psi"] = sum((x / sum(p) - y / sum(q)) * math.log((x / sum(p)) / (y / sum(q))) for x, y in zip(p, q, strict=True))
    return out


def _decile(share: float, zeros: float, n: float) -> float:
    place = share * (n - 1)
    low = math.floor(place)
    a, b = float(low >= zeros), float(math.ceil(place) >= zeros)
    return a + (b - a) * (place - low)


@dataclass
class Fitness:
    """Evaluates trees on a labelled wide panel, split by date; results are kept by canonical form.

    across_splits: whether windows may look back from one split into the one before.
    baselines: names of panel columns that a candidate should not repeat.
    """

    panel: DataFrame
    registry: Registry
    label: str = "label"
    across_splits: bool = False
    baselines: Sequence[str] = ()
    chunk: int = 32
    known: dict[str, tuple[float, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.frame = Frame(within=() if self.across_splits else ("split",))
        # the panel is made once and kept by entity, as its windows want it
        self.kept = self.panel.repartition("entity_id").persist()
        self.cuts = splits.cuts(self.kept)
        self.rows = splits.with_split(self.kept, self.cuts)

    def close(self) -> None:
        self.kept.unpersist()

    def of(self, trees: Sequence[Node]) -> list[tuple[float, ...]]:
        fresh: dict[str, Node] = {}
        for t in trees:
            key = canonical(t)
            if key in self.known or key in fresh:
                continue
            try:
                check(t, self.registry)
                Compiler(self.registry, self.frame).column(t)
                fresh[key] = t
            except (TypeCheckError, KeyError, ValueError, NotImplementedError):
                self.known[key] = INVALID
        keys = list(fresh)
        for at in range(0, len(keys), self.chunk):
            part = keys[at : at + self.chunk]
            self.known |= dict(zip(part, self._evaluate([fresh[k] for k in part]), strict=True))
        return [self.known[canonical(t)] for t in trees]

    def _evaluate(self, trees: list[Node]) -> list[tuple[float, ...]]:
        compiler = Compiler(self.registry, self.frame)
        columns = {f"c{i}": compiler.column(t).cast("double") for i, t in enumerate(trees)}
        wide = self.rows.select("split", F.col(self.label).alias("__y"), *self.baselines, *[c.alias(n) for n, c in columns.items()]).where(F.col("split") != "valid")
        long = wide.unpivot(["split", "__y", *self.baselines], list(columns), "cand", "value").where(finite(F.col("value")) & F.col("__y").isNotNull())
        oot, hit = (F.col("split") == "oot").cast("double"), (F.col("__y") != 0).cast("double")
        table = stats.value_table(long, "value", ["cand"], pos=oot * hit, neg=oot * (1 - hit), e=1 - oot).persist()
        by = ["cand"]
        found = {}
        rules = [f"c{i}" for i, t in enumerate(trees) if self._is_rule(t)]
        if rules:
            cells: dict[str, dict[int, tuple]] = {}
            for r in table.where(F.col("cand").isin(rules)).collect():
                cells.setdefault(r["cand"], {})[int(r["v"])] = (r["pos"], r["neg"], r["e"])
            found = {c: of_two(x.get(0, (0.0,) * 3), x.get(1, (0.0,) * 3)) for c, x in cells.items()}
        if len(rules) < len(trees) or self.baselines:
            self._add_others(found, long, table.where(~F.col("cand").isin(rules)) if rules else table, by)
        table.unpersist()
        return [self._vector(found.get(f"c{i}"), t) for i, t in enumerate(trees)]

    def _is_rule(self, t: Node) -> bool:
        return check(t, self.registry).kind == Kind.BOOL

    def _add_others(self, found: dict, long: DataFrame, table: DataFrame, by: list[str]) -> None:
        late = table.select("cand", "v", "pos", "neg").where("pos + neg > 0")
        got = stats.score_table(late, by).select("cand", "n", "n_pos", "iv", "ks")
        got = got.join(stats.monotonicity_table(late.select("cand", "v", "pos", (F.col("pos") + F.col("neg")).alias("n")), by), by, "left")
        both = table.select("cand", "v", "e", (F.col("pos") + F.col("neg")).alias("a"))
        got = got.join(stats.divergence_table(both, by).select("cand", "psi", "n_expected"), by, "left")
        found |= {r["cand"]: r.asDict() for r in got.collect()}
        for i, b in enumerate(self.baselines):
            for r in stats.spearman(long.where("split = 'oot'"), "value", b, by).collect():
                if r["cand"] in found:
                    found[r["cand"]][f"r{i}"] = abs(r["spearman"])

    def _vector(self, r, tree: Node) -> tuple[float, ...]:
        if r is None or r["n"] < LEAST_ROWS or r["n_pos"] == 0:
            return INVALID
        psi = r["psi"]
        stable = 0.0 if r["n_expected"] is None or r["n_expected"] < LEAST_ROWS or psi is None or math.isnan(psi) else 1 / (1 + max(psi, 0.0))
        repeated = max([0.0, *(r.get(f"r{i}") or 0.0 for i in range(len(self.baselines)))])
        return (r["iv"], r["ks"], stable, r["monotonicity"] or 0.0, -float(leaf_count(tree)), -repeated)
