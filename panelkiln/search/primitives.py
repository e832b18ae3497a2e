"""What trees can be made of: operators and fields by kind, and literals."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from panelkiln.operators import REGISTRY, Operator
from panelkiln.plans.tree import Call, Field, Literal, Node
from panelkiln.plans.types import SEARCHABLE, Kind, fits
from panelkiln.sources.registry import Metric, Registry

# Windows and thresholds that literals are drawn from.
WINDOWS = (1, 3, 6, 12)
THRESHOLDS = (-1.0, -0.5, -0.3, -0.1, 0.0, 0.1, 0.3, 0.5, 1.0, 2.0)
SHORT_WINDOWS = ("Delta", "PctChange")
STUBS = frozenset({"AffilSum", "AffilHas"})


class NoTree(ValueError):
    """No tree of the wanted kind and depth can be made."""


class Primitives:
    def __init__(self, registry: Registry, only: Iterable[str] | None = None, without: frozenset[str] = STUBS) -> None:
        """only: ids of the metrics that the panel has."""
        allowed = None if only is None else set(only)
        metrics = [m for m in registry if allowed is None or m.id in allowed]
        self.registry = registry
        self.operators = [op for op in REGISTRY.values() if op.name not in without]
        self.unsupported: list[Metric] = [m for m in metrics if m.kind not in SEARCHABLE]
        usable = [m for m in metrics if m.kind in SEARCHABLE]
        self.fields = {k: [m for m in usable if fits(m.kind, k)] for k in Kind}
        self.makers = {k: [op for op in self.operators if fits(op.gives, k)] for k in Kind}

    def names(self) -> list[str]:
        return [m.name or m.id for m in dict.fromkeys(m for k in SEARCHABLE for m in self.fields[k])]

    def alike(self, op: Operator) -> list[Operator]:
        return [x for x in self.operators if x.shape() == op.shape()]

    def literal(self, op: Operator, rng: np.random.Generator) -> Literal:
        if op.window:
            return Literal(int(rng.choice(WINDOWS if op.name in SHORT_WINDOWS else WINDOWS[1:])))
        return Literal(float(rng.choice(THRESHOLDS)))

    def field(self, kind: Kind, rng: np.random.Generator) -> Field:
        m = self.fields[kind][int(rng.integers(len(self.fields[kind])))]
        return Field(m.name or m.id)

    def tree(self, kind: Kind, depth: int, rng: np.random.Generator, full: bool = False) -> Node:
        """A tree that gives `kind`, `depth` levels deep at most where its kinds allow it. full: operators down to the last level, else a field now and then."""
        fields, makers = self.fields[kind], self.makers[kind]
        if depth <= 1:
            if fields:
                return self.field(kind, rng)
            makers = [op for op in makers if all(self.fields[t] for t in op.takes)]
        elif fields and not full and (not makers or rng.random() >= 0.7):
            return self.field(kind, rng)
        if not makers:
            if fields:
                return self.field(kind, rng)
            raise NoTree(f"nothing gives {kind}")
        op = makers[int(rng.integers(len(makers)))]
        args = [self.tree(t, depth - 1, rng, full) for t in op.takes]
        return Call(op.name, (*args, *(self.literal(op, rng) for _ in range(op.literals))))
