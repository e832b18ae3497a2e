"""From trees to columns, and their evaluation over a panel."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkiln.operators import REGISTRY, Frame
from panelkiln.sources import panel as panels
from panelkiln.sources.registry import Registry

from . import tree
from .typecheck import check
from .types import Kind


class Compiler:
    """Compiles trees over a wide panel. Subtrees that occur several times, in one tree or in many, become one column object, so Catalyst sees them as one expression."""

    def __init__(self, registry: Registry, frame: Frame | None = None) -> None:
        self.registry, self.frame = registry, frame or Frame()
        self.known: dict[tree.Node, Column] = {}

    def column(self, node: tree.Node) -> Column:
        found = self.known.get(node)
        if found is None:
            found = self.known[node] = self._build(node)
        return found

    def _build(self, node: tree.Node) -> Column:
        if isinstance(node, tree.Field):
            metric = self.registry.resolve(node.name)
            raw = F.col(f"`{metric.id}`")
            return (raw != 0) if metric.kind == Kind.BOOL else raw
        if isinstance(node, tree.Literal):
            value = node.value
            return F.lit(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else F.lit(value)
        op = REGISTRY[node.op]
        args = [self.column(a) for a in node.args[: len(op.takes)]]
        return op.build(self.frame, *args, *[a.value for a in node.args[len(op.takes) :]])


def as_tree(expression: str | tree.Node) -> tree.Node:
    return tree.parse(expression) if isinstance(expression, str) else expression


def metric_ids(trees: Iterable[tree.Node], registry: Registry) -> list[str]:
    return list(dict.fromkeys(registry.resolve(n).id for t in trees for n in tree.field_names(t)))


def evaluate_wide(wide: DataFrame, expressions: dict[str, str | tree.Node], registry: Registry, frame: Frame | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """The panel's keys, the columns to keep, and one column for each named expression: one projection, in which windows with the same keys share their shuffle and sort."""
    frame = frame or Frame()
    trees = {name: as_tree(e) for name, e in expressions.items()}
    for t in trees.values():
        check(t, registry)
    lacking = [m for m in metric_ids(trees.values(), registry) if m not in wide.columns]
    if lacking:
        raise ValueError(f"the wide panel lacks {', '.join(lacking)}")
    compiler = Compiler(registry, frame)
    return wide.select(frame.entity, frame.date, frame.industry, *keep, *[compiler.column(t).alias(name) for name, t in trees.items()])


def evaluate(long: DataFrame, expression: str | tree.Node, registry: Registry, value: str = "value", duplicates: str = "strict") -> DataFrame:
    """An expression over a long panel: only the metrics it mentions are read and pivoted."""
    t = as_tree(expression)
    check(t, registry)
    wide = panels.to_wide(long, metric_ids([t], registry), duplicates=duplicates)
    return evaluate_wide(wide, {value: t}, registry)
