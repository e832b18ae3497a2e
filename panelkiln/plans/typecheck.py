"""Type and business rules of expressions, checked before anything runs."""

from __future__ import annotations

from dataclasses import dataclass, field

from panelkiln.operators import REGISTRY, Operator
from panelkiln.sources.registry import Registry

from . import tree
from .types import AMOUNT, COUNT, Kind, fits, kind_of_literal

MAX_DEPTH, MAX_LEAVES = 5, 8
#: Operators that must not bring an amount and a count, taken as they are, together.
# Operators whose arguments share a dimension.
SAME_DIMENSION = ("Ratio", "Add", "Subtract", "Multiply", "Min", "Max", "Gt2", "Lt2")


class TypeCheckError(TypeError):
    """An expression that breaks a rule."""


@dataclass
class Checked:
    kind: Kind
    depth: int
    leaves: int
    warnings: list[str] = field(default_factory=list)


def _window_rule(op: Operator, call: tree.Call) -> None:
    if op.window and call.args:
        n = getattr(call.args[-1], "value", None)
        if isinstance(n, bool) or not isinstance(n, (int, float)) or n != int(n) or n <= 0:
            raise TypeCheckError(f"{op.name}: a window is a whole number of rows above 0, not {n!r}")


def _dimension_rule(op: Operator, call: tree.Call, registry: Registry) -> None:
    if op.name in SAME_DIMENSION:
        kinds = {registry.resolve(a.name).business for a in call.args if isinstance(a, tree.Field)}
        if {AMOUNT, COUNT} <= kinds:
            raise TypeCheckError(f"{op.name}: an amount and a count don't go together")


def check(node: tree.Node, registry: Registry, max_depth: int | None = None, max_leaves: int | None = None) -> Checked:
    """The kind of an expression; TypeCheckError if it breaks a rule, KeyError for unknown names. Trailing literals count as leaves, not as depth."""
    max_depth, max_leaves = max_depth or MAX_DEPTH, max_leaves or MAX_LEAVES
    warnings: list[str] = []

    def visit(n: tree.Node) -> tuple[Kind, int]:
        if isinstance(n, tree.Literal):
            return kind_of_literal(n.value), 1
        if isinstance(n, tree.Field):
            metric = registry.resolve(n.name)
            if metric.missing == "distinguish":
                warnings.append(f"{metric.name}: missing, unauthorised and inapplicable values differ in meaning")
            return metric.kind, 1
        op = REGISTRY[n.op]
        if len(n.args) != op.arity:
            raise TypeCheckError(f"{op.name} takes {op.arity} arguments, not {len(n.args)}")
        deepest = 1
        for place, (arg, wanted) in enumerate(zip(n.args, op.takes, strict=False)):
            kind, depth = visit(arg)
            if not fits(kind, wanted):
                raise TypeCheckError(f"{op.name}: argument {place + 1} is {kind}, wanted {wanted}")
            deepest = max(deepest, depth)
        if not all(isinstance(a, tree.Literal) for a in n.args[len(op.takes) :]):
            raise TypeCheckError(f"{op.name}: its last {op.literals} arguments are literals")
        _window_rule(op, n)
        _dimension_rule(op, n, registry)
        return op.gives, deepest + 1

    kind, depth = visit(node)
    leaves = tree.leaf_count(node)
    if depth > max_depth or leaves > max_leaves:
        raise TypeCheckError(f"depth {depth} of {max_depth}, leaves {leaves} of {max_leaves}")
    return Checked(kind, depth, leaves, list(dict.fromkeys(warnings)))
