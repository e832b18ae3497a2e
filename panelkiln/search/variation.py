"""First populations and changes of trees. Every result passes the type check; where none is found, the parents come back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from panelkiln.operators import REGISTRY
from panelkiln.plans.tree import Call, Literal, Node, canonical
from panelkiln.plans.typecheck import TypeCheckError, check
from panelkiln.plans.types import Kind, fits, kind_of_literal

from .primitives import NoTree, Primitives

TRIES = 10


def valid(node: Node, prims: Primitives) -> bool:
    try:
        check(node, prims.registry)
    except (TypeCheckError, KeyError):
        return False
    return True


def compiles(node: Node) -> bool:
    """Windows that an operator can't have are found without Spark: Slope needs two rows."""
    return not any(isinstance(n, Call) and n.op == "Slope" and n.args[-1].value < 2 for n in node.walk())


def ramped(prims: Primitives, size: int, rng: np.random.Generator, depths: tuple[int, int] = (2, 4), kind: Kind = Kind.BOOL) -> list[Node]:
    """Different trees, half of them full, of depths spread over the range."""
    found: dict[str, Node] = {}
    for k in range(size * 30):
        if len(found) == size:
            break
        try:
            t = prims.tree(kind, int(rng.integers(depths[0], depths[1] + 1)), rng, full=k % 2 == 1)
        except NoTree:
            continue
        if valid(t, prims):
            found.setdefault(canonical(t), t)
    if len(found) < size:
        raise NoTree(f"only {len(found)} of {size} different trees")
    return list(found.values())


def kind_of(node: Node, prims: Primitives) -> Kind:
    if isinstance(node, Call):
        return REGISTRY[node.op].gives
    return kind_of_literal(node.value) if isinstance(node, Literal) else prims.registry.resolve(node.name).kind


def places(node: Node, path: tuple[int, ...] = (), wanted: Kind | None = None) -> list[tuple[tuple[int, ...], Node, Kind | None]]:
    """Every subtree with its path and the kind its place wants (None at the root and for trailing literals)."""
    out = [(path, node, wanted)]
    if isinstance(node, Call):
        takes = REGISTRY[node.op].takes
        for i, a in enumerate(node.args):
            out += places(a, (*path, i), takes[i] if i < len(takes) else None)
    return out


def put(node: Node, path: tuple[int, ...], new: Node) -> Node:
    if not path:
        return new
    args = list(node.args)
    args[path[0]] = put(args[path[0]], path[1:], new)
    return Call(node.op, tuple(args))


def _first_valid(make: Callable[[], Node | None], old: Node, prims: Primitives) -> Node:
    for _ in range(TRIES):
        try:
            t = make()
        except NoTree:
            continue
        if t is not None and t != old and valid(t, prims):
            return t
    return old


def crossover(a: Node, b: Node, prims: Primitives, rng: np.random.Generator) -> tuple[Node, Node]:
    """Swaps two subtrees that fit in each other's places."""
    inner = lambda t: [x for x in places(t) if x[2] is not None]
    left, right = inner(a), inner(b)
    for _ in range(TRIES if left and right else 0):
        (pa, sa, wa), (pb, sb, wb) = left[int(rng.integers(len(left)))], right[int(rng.integers(len(right)))]
        if fits(kind_of(sb, prims), wa) and fits(kind_of(sa, prims), wb):
            x, y = put(a, pa, sb), put(b, pb, sa)
            if valid(x, prims) and valid(y, prims):
                return x, y
    return a, b


def regrow(a: Node, prims: Primitives, rng: np.random.Generator) -> Node:
    """A new subtree, at most three deep, in place of one of the same kind."""
    spots = places(a, wanted=kind_of(a, prims))
    spots = [x for x in spots if x[2] is not None]

    def make() -> Node:
        path, _, wanted = spots[int(rng.integers(len(spots)))]
        return put(a, path, prims.tree(wanted, int(rng.integers(1, 4)), rng))

    return _first_valid(make, a, prims)


def other_operator(a: Node, prims: Primitives, rng: np.random.Generator) -> Node:
    """Another operator of the same shape, or another field of a fitting kind."""
    spots = [x for x in places(a) if isinstance(x[1], Call)]

    def make() -> Node | None:
        if not spots:
            return None
        path, node, _ = spots[int(rng.integers(len(spots)))]
        same = [op for op in prims.alike(REGISTRY[node.op]) if op.name != node.op]
        return put(a, path, Call(same[int(rng.integers(len(same)))].name, node.args)) if same else None

    return _first_valid(make, a, prims)


def other_literal(a: Node, prims: Primitives, rng: np.random.Generator) -> Node:
    calls = [(path, n) for path, n, _ in places(a) if isinstance(n, Call) and REGISTRY[n.op].literals]

    def make() -> Node | None:
        if not calls:
            return None
        path, n = calls[int(rng.integers(len(calls)))]
        op = REGISTRY[n.op]
        i = len(op.takes) + int(rng.integers(op.literals))
        return put(a, (*path, i), prims.literal(op, rng))

    return _first_valid(make, a, prims)
