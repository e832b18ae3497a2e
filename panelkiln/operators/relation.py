"""Operators over a graph of affiliates. Their signatures are known to the type check; without a graph they can't be compiled."""

from panelkiln.plans.types import Kind

from .spec import operator


def _needs_graph(name: str):
    def build(frame, x):
        raise NotImplementedError(f"{name} needs an entity graph; panelkiln.functions.relations computes it from a table of edges")

    return build


operator("AffilSum", (Kind.NUMERIC,), Kind.NUMERIC)(_needs_graph("AffilSum"))
operator("AffilHas", (Kind.BOOL,), Kind.BOOL)(_needs_graph("AffilHas"))
