"""The expression operators, registered by name."""

from . import arithmetic, event, logic, peer, relation, temporal  # noqa: F401
from .spec import REGISTRY, Frame, Operator, operator

__all__ = ["REGISTRY", "Frame", "Operator", "operator"]
