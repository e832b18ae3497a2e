"""What an operator is, and the table of all operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from panelkiln.plans.types import Kind


@dataclass(frozen=True)
class Frame:
    """The columns that windows run over. `within` splits entities' histories further (say, by a split of the dates); `ties` order rows of an entity that share a date."""

    entity: str = "entity_id"
    date: str = "observation_date"
    industry: str = "industry"
    within: tuple[str, ...] = ()
    ties: tuple[str, ...] = ("industry",)

    def history(self) -> WindowSpec:
        return Window.partitionBy(*self.within, self.entity).orderBy(self.date, *self.ties)

    def trailing(self, rows: int) -> WindowSpec:
        return self.history().rowsBetween(1 - rows, 0)

    def so_far(self) -> WindowSpec:
        return self.history().rowsBetween(Window.unboundedPreceding, 0)

    def cohort(self, *also: Column) -> WindowSpec:
        return Window.partitionBy(*self.within, self.industry, self.date, *also)


@dataclass(frozen=True)
class Operator:
    """takes: the kinds of the arguments; literals: how many literals follow them; window: `rows` if the last literal is a number of rows."""

    name: str
    takes: tuple[Kind, ...]
    gives: Kind
    build: Callable[..., Column] = field(compare=False)
    literals: int = 0
    window: str | None = None

    @property
    def arity(self) -> int:
        return len(self.takes) + self.literals

    def shape(self) -> tuple:
        return self.takes, self.gives, self.literals


REGISTRY: dict[str, Operator] = {}


def operator(name: str, takes: tuple[Kind, ...], gives: Kind, literals: int = 0, window: str | None = None):
    """Registers build(frame, *columns, *literals) under a name; further operators join the same table."""

    def add(build: Callable[..., Column]) -> Callable[..., Column]:
        if name in REGISTRY:
            raise ValueError(f"operator {name} is registered already")
        REGISTRY[name] = Operator(name, takes, gives, build, literals, window)
        return build

    return add


def number(value) -> Column:
    return F.lit(float(value))
