"""The search: populations from generation to generation, and what is left on the front."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np

from panelkiln.plans.tree import Node, canonical, field_names

from . import nsga, variation
from .fitness import INVALID, Fitness
from .primitives import NoTree, Primitives


class Coach(Protocol):
    """Proposes and judges trees; what it proposes is type-checked, its judgement (0 to 1) shifts IV a little."""

    def seeds(self, label: str, industry: str | None, fields: list[str], operators: list[str], k: int) -> list[Node]: ...

    def critique(self, trees: list[Node]) -> list[float]: ...

    def cross_source(self, coverage: dict[str, int], fields: list[str], operators: list[str], k: int) -> list[Node]: ...


class NeutralCoach:
    def seeds(self, label, industry, fields, operators, k):
        return []

    def critique(self, trees):
        return [0.5] * len(trees)

    def cross_source(self, coverage, fields, operators, k):
        return []


class SafeCoach:
    """Another coach, whose failures count as silence."""

    def __init__(self, coach: Coach) -> None:
        self.coach = coach

    def _try(self, call, fallback):
        try:
            return call()
        except Exception:
            return fallback

    def seeds(self, *a):
        return self._try(lambda: self.coach.seeds(*a), [])

    def cross_source(self, *a):
        return self._try(lambda: self.coach.cross_source(*a), [])

    def critique(self, trees):
        got = self._try(lambda: self.coach.critique(trees), None)
        return got if got is not None and len(got) == len(trees) else [0.5] * len(trees)


@dataclass(frozen=True)
class Config:
    size: int = 60
    generations: int = 20
    depths: tuple[int, int] = (2, 4)
    crossover: float = 0.6
    regrow: float = 0.2
    operator: float = 0.1
    tournament: int = 3
    elite: int = 4
    seed: int = 0
    coach_weight: float = 0.1
    coach_every: int = 5
    proposals: int = 5


@dataclass
class Individual:
    tree: Node
    fitness: tuple[float, ...] = INVALID
    rank: int = nsga.UNRANKED
    crowding: float = 0.0


@dataclass
class Result:
    front: list[Individual]
    population: list[Individual]
    history: list[dict] = field(default_factory=list)


def rank(population: list[Individual]) -> None:
    """Ranks and crowding; invalid individuals stay unranked, whatever their sizes."""
    for x in population:
        x.rank, x.crowding = nsga.UNRANKED, 0.0
    good = [x for x in population if x.fitness != INVALID]
    for r, front in enumerate(nsga.fronts([x.fitness for x in good])):
        for i, room in zip(front, nsga.crowding([good[i].fitness for i in front]), strict=True):
            good[i].rank, good[i].crowding = r, room


def coverage(front: list[Individual], prims: Primitives) -> dict[str, int]:
    """How often a front mentions metrics, by the prefix of their ids."""
    return dict(Counter(prims.registry.resolve(n).id.split("_")[0] for x in front for n in field_names(x.tree)))


def _evaluate(people: list[Individual], fitness: Fitness, coach: Coach, weight: float) -> None:
    fresh = [x for x in people if x.fitness == INVALID]
    for x, f in zip(fresh, fitness.of([x.tree for x in fresh]), strict=True):
        x.fitness = f
    good = [x for x in fresh if x.fitness != INVALID]
    for x, s in zip(good, coach.critique([x.tree for x in good]), strict=True):
        x.fitness = (x.fitness[0] * (1 + weight * (min(1.0, max(0.0, s)) - 0.5)), *x.fitness[1:])


def _children(population: list[Individual], n: int, prims: Primitives, rng: np.random.Generator, c: Config) -> list[Node]:
    ranks, room = [x.rank for x in population], [x.crowding for x in population]
    pick = lambda: population[nsga.tournament(ranks, room, rng, c.tournament)].tree
    out: list[Node] = []
    while len(out) < n:
        u, a = rng.random(), pick()
        if u < c.crossover:
            out += variation.crossover(a, pick(), prims, rng)
        elif u < c.crossover + c.regrow:
            out.append(variation.regrow(a, prims, rng))
        elif u < c.crossover + c.regrow + c.operator:
            out.append(variation.other_operator(a, prims, rng))
        else:
            out.append(variation.other_literal(a, prims, rng))
    return out[:n]


def search(fitness: Fitness, prims: Primitives, config: Config = Config(), coach: Coach | None = None, label: str = "", industry: str | None = None) -> Result:
    """Every generation is evaluated in one batch. Each has `size` different trees, or as many as there are."""
    rng, coach = np.random.default_rng(config.seed), SafeCoach(coach or NeutralCoach())
    ops = [op.name for op in prims.operators]
    trees = [t for t in coach.seeds(label, industry, prims.names(), ops, 10) if variation.valid(t, prims)]
    trees += variation.ramped(prims, max(1, config.size - len(trees)), rng, config.depths)
    population = [Individual(t) for t in {canonical(t): t for t in trees}.values()]
    history: list[dict] = []
    for g in range(config.generations + 1):
        _evaluate(population, fitness, coach, config.coach_weight)
        rank(population)
        front = [x for x in population if x.rank == 0]
        history.append({"generation": g, "size": len(population), "front": len(front), "best_iv": max((x.fitness[0] for x in front), default=0.0), "best_ks": max((x.fitness[1] for x in front), default=0.0)})
        if g == config.generations:
            break
        ordered = sorted(population, key=lambda x: (x.rank, -x.crowding))
        nxt = {canonical(x.tree): x for x in ordered[: config.elite] if x.rank < nsga.UNRANKED}
        best = max(front, key=lambda x: x.fitness[0], default=None)
        if best is not None:
            nxt.setdefault(canonical(best.tree), best)
        proposed: list[Node] = []
        if config.coach_every and g and g % config.coach_every == 0:
            proposed = [t for t in coach.cross_source(coverage(front, prims), prims.names(), ops, config.proposals) if variation.valid(t, prims)]
        for t in [*proposed, *_children(population, config.size, prims, rng, config)]:
            if len(nxt) < config.size:
                nxt.setdefault(canonical(t), Individual(t))
        for _ in range(20 * config.size):  # fill up with new trees; bounded, as there may be no more
            if len(nxt) >= config.size:
                break
            try:
                t = prims.tree(variation.Kind.BOOL, int(rng.integers(config.depths[0], config.depths[1] + 1)), rng)
            except NoTree:
                continue
            if variation.valid(t, prims):
                nxt.setdefault(canonical(t), Individual(t))
        population = list(nxt.values())
    return Result(sorted((x for x in population if x.rank == 0), key=lambda x: -x.fitness[0]), population, history)
