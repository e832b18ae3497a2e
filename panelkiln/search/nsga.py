"""Fronts, crowding and selection for several objectives, all to be maximised."""

from __future__ import annotations

import numpy as np

UNRANKED = 1_000_000


def dominates(a, b) -> bool:
    return all(x >= y for x, y in zip(a, b, strict=True)) and any(x > y for x, y in zip(a, b, strict=True))


def fronts(values: list) -> list[list[int]]:
    """Places of the values by front: none of a front is dominated by one of it or of a later front."""
    if not values:
        return []
    v = np.array(values, float)
    beats = (v[:, None] >= v[None]).all(axis=2) & (v[:, None] > v[None]).any(axis=2)
    left, out = np.ones(len(v), bool), []
    while left.any():
        now = left & ~(beats & left[:, None]).any(axis=0)
        out.append(np.nonzero(now)[0].tolist())
        left &= ~now
    return out


def crowding(values: list) -> list[float]:
    """Room around each value of a front; its ends have all the room there is."""
    v = np.array(values, float)
    if len(v) <= 2:
        return [float("inf")] * len(v)
    room = np.zeros(len(v))
    for k in range(v.shape[1]):
        order = np.argsort(v[:, k], kind="stable")
        column = v[order, k]
        room[order[[0, -1]]] = np.inf
        if column[-1] > column[0]:
            room[order[1:-1]] += (column[2:] - column[:-2]) / (column[-1] - column[0])
    return room.tolist()


def tournament(ranks: list[int], room: list[float], rng: np.random.Generator, size: int = 3) -> int:
    """Of a few drawn places, that of the lowest rank, of these the roomiest."""
    drawn = rng.integers(len(ranks), size=size)
    return int(min(drawn, key=lambda i: (ranks[i], -room[i])))
