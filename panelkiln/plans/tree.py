"""Expression trees and their forms: text in prefix notation, dictionaries, JSON.

    (GT (PctChange 营业收入 12) -0.1)

A head names an operator. In argument places a quoted atom is a string; other atoms are numbers if they read as numbers
(a float if they have a point or an exponent), else fields. Fields whose names could be taken for something else are written
in backquotes, so that text and tree map to each other both ways.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

from panelkiln.operators import REGISTRY


class ParseError(ValueError):
    """What is wrong, and where (counted from 0)."""

    def __init__(self, what: str, at: int) -> None:
        super().__init__(f"{what} at offset {at}")
        self.at = at


@dataclass(frozen=True)
class Node:
    def walk(self) -> Iterator[Node]:
        yield self
        for child in getattr(self, "args", ()):
            yield from child.walk()


@dataclass(frozen=True)
class Field(Node):
    name: str


@dataclass(frozen=True)
class Literal(Node):
    value: int | float | str | bool


@dataclass(frozen=True)
class Call(Node):
    op: str
    args: tuple[Node, ...]


_TOKEN = re.compile(r'(?P<space>\s+)|(?P<open>\()|(?P<close>\))|"(?P<string>[^"]*)"|`(?P<field>[^`]*)`|(?P<atom>[^\s()"`]+)')
_INT, _FLOAT = re.compile(r"[+-]?\d+\Z", re.A), re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\Z", re.A)


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ParseError("unterminated quotes", at)
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[m.lastgroup], at))
        at = m.end()
    return out


def _atom(word: str) -> Node:
    if _INT.match(word):
        return Literal(int(word))
    return Literal(float(word)) if _FLOAT.match(word) else Field(word)


def parse(text: str) -> Node:
    """One expression; anything after it is an error."""
    tokens = _tokens(text)
    stack: list[tuple[str, int, list[Node]]] = []
    done: Node | None = None
    k = 0
    while k < len(tokens):
        kind, word, at = tokens[k]
        if done is not None:
            raise ParseError(f"unexpected {word!r} after the expression", at)
        k += 1
        if kind == "open":
            if k == len(tokens) or tokens[k][0] != "atom":
                raise ParseError("an operator's name is missing", tokens[k][2] if k < len(tokens) else at)
            if tokens[k][1] not in REGISTRY:
                raise ParseError(f"unknown operator {tokens[k][1]!r}", tokens[k][2])
            stack.append((tokens[k][1], at, []))
            k += 1
            continue
        if kind == "close":
            if not stack:
                raise ParseError("unexpected ')'", at)
            op, _, args = stack.pop()
            node: Node = Call(op, tuple(args))
        else:
            node = Literal(word) if kind == "string" else Field(word) if kind == "field" else _atom(word)
        if stack:
            stack[-1][2].append(node)
        else:
            done = node
    if stack:
        raise ParseError(f"({stack[-1][0]} is not closed", stack[-1][1])
    if done is None:
        raise ParseError("empty expression", 0)
    return done


def to_text(node: Node) -> str:
    if isinstance(node, Call):
        return f"({' '.join([node.op, *map(to_text, node.args)])})"
    if isinstance(node, Literal):
        return f'"{node.value}"' if isinstance(node.value, str) else repr(node.value)
    plain = node.name and _TOKEN.fullmatch(node.name) and _TOKEN.fullmatch(node.name).lastgroup == "atom" and isinstance(_atom(node.name), Field)
    return node.name if plain else f"`{node.name}`"


def to_dict(node: Node) -> dict:
    if isinstance(node, Call):
        return {"op": node.op, "args": [to_dict(a) for a in node.args]}
    return {"field": node.name} if isinstance(node, Field) else {"literal": node.value}


def from_dict(d: dict) -> Node:
    if "op" in d:
        return Call(d["op"], tuple(from_dict(a) for a in d["args"]))
    return Field(d["field"]) if "field" in d else Literal(d["literal"])


def to_json(node: Node) -> str:
    return json.dumps(to_dict(node), ensure_ascii=False, sort_keys=True)


def from_json(text: str) -> Node:
    return from_dict(json.loads(text))


def canonical(node: Node) -> str:
    """JSON in which equal numbers look equal (2.0 as 2): the key under which results are kept."""

    def plain(n: Node) -> Node:
        if isinstance(n, Call):
            return Call(n.op, tuple(map(plain, n.args)))
        if isinstance(n, Literal) and isinstance(n.value, float) and math.isfinite(n.value) and n.value == int(n.value):
            return Literal(int(n.value))
        return n

    return json.dumps(to_dict(plain(node)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def field_names(node: Node) -> list[str]:
    """Each field once, in the order of first mention."""
    return list(dict.fromkeys(n.name for n in node.walk() if isinstance(n, Field)))


def leaf_count(node: Node) -> int:
    return sum(not isinstance(n, Call) for n in node.walk())
