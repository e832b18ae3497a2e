"""Explanation cards and the client that writes them."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Protocol

# The card's limits.
NAME_CHARS, CHECKS = 15, 10


class CardError(ValueError):
    """A card that isn't one."""


@dataclass(frozen=True)
class Card:
    metric_name_cn: str
    business_explanation: str
    use_cases: str
    diff_vs_existing: str
    threshold_advice: str
    review_checklist: tuple[str, ...]
    referenced_fields: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if len(self.metric_name_cn) > NAME_CHARS:
            raise CardError(f"a name has at most {NAME_CHARS} characters: {self.metric_name_cn!r}")
        if not 1 <= len(self.review_checklist) <= CHECKS:
            raise CardError(f"a card has 1 to {CHECKS} things to check")

    def as_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}


def card_of(data: dict) -> Card:
    texts = ("metric_name_cn", "business_explanation", "use_cases", "diff_vs_existing", "threshold_advice")
    wrong = [k for k in texts if not isinstance(data.get(k), str)]
    lists = {k: data.get(k, []) for k in ("review_checklist", "referenced_fields")}
    wrong += [k for k, v in lists.items() if not (isinstance(v, (list, tuple)) and all(isinstance(x, str) for x in v))]
    if wrong:
        raise CardError(f"missing or wrong: {', '.join(wrong)}")
    return Card(**{k: data[k] for k in texts}, **{k: tuple(v) for k, v in lists.items()})


@dataclass
class Explanation:
    card: Card
    warnings: list[str] = field(default_factory=list)
    raw: str | None = None


def json_of(text: str) -> dict:
    """The first JSON object of a reply, whatever stands around it."""
    for m in re.finditer(r"\{", text):
        try:
            found, _ = json.JSONDecoder().raw_decode(text, m.start())
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise ValueError(f"no JSON object in {text[:200]!r}")


class Client(Protocol):
    def complete(self, system: str, user: str, max_tokens: int = 1024) -> str: ...


class Transient(RuntimeError):
    """A failure that may pass: rate limits, time-outs, broken connections."""


@dataclass
class Retrying:
    """Tries a client again after transient failures, after 1, 2, 4 ... seconds."""

    client: Client
    retries: int = 2
    base: float = 1.0
    sleep: Callable[[float], None] = time.sleep

    def complete(self, system: str, user: str, max_tokens: int = 1024) -> str:
        for k in range(self.retries + 1):
            try:
                return self.client.complete(system, user, max_tokens)
            except (Transient, TimeoutError, ConnectionError):
                if k == self.retries:
                    raise
                self.sleep(self.base * 2**k)
        raise AssertionError


@dataclass
class Canned:
    """Gives the same replies, in turn; for tests and for work without a model."""

    replies: list[str]
    asked: list[tuple[str, str]] = field(default_factory=list)

    def complete(self, system: str, user: str, max_tokens: int = 1024) -> str:
        self.asked.append((system, user))
        return self.replies[(len(self.asked) - 1) % len(self.replies)]
