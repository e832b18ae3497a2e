"""A coach that asks a language model. Whatever can't be read counts as nothing said; the search goes on."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass

from panelkiln.explain.card import Client, json_of
from panelkiln.plans.tree import Node, ParseError, parse, to_text

log = logging.getLogger(__name__)

SYSTEM = "You know early-warning indicators of companies. Rules are written as (Operator argument ... literal). Answer with one JSON object and nothing else."


@dataclass
class ModelCoach:
    """The three questions of the coach protocol, put to a client."""

    client: Client

    def _ask(self, what: str, **about) -> dict:
        try:
            return json_of(self.client.complete(SYSTEM, f"{what}\n{json.dumps(about, ensure_ascii=False)}"))
        except Exception as e:
            log.warning("no answer from the coach: %s", e)
            return {}

    def _trees(self, reply: dict, k: int) -> list[Node]:
        out: list[Node] = []
        rules = reply.get("rules")
        for text in rules if isinstance(rules, list) else ():
            try:
                out.append(parse(text))
            except (ParseError, TypeError) as e:
                log.info("not a rule: %s", e)
        return out[:k]

    def seeds(self, label: str, industry: str | None, fields: list[str], operators: list[str], k: int) -> list[Node]:
        return self._trees(self._ask(f'Propose up to {k} rules: {{"rules": [...]}}', label=label, industry=industry, fields=fields, operators=operators), k)

    def cross_source(self, coverage: dict[str, int], fields: list[str], operators: list[str], k: int) -> list[Node]:
        return self._trees(self._ask(f'Propose up to {k} rules that combine sources mentioned seldom: {{"rules": [...]}}', coverage=coverage, fields=fields, operators=operators), k)

    def critique(self, trees: list[Node]) -> list[float]:
        neutral = [0.5] * len(trees)
        if not trees:
            return neutral
        scores = self._ask('How plausible is each rule, from 0 to 1: {"scores": [...]}', rules=[to_text(t) for t in trees]).get("scores")
        if not isinstance(scores, list) or len(scores) != len(trees):
            return neutral
        return [min(1.0, max(0.0, float(s))) if isinstance(s, (int, float)) else 0.5 for s in scores]
