"""Runs and cards as JSON files."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict

from panelkiln.explain.card import Explanation, card_of
from panelkiln.plans.tree import Node, canonical, to_dict, to_text
from panelkiln.search.loop import Config, Result


def _write(path: str, data) -> str:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=1)
    return path


def save_run(folder: str, run_id: str, result: Result, config: Config, **about) -> str:
    """pareto.json, history.json and config.json below folder/run_id, and a line in folder/index.jsonl."""
    home = os.path.join(folder, run_id)
    _write(os.path.join(home, "pareto.json"), [{"expr": to_dict(x.tree), "sexpr": to_text(x.tree), "fitness": list(x.fitness)} for x in result.front])
    _write(os.path.join(home, "history.json"), result.history)
    _write(os.path.join(home, "config.json"), {**asdict(config), **about})
    with open(os.path.join(folder, "index.jsonl"), "a", encoding="utf-8") as f:
        f.write(json.dumps({"run_id": run_id, "front": len(result.front), **about}, ensure_ascii=False) + "\n")
    return home


def card_name(tree: Node) -> str:
    """Equal rules, 0 and 0.0 alike, share a file."""
    return hashlib.sha256(canonical(tree).encode()).hexdigest()[:12]


def save_card(folder: str, tree: Node, e: Explanation, label: str, industry: str | None = None) -> str:
    return _write(os.path.join(folder, f"{card_name(tree)}.json"), {"expr": to_dict(tree), "sexpr": to_text(tree), "label": label, "industry": industry, "explanation": {"card": e.card.as_dict(), "warnings": e.warnings}})


def load_card(path: str) -> tuple[Explanation, str, str | None]:
    """(explanation, expression, industry), from a saved card, an envelope with `card`, or a bare card."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    inner = data.get("explanation", data)
    warnings = inner.get("warnings", []) if "card" in inner else []
    return Explanation(card_of(inner.get("card", inner)), warnings), data.get("sexpr", ""), data.get("industry")
