"""From a rule to a checked card."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from panelkiln.functions import stats
from panelkiln.plans.compiler import as_tree, evaluate
from panelkiln.plans.tree import Node, field_names, to_text
from panelkiln.sources.panel import join_labels
from panelkiln.sources.registry import Registry

from .card import Client, Explanation, card_of, json_of
from .consistency import warnings

SYSTEM = "You explain early-warning rules to credit officers, in Chinese. Answer with one JSON object and nothing else."
SHAPE = {
    "metric_name_cn": "name, at most 15 characters", "business_explanation": "two or three sentences: when it fires and what that means", "use_cases": "which customers, when", "diff_vs_existing": "what existing metrics don't show",
    "threshold_advice": "a range", "review_checklist": ["1 to 10 things to check"], "referenced_fields": ["names of the metrics you mention"],
}


def prompt(tree: Node, registry: Registry, label: str, figures: dict) -> str:
    metrics = [registry.resolve(n) for n in field_names(tree)]
    lines = [f"Rule: {to_text(tree)}", f"Label: {label}", f"Measured: {json.dumps(figures, ensure_ascii=False)}", "Metrics:"]
    lines += [f"- {m.name} ({m.id}): {m.source}, {m.business}, {m.grain}, missing values: {m.missing}" for m in metrics]
    return "\n".join([*lines, "Fields of the answer:", json.dumps(SHAPE, ensure_ascii=False)])


def explain(long: DataFrame, labels: DataFrame, expression: str | Node, label: str, registry: Registry, client: Client) -> Explanation:
    """Scores the rule on the whole panel, has a card written, and checks it. A reply that is no card raises CardError or ValueError."""
    tree = as_tree(expression)
    scored = stats.score(join_labels(evaluate(long, tree, registry), labels, label), "value", "label").collect()
    figures = {k: v for k, v in scored[0].asDict().items()} if scored else {"n": 0, "n_pos": 0, "iv": 0.0, "ks": 0.0, "gini": 0.0, "trigger": None}
    raw = client.complete(SYSTEM, prompt(tree, registry, label, figures))
    card = card_of(json_of(raw))
    return Explanation(card, warnings(card, tree, registry, figures["iv"], figures["ks"]), raw)
