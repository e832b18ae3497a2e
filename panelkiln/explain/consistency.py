"""Whether a card says what the rule and the figures say."""

from __future__ import annotations

import re

from panelkiln.plans.tree import Call, Node, field_names
from panelkiln.sources.registry import Registry

from .card import Card

# Words for falling and rising.
DOWN = ("低于", "下降", "下滑", "回落", "减少")
UP = ("高于", "上升", "上涨", "增加", "激增")
TOLERANCE = 0.1


def unknown_fields(card: Card, tree: Node, registry: Registry) -> list[str]:
    """Metrics that the card mentions and the rule doesn't have: those it declares, or else those found in its prose, longer names before names they contain."""
    own = {registry.resolve(n).name for n in field_names(tree)} | set(field_names(tree))
    mentioned = card.referenced_fields
    if not mentioned:
        any_name = "|".join(map(re.escape, registry.names_longest_first()))  # the first alternative that fits is the longest
        mentioned = dict.fromkeys(re.findall(any_name, card.business_explanation)) if any_name else ()
    return [n for n in mentioned if n not in own]


def wrong_direction(card: Card, tree: Node) -> list[str]:
    ops = {n.op for n in tree.walk() if isinstance(n, Call)}
    text = f"{card.business_explanation} {card.threshold_advice}"
    out = []
    for own, other, words in (("GT", "LT", DOWN), ("LT", "GT", UP)):
        said = [w for w in words if w in text]
        if own in ops and other not in ops and said:
            out.append(f"{own} against {'/'.join(said)}")
    return out


def wrong_figures(card: Card, iv: float, ks: float) -> list[str]:
    """IV and KS as quoted, where they are off by more than a tenth."""
    measured = {"IV": iv, "KS": ks}
    out = []
    for m in re.finditer(r"(?P<name>IV|KS)\D{0,3}(?P<said>\d+\.\d+)", f"{card.business_explanation} {card.diff_vs_existing}"):
        real, said = measured[m["name"]], float(m["said"])
        if real and abs(said / real - 1) > TOLERANCE:
            out.append(f"{m['name']} {m['said']}, measured {real:.3f}")
    return out


def warnings(card: Card, tree: Node, registry: Registry, iv: float, ks: float) -> list[str]:
    return [
        *(f"mentions {n}, which the rule doesn't use" for n in unknown_fields(card, tree, registry)),
        *(f"direction may be wrong: {x}" for x in wrong_direction(card, tree)),
        *(f"figure is off: {x}" for x in wrong_figures(card, iv, ks)),
    ]
