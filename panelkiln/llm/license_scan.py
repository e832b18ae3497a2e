"""Licence scan: a trained paragraph classifier with template confirmation, scored in SQL functions only.

Training (driver, numpy, seconds): every family has template texts, cut into pieces of at most `PIECE` words. Training paragraphs are pieces with
words dropped, wrapped in other words; the class `unknown` gets shuffled words, everyday sentences about rights and permissions, and
plain filler. A multinomial logistic regression over word 1- and 2-grams is fitted by proximal gradient steps; the
L1 penalty leaves a sparse table of weights. On paragraphs it wasn't fitted on, the logits' temperature is set so that the probabilities are calibrated, and
the threshold so that at most one in a hundred of the unknown ones passes: below it a paragraph counts as unknown.

Scanning (DataFrame functions): comment marks are cut off, texts are split into paragraphs at blank lines and where a line ends with a sentence, which undoes wrapping, and paragraphs of more than
`WINDOW` words into windows that overlap by half, so that every piece lies within one. A prediction stands if the window also holds at least
`CONFIRM` of the 2-grams of one of the family's pieces. A window that stands no chance of that is not scored: it holds none of the rarest 2-grams, of which each
piece has more than 1 - `CONFIRM` of its own, so that whoever holds `CONFIRM` of them holds one of these. That passes over nothing that could be found.

NULL and empty texts have no paragraphs; texts of any length are scanned whole. Repeated rows are scanned each. Other columns, whatever their names, are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

CONFIRM = 0.6
PENALTY = 2e-4
PIECE = 32
WINDOW = 64
SEED = 3

#: Notices, headers and passages of public licence texts (fixed values), by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "bsd": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under the CC0 1.0 Universal public domain dedication."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}
#: Everyday sentences that share words with licences (fixed values).
OTHERS = [
    "She renewed her driving license at the office on Friday.", "The restaurant lost its license after the inspection.", "All rights are protected by the constitution of the country.",
    "Permission to enter the building was granted by the guard.", "The new version of the software was released under great pressure.", "He worked for free at the public library in general terms.",
    "The warranty of the car covers parts under certain conditions.", "Copyright law was changed in the last century.", "The general public was informed of the new terms.", "A fishing license is required in this work area.",
    "The commons debated attribution of the quote at an international meeting.", "They are licensed doctors and work under the new foundation.", "The Apache helicopter flew over version two of the map.", "MIT is a university in Cambridge.",
    "He published a copy of the source along with this program of events.",
]


def tokens(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def pieces(text: str) -> list[list[str]]:
    """A template's sentences, each in as few even parts of at most PIECE words as there can be."""
    out = []
    for w in map(tokens, re.split(r"(?<=[.!?]) (?=[A-Z])", text)):
        n = -(-len(w) // PIECE)
        out += [w[i * len(w) // n : (i + 1) * len(w) // n] for i in range(n)]
    return out


def two_grams(w: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def telling(w: list[str], common: dict[str, int]) -> list[str]:
    """More than 1 - CONFIRM of a piece's 2-grams, those whose words are in the fewest pieces and longest."""
    two = two_grams(w)
    least = len(two) - int(np.ceil(CONFIRM * len(two) - 1e-9)) + 1
    return sorted(two, key=lambda g: (min(common[x] for x in g.split()), -len(g), g))[:least]


def grams(w: list[str]) -> list[str]:
    return w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]


class Classifier:
    """families (the last is unknown), weights (n-gram to one number a family), bias, threshold, and held-out figures."""

    def __init__(self, templates: dict[str, list[str]], seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.families = [*sorted(templates), "unknown"]
        self.pieces = [(f, w) for f in self.families[:-1] for t in templates[f] for w in pieces(t)]
        common = {x: sum(x in w for _, w in self.pieces) for _, w in self.pieces for x in w}
        self.telling = sorted({g for _, w in self.pieces for g in telling(w, common)})
        names = sorted({g for _, w in self.pieces for g in grams(w)})
        self.number = {g: i for i, g in enumerate(names)}
        filler = ["".join(rng.choice(list("aeiounrstlhd"), rng.integers(2, 9))) for _ in range(400)]
        words = sorted(common)
        by_family = {f: [w for g, w in self.pieces if g == f] for f in self.families[:-1]}

        def paragraph(k: int) -> list[str]:
            around = lambda: list(rng.choice(filler, rng.integers(0, 20)))
            if k < len(self.families) - 1:
                mine = by_family[self.families[k]]
                w = mine[rng.integers(len(mine))]
                if rng.random() < 0.5:
                    w = [x for x in w if len(w) < 8 or rng.random() > 0.08]
            else:
                kind = rng.integers(3)
                w = tokens(OTHERS[rng.integers(len(OTHERS))]) if kind == 0 else list(rng.choice(words, rng.integers(3, 25))) if kind == 1 else []
            return around() + list(w) + around()

        def sample(n: int) -> tuple[np.ndarray, np.ndarray]:
            y = rng.integers(0, len(self.families), n)
            y[rng.random(n) < 0.3] = len(self.families) - 1
            x = np.zeros((n, len(names)))
            for i, k in enumerate(y):
                for g in grams(paragraph(int(k))):
                    j = self.number.get(g)
                    if j is not None:
                        x[i, j] = 1
            return x, y

        self.sample = sample
        x, y = sample(1600)
        hot = np.eye(len(self.families))[y]
        w, b = np.zeros((len(names), len(self.families))), np.zeros(len(self.families))
        rate = 2.0
        for _ in range(300):
            p = self._soft(x @ w + b)
            w -= rate * x.T @ (p - hot) / len(y)
            b -= rate * (p - hot).mean(axis=0)
            w = np.sign(w) * np.maximum(np.abs(w) - rate * PENALTY, 0)
        keep = np.abs(w).sum(axis=1) > 0
        x, y = sample(1500)
        logits = x @ w + b
        # calibration: the temperature under which the held-out labels are likeliest
        loss = lambda t: -np.log(self._soft(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
        self.temperature = float(min(np.geomspace(0.2, 5, 60), key=loss))
        self.weights = {g: [round(v, 6) for v in (w[i] / self.temperature).tolist()] for g, i in self.number.items() if keep[i]}
        self.bias = [round(v, 6) for v in (b / self.temperature).tolist()]
        p = self._soft(logits / self.temperature)
        known = p[:, :-1].max(axis=1)
        self.threshold = float(max(0.5, np.quantile(known[y == len(self.families) - 1], 0.99)))
        guess = np.where(known >= self.threshold, p[:, :-1].argmax(axis=1), len(self.families) - 1)
        self.accuracy = float((guess == y).mean())
        self.predict = lambda x: self._soft((x @ w + b) / self.temperature)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


@lru_cache(1)
def trained(seed: int = SEED) -> Classifier:
    return Classifier(TEMPLATES, seed)


_MARKS = "(?m)^[ \\t]*(?:/{2,}|/?\\*+/?|#+|-{2,}|;+|%+|<!--|>)[ \\t]?|(?:\\*/|-->)[ \\t]*$"
_BLANK = "\\n[ \\t\\r]*\\n\\s*"
_ENDS = "[.!?][ \\t\\r]*\\n"
_OTHER = "[^a-z0-9]+"


def paragraphs_of(text: Column) -> Column:
    """A text's paragraphs without comment marks, blank ones left out."""
    plain = F.regexp_replace(F.regexp_replace(text, _MARKS, ""), _ENDS, "$0\n")
    return F.filter(F.split(plain, _BLANK, -1), lambda x: x.rlike("\\S"))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _OTHER), "")


def _windows(w: Column) -> Column:
    """Windows of WINDOW words, one at each half of it, as far as they hold words that the one before doesn't."""
    half = WINDOW // 2
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(w) - WINDOW) / F.lit(half)).cast("int"), F.lit(0)))
    return F.transform(starts, lambda i: F.slice(w, i * half + 1, F.lit(WINDOW)))


def _two(w: Column) -> Column:
    return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.slice(w, 1, 0))


def classified(w: Column, model: Classifier) -> Column:
    """family and probability of a window (words); family `unknown` below the threshold or without a confirming template."""
    n = len(model.families)
    table = F.from_json(F.lit(json.dumps(model.weights)), "map<string,array<double>>")
    add = lambda a, g: F.coalesce(F.zip_with(a, F.try_element_at(table, g), lambda x, y: x + y), a)
    bias = F.array(*[F.lit(v) for v in model.bias])
    names = F.array(*[F.lit(g) for g in sorted(model.weights)])
    held = F.array(*[F.struct(F.lit(f).alias("family"), F.array(*[F.lit(x) for x in two_grams(t)]).alias("two")) for f, t in model.pieces if len(t) > 1])

    def judge(two: Column) -> Column:
        # the table's own n-grams first: it is searched from end to end
        logits = F.aggregate(F.array_intersect(names, F.concat(w, two)), bias, add)

        def soft(z: Column) -> Column:
            norm = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(z)))
            return F.transform(z, lambda x: F.exp(x - F.array_max(z)) / norm)

        def best(p: Column) -> Column:
            known = F.slice(p, 1, n - 1)
            at = F.array_position(known, F.array_max(known)).cast("int")
            family = F.element_at(F.array(*[F.lit(f) for f in model.families[:-1]]), at)

            def confirmed(family: Column) -> Column:
                share = F.array_max(F.transform(F.filter(held, lambda x: x["family"] == family), lambda x: F.size(F.array_intersect(two, x["two"])) / F.size(x["two"])))
                sure = lambda s: (F.array_max(known) >= model.threshold) & (s >= CONFIRM)
                return let(share, lambda s: F.struct(F.when(sure(s), family).otherwise("unknown").alias("family"), F.array_max(known).alias("probability"), s.alias("template_share")))

            return let(family, confirmed)

        return let(let(logits, soft), best)

    return let(_two(w), judge)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", model: Classifier | None = None) -> DataFrame:
    """One row a document: key, n_paragraphs, n_scanned (windows that could be confirmed) and found, for each of these: paragraph number, family, probability, template_share.

    Of neighbouring windows of a paragraph that find the same family one is given.
    """
    model = model or trained()
    telling_two = F.array(*[F.lit(g) for g in model.telling])
    telling_one = F.array(*[F.lit(x) for x in sorted({max(g.split(), key=len) for g in model.telling})])
    parts = paragraphs_of(F.coalesce(F.col(text), F.lit("")))
    df = docs.select(F.col(key), parts.alias("__parts"), F.arrays_overlap(_words(F.coalesce(F.col(text), F.lit(""))), telling_one).alias("__some"))

    def windows(par: Column, i: Column) -> Column:
        some = F.filter(_windows(_words(par)), lambda w: F.arrays_overlap(w, telling_one))
        return F.transform(F.filter(some, lambda w: F.arrays_overlap(_two(w), telling_two)), lambda w: F.struct(i.cast("long").alias("paragraph"), w.alias("w")))

    # a telling 2-gram's longer word is in the text, or none of its windows has the 2-gram
    cut = F.when(F.col("__some"), F.flatten(F.transform("__parts", windows)))
    df = df.select(key, F.size("__parts").cast("long").alias("n_paragraphs"), F.coalesce(cut, F.array().cast("array<struct<paragraph:bigint,w:array<string>>>")).alias("__windows"))
    found = F.transform("__windows", lambda x: let(classified(x["w"], model), lambda c: F.struct(x["paragraph"].alias("paragraph"), c["family"].alias("family"), c["probability"].alias("probability"), c["template_share"].alias("template_share"))))
    df = df.select(key, "n_paragraphs", F.size("__windows").cast("long").alias("n_scanned"), found.alias("__found"))
    same = lambda a, x: F.when(F.exists(a, lambda y: (y["paragraph"] == x["paragraph"]) & (y["family"] == x["family"])), a).otherwise(F.concat(a, F.array(x)))
    kind = "array<struct<paragraph:bigint,family:string,probability:double,template_share:double>>"
    return df.select(key, "n_paragraphs", "n_scanned", F.aggregate("__found", F.array().cast(kind), same).alias("found"))
