"""Licence scans: a trained paragraph classifier whose findings templates confirm.

A paragraph is a line; a notice that is broken over lines is looked for in the
joined words of the lines between two blank ones, comment marks left out, and judged
from its first to its last shared shingle. A paragraph's distinct word 1- and 2-grams are the features of a
multinomial logistic regression over licence families and an unknown class,
trained here on templates, cut and mixed copies of them, and other sentences; a
temperature fitted on mixtures that were not trained on calibrates it. A finding
is confirmed if it holds at least 0.8 of the five-word shingles of one of the
family's templates. Features without a word of their own (only "the", "of" and
the like) do not exist, so a line without any such word is unknown exactly, and
is passed over before its n-grams are made.

Training needs no Spark and takes templates of a fixed number. Scoring is made of
Spark's own functions only, within a row: no shuffle, no Python on executors.

Edge cases: null and empty texts have no finding; repeated rows are scanned each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motrac.llm.common import documents

UNKNOWN = "unknown"
#: Least calibrated probability and least share of a template's shingles.
MIN_PROBABILITY, MIN_SIMILARITY, SHINGLE = 0.5, 0.8, 5

#: Notices by family. They are the wordings that the licences ask for or that are usual.
TEMPLATES: dict[str, list[str]] = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This project is released under the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-or-later", "Distributed under the GNU GPL v3 license"],
    "LGPL": ["This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License", "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Use of this source code is governed by a BSD-style license", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under the Creative Commons Attribution license"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "CC0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work", "SPDX-License-Identifier: CC0-1.0"],
    "Proprietary": ["All rights reserved. No part of this publication may be reproduced without permission.", "Copyright, all rights reserved.", "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential."],
}

#: Sentences of the unknown class, some with words that licences also use.
OTHERS = [
    "The driver showed a valid licence to the officer at the border.", "Her fishing license was renewed in the spring of last year.", "The general public is invited to the opening of the museum.", "An apache helicopter landed near the river.",
    "Students at MIT built a small robot for the contest.", "The commons was a field where anyone could graze sheep.", "Please redistribute the chairs before the meeting.", "The software is easy to use and free of charge for schools.",
    "Version 2.0 of the plan was published on Monday.", "Permission to land was granted by the tower.", "A creative approach to attribution in history writing.", "Under the terms of the treaty the border was moved.",
    "This work is the result of ten years of research.", "The source of the river lies in the mountains.", "The file was copied to the other machine.", "Rights and duties of citizens are listed in the constitution.",
    "We walked along the shore and talked about the weather.", "The recipe needs two eggs, flour and a little salt.", "Released on Friday, the film found a large public.", "Use the left door in case of fire.",
    "The foundation of the house is made of stone.", "Die Software ist frei und kann kopiert werden.", "Le permis de conduire est obligatoire.", "El libro fue publicado en la ciudad.",
]
STOP = frozenset("a an and any are as at be by for from in is it may not of on or the this that to under use used with without you your was we were he she its can all no 0 1 2 3 4 v".split())
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def grams_of(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def shingles_of(words: list[str], size: int = SHINGLE) -> list[str]:
    """Distinct shingles of size words; fewer words are one shingle."""
    return sorted({" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}) if words else []


@dataclass
class LicenseModel:
    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float = 1.0
    shingles: dict[str, list[list[str]]] = field(default_factory=dict)

    def probabilities(self, paragraph: str) -> np.ndarray:
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in sorted(grams_of(words_of(paragraph))) if g in self.weights), np.zeros(len(self.bias)))
        e = np.exp((z - z.max()) / self.temperature)
        return e / e.sum()

    @property
    def anchors(self) -> list[str]:
        return sorted({w for g in self.weights for w in g.split(" ") if w not in STOP})


def _mixtures(rng: random.Random, n: int) -> list[tuple[str, str]]:
    """Templates with some words before and after, cut ends and changed numbers; and other sentences, whole and mixed."""
    filler = [w for s in OTHERS for w in words_of(s)]
    legal = [w for ts in TEMPLATES.values() for t in ts for w in words_of(t)]
    out = []
    for _ in range(n):
        for family, templates in TEMPLATES.items():
            own = words_of(rng.choice(templates))
            own = [w if not w.isdigit() or rng.random() < 0.8 else str(rng.randint(1, 4)) for w in own]
            if len(own) > 12 and rng.random() < 0.3:
                own = own[: rng.randint(10, len(own))]
            extra = [rng.choice(filler) for _ in range(rng.choice([0, 0, 3, 12, 40]))]
            cut = rng.randint(0, len(extra))
            out.append((" ".join([*extra[:cut], *own, *extra[cut:]]), family))
        for _ in range(6):
            own = words_of(rng.choice(OTHERS))
            own += [rng.choice(filler) for _ in range(rng.choice([0, 5, 30]))]
            own += [rng.choice(legal) for _ in range(rng.choice([0, 0, 1, 2, 3]))]
            rng.shuffle(own) if rng.random() < 0.4 else None
            out.append((" ".join(own), UNKNOWN))
    return out


@lru_cache(maxsize=4)
def fit(seed: int = 7, rounds: int = 60, steps: int = 300, l2: float = 2e-4) -> LicenseModel:
    """Full-batch gradient descent with momentum; the same seed gives the same model."""
    rng = random.Random(seed)
    train = _mixtures(rng, rounds) + [(t, f) for f, ts in TEMPLATES.items() for t in ts] * 3 + [(t, UNKNOWN) for t in OTHERS] * 2
    families = [*TEMPLATES, UNKNOWN]
    of_templates = {g for ts in TEMPLATES.values() for t in ts for g in grams_of(words_of(t))}
    vocabulary = sorted(g for g in of_templates if not all(w in STOP for w in g.split(" ")))
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(rows):
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for i, (t, _) in enumerate(rows):
            x[i, [at[g] for g in grams_of(words_of(t)) if g in at]] = 1
        return x, np.eye(len(families), dtype=np.float32)[[families.index(f) for _, f in rows]]

    x, y = matrix(train)
    w, b = np.zeros((len(vocabulary), len(families)), np.float32), np.zeros(len(families), np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - y) / len(x)
        vw, vb = 0.9 * vw - (x.T @ g + l2 * w), 0.9 * vb - g.sum(0)
        w, b = w + vw, b + vb
    tx, ty = matrix(_mixtures(rng, 20))
    z = tx @ w + b

    def loss(t):
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(-(ty * (s - np.log(np.exp(s).sum(1, keepdims=True)))).sum())

    temperature = float(min(np.geomspace(0.2, 5, 41), key=loss))
    weights = {g: [round(float(v), 5) for v in w[i]] for g, i in at.items()}
    return LicenseModel(families, weights, [round(float(v), 5) for v in b], round(temperature, 5), {f: [shingles_of(words_of(t)) for t in ts] for f, ts in TEMPLATES.items()})


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _strings(values: list[str]) -> Column:
    return F.split(F.lit("\u0001".join(values)), "\u0001")


def _findings(model: LicenseModel, lines: Column) -> Column:
    """Array of (paragraph, family, probability, similarity) for the lines (at, words) that the model gives to a family."""
    return _judged(model, F.filter(lines, lambda p: F.arrays_overlap(p["words"], _strings(model.anchors))))


def _judged(model: LicenseModel, own: Column) -> Column:
    """The findings among runs of words (at, words)."""
    vocabulary = sorted(model.weights)
    keys = _strings(vocabulary)
    table = F.from_json(F.lit(str([model.weights[g] for g in vocabulary])), "array<array<double>>")
    families = _strings(model.families)
    bias = F.from_json(F.lit(str(model.bias)), "array<double>")
    templates = F.from_json(F.lit("[" + ",".join("[" + ",".join("[" + ",".join(f'"{s}"' for s in t) + "]" for t in model.shingles.get(f, [])) + "]" for f in model.families) + "]"), "array<array<array<string>>>")

    def row(p: Column) -> Column:
        words = p["words"]
        pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
        present = F.array_intersect(F.concat(words, pairs), keys)
        z = F.aggregate(present, bias, lambda acc, g: F.zip_with(acc, F.element_at(table, F.array_position(keys, g).cast("int")), lambda x, y: x + y))
        return F.struct(p["at"].alias("at"), words.alias("words"), z.alias("z"))

    def scored(p: Column) -> Column:
        top = F.array_max(p["z"])
        total = F.aggregate(p["z"], F.lit(0.0), lambda acc, x: acc + F.exp((x - top) / model.temperature))
        return F.struct(p["at"].alias("at"), p["words"].alias("words"), F.array_position(p["z"], top).cast("int").alias("k"), (1 / total).alias("probability"))

    def confirmed(p: Column) -> Column:
        n = F.size(p["words"])
        own = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - SHINGLE + 1)), lambda i: F.concat_ws(" ", F.slice(p["words"], i, SHINGLE)))
        # A template shorter than a shingle is one shingle of its own length: it is looked for in the joined words.
        line = F.concat(F.lit(" "), F.concat_ws(" ", p["words"]), F.lit(" "))
        share = F.transform(F.element_at(templates, p["k"]), lambda t: F.when(F.size(t) == 1, F.contains(line, F.concat(F.lit(" "), t[0], F.lit(" "))).cast("double")).otherwise(F.size(F.array_intersect(t, own)) / F.size(t)))
        return F.struct(p["at"].alias("paragraph"), F.element_at(families, p["k"]).alias("family"), F.round(p["probability"], 6).alias("probability"), F.round(F.coalesce(F.array_max(share), F.lit(0.0)), 6).alias("similarity"))

    own = F.transform(F.transform(own, row), scored)
    own = F.filter(own, lambda p: (p["k"] < len(model.families)) & (p["probability"] >= MIN_PROBABILITY))
    return F.transform(own, confirmed)


def _needed(model: LicenseModel) -> list[str]:
    """Words of which a text that holds enough of any template has one at least.

    A word that stands in more shingles than may be missing is in every such text;
    of these the fewest that serve all templates are taken, rarer ones first.
    """
    sure = []
    for t in (t for f in model.families for t in model.shingles.get(f, [])):
        spare = len(t) - int(np.ceil(MIN_SIMILARITY * len(t) - 1e-9))
        sure.append({w for x in t for w in x.split(" ") if w not in STOP and sum(w in y.split(" ") for y in t) > spare})
    if not all(sure):
        return model.anchors
    common, out = {w for o in OTHERS for w in words_of(o)}, []
    while sure:
        word = max(sorted(set().union(*sure)), key=lambda w: (sum(w in x for x in sure) / (4 if w in common else 1)))
        out.append(word)
        sure = [x for x in sure if word not in x]
    return out


def _wrapped(model: LicenseModel, lines: Column, cuts: Column) -> Column:
    """Findings like those of _findings for notices that run over line ends, from lines (at, words) and the places of blank ones.

    Lines between blank ones are one paragraph. Where it holds enough of a template
    that none of its lines holds alone, the words from the first to the last shared
    shingle are judged like a line, and kept if confirmed, one for each family; paragraph
    is the line they begin on.
    """
    all_templates = [t for f in model.families for t in model.shingles.get(f, [])]
    templates = F.from_json(F.lit("[" + ",".join("[" + ",".join(f'"{x}"' for x in t) + "]" for t in all_templates) + "]"), "array<array<string>>")
    known = _strings(sorted({x for t in all_templates for x in t}))
    short = sorted({len(t[0].split(" ")) for t in all_templates if len(t) == 1})

    def shingles(words: Column, size: int) -> Column:
        return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - size + 1)), lambda i: F.concat_ws(" ", F.slice(words, i, size)))).otherwise(F.array().cast("array<string>"))

    def hits(words: Column) -> Column:
        """(shingle, its place, its words) for each shingle of a template, in order of size and place."""

        def placed(n: int) -> Column:
            return F.transform(shingles(words, n), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"), F.lit(n).alias("n")))

        every = [placed(n) for n in sorted({SHINGLE, *short})]
        return F.filter(F.concat(*every), lambda h: F.array_contains(known, h["x"]))

    def spans(p: Column) -> Column:
        """The words of each template that the paragraph holds and none of its lines does."""

        def span(t: Column) -> Column:
            own = F.filter(p["hits"], lambda h: F.array_contains(t, h["x"]))
            return F.struct(F.array_min(F.transform(own, lambda h: h["i"])).alias("first"), F.array_max(F.transform(own, lambda h: h["i"] + h["n"])).alias("last"), share(t, p["hits"]).alias("share"))

        def share(t: Column, held: Column) -> Column:
            return F.size(F.array_intersect(t, F.transform(held, lambda h: h["x"]))) / F.size(t)

        missing = F.filter(templates, lambda t: (share(t, p["hits"]) >= MIN_SIMILARITY) & ~F.exists(p["lines"], lambda l: share(t, hits(l["words"])) >= MIN_SIMILARITY))
        every = F.transform(missing, span)
        # One wording is part of another licence's too: where two overlap, the better held one stays.
        own = F.filter(every, lambda a: ~F.exists(every, lambda b: (b["share"] > a["share"]) & (b["first"] < a["last"]) & (a["first"] < b["last"])))
        return F.transform(own, lambda a: F.struct(F.element_at(p["ats"], a["first"]).alias("at"), F.slice(p["words"], a["first"], a["last"] - a["first"]).alias("words")))

    at = F.transform(F.sequence(F.lit(1), F.size(cuts) - 1), lambda k: F.slice(lines, F.element_at(cuts, k) + 2, F.element_at(cuts, k + 1) - F.element_at(cuts, k) - 1))
    own = F.filter(at, lambda b: (F.size(b) > 1) & F.exists(b, lambda l: F.arrays_overlap(l["words"], _strings(_needed(model)))))
    own = F.transform(own, lambda b: F.struct(b.alias("lines"), F.flatten(F.transform(b, lambda l: l["words"])).alias("words"), F.flatten(F.transform(b, lambda l: F.array_repeat(l["at"], F.size(l["words"])))).alias("ats")))
    own = F.transform(own, lambda p: F.struct(p["lines"].alias("lines"), p["words"].alias("words"), p["ats"].alias("ats"), hits(p["words"]).alias("hits")))

    def best(p: Column) -> Column:
        """The likeliest confirmed finding of each family in a paragraph."""
        sure = F.array_sort(F.transform(F.filter(_judged(model, spans(p)), lambda f: f["similarity"] >= MIN_SIMILARITY), lambda f: F.struct((-f["probability"]).alias("p"), f["paragraph"].alias("at"), f.alias("f"))))
        return F.aggregate(sure, F.filter(F.transform(sure, lambda x: x["f"]), lambda f: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda f: f["family"] == x["f"]["family"]), acc).otherwise(F.concat(acc, F.array(x["f"]))))

    return F.flatten(F.transform(F.filter(own, lambda p: F.size(p["hits"]) > 0), best))


def scan(docs: DataFrame, model: LicenseModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, family (of the likeliest confirmed finding, else null), n_confirmed, n_unconfirmed, findings."""
    model = model or fit()
    lines = documents(docs, id_col, text_col).select("doc_id", F.transform(F.split("text", r"\r?\n"), lambda p, i: F.struct(i.alias("at"), _words(p).alias("words"))).alias("lines"))
    blank = F.transform(F.filter("lines", lambda l: F.size(l["words"]) == 0), lambda l: l["at"])
    cuts = lines.select("doc_id", "lines", F.concat(F.array(F.lit(-1)), blank, F.array(F.size("lines"))).alias("cuts"))
    parts = cuts.select("doc_id", _findings(model, F.col("lines")).alias("own"), _wrapped(model, F.col("lines"), F.col("cuts")).alias("wrapped"))
    found = parts.select("doc_id", F.concat("own", "wrapped").alias("findings"))
    sure = F.filter("findings", lambda f: f["similarity"] >= MIN_SIMILARITY)
    best = F.array_max(F.transform(sure, lambda f: F.struct(f["probability"].alias("p"), (-f["paragraph"]).alias("at"), f["family"].alias("family"))))
    return found.select("doc_id", best["family"].alias("family"), F.size(sure).alias("n_confirmed"), (F.size("findings") - F.size(sure)).alias("n_unconfirmed"), "findings")
