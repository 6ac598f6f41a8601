"""License scans with a trained paragraph classifier, scored by DataFrame expressions alone.

A paragraph (a line) has word n-grams, n from 1 to 3. A softmax regression over those that speak
for a licence knows the families, one class for licences of no listed family (``unknown``) and
one for anything else. It is fitted on the driver on templates and made-up variants of them (a
fixed, seeded set, no corpus rows). Its probabilities are calibrated by a temperature chosen by
cross-validation over whole templates: each is judged by a model that has seen neither it nor any
variant of it. A predicted family is confirmed by comparison with its templates: the share of
some template's n-grams that the paragraph has.

The model's own n-grams decide which paragraphs need their words taken apart: one that has none
of them is of the other class by the bias alone, and a regular expression made of the shortest of
them (see ``pattern``) finds those that have one. The model (some thousand n-grams, whatever the
data) is part of the plan; rows are neither moved nor exploded.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.fingerprint import let

OTHER = "other"
UNKNOWN = "unknown"
CONFIRMED = 0.6
#: How much likelier an n-gram is in a licence than elsewhere, to be one of the model's.
SPEAKS = 4.0

# Public licence notices by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "This software is distributed under the terms of the MIT license.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
        "Apache License Version 2.0, January 2004",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Distributed under the GNU GPL v2 license.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Released under the LGPL license, version 3.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Distributed under the AGPL license.",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the 2-clause BSD license.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Released under the Mozilla Public License 2.0.",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
        "Licensed under the EPL license.",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the CC BY-SA 4.0 license.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0.",
        "Released under the Creative Commons CC0 1.0 Universal public domain dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ],
}

# Public notices of licences outside the families.
UNLISTED = [
    "ISC License",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Boost Software License - Version 1.0 - August 17th, 2003",
    "Distributed under the Boost Software License, Version 1.0.",
    "SPDX-License-Identifier: BSL-1.0",
    "SPDX-License-Identifier: ISC",
    "SPDX-License-Identifier: Zlib",
    "This code is released under the zlib license.",
    "This software is provided 'as-is', without any express or implied warranty.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "SPDX-License-Identifier: EUPL-1.2",
    "Licensed under the Artistic License 2.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "SPDX-License-Identifier: OFL-1.1",
    "Released under the Common Development and Distribution License (CDDL).",
    "This program is licensed under the Microsoft Public License.",
    "Do What The Fuck You Want To Public License",
    "This work is licensed under the PostgreSQL License.",
    "Python Software Foundation License Version 2",
    "This file is licensed under the Server Side Public License, version 1.",
    "Use of this software is governed by the Business Source License.",
    "Permission is hereby granted under the terms of this license.",
    "All rights granted under this License are granted for the term of copyright.",
    "Licensed under the terms of the Academic Free License version 3.0.",
    "Boost Software License 1.0",
    "The zlib/libpng License",
    "Open Software License 3.0",
    "Academic Free License",
    "Released under the WTFPL license.",
    "European Union Public Licence",
    "SIL Open Font License",
    "Artistic License 2.0",
    "Permission is hereby granted, without written agreement, to use this material.",
    "Licensed under the terms found in the accompanying licence file.",
]

# Lines with licence terms, or with words of licences, that grant nothing.
OTHERS = [
    "She lost her driving licence on the way home.",
    "You need a fishing license to fish in this lake.",
    "The software license costs forty dollars a year.",
    "A creative writer finds words for everything.",
    "Creative people and common sense often meet.",
    "The apache helicopter landed near the village.",
    "All copyright questions go to our office.",
    "Copyright 2020 by the publisher. All rights reserved.",
    "The warranty of this washing machine ends after two years.",
    "We talked about license plates and licensed drivers.",
    "A gnu is a large antelope of the savanna.",
    "The eclipse was visible from the coast for an hour.",
    "Licensing fees for the stadium rose again.",
    "There is no warranty that the weather holds.",
    "Please read the license terms before you sign.",
    "The redistribution of wealth was debated all night.",
    "Send me a mail with the report in cc.",
    "The bar lost its license to sell wine.",
    "A licensed electrician must check the wiring.",
    "Mozilla published a report about the open web.",
    "Sie kam mit dem Zug und ging mit der Zeit wieder nach Hause.",
    "Der Bericht ist mit allen Daten und mit der Karte zu sehen.",
    "Il est venu avec la version originale du code et sans les notes.",
    "Este programa es gratis para los alumnos de la escuela.",
    "The software version 2.0 was released in January 2004.",
    "This program and its source code can be found in the project directory.",
    "Permission to enter the building was given by the office.",
    "You may use this file to copy the following data.",
    "Any person may obtain a copy of the report free of charge.",
    "The work of the foundation was published without any conditions.",
    "We use the source of the river to make the water free of salt.",
    "The public can see the files of this library at any later date.",
    "Terms and conditions of the contract are subject to change.",
    "The general public was not told about the international version.",
    "She wrote the code by hand and put it in the root of the tree.",
    "A common form of the universal rule is used in the forms below.",
]

_WORD = "[a-z0-9]+"
# Words that say nothing of a licence, also not one after another.
EMPTY = set(
    "0 1 2 3 4 a above all also an and any are as at be been but by can code default do either file for from has have here if in into is it its later may met more must no not note of on or "
    "other out own package project see shall so that the their these this those to under up use version we were which will with you your"
    .split()
)


def ngrams_of(text: str) -> set[str]:
    words = re.findall(_WORD, text.lower())
    return {" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)}


class Model(NamedTuple):
    classes: list[str]
    grams: list[str]
    weights: np.ndarray  # [gram, class], calibrated
    bias: np.ndarray
    templates: dict[str, list[list[str]]]  # each family's templates as their n-grams


#: Without these words a line can't be told from another family's; variants keep them.
_NAMES = re.compile(r"(?i)mit\b|apache|gnu|gpl|affero|lesser|bsd|clause|mozilla|mpl|eclipse|epl|creative|commons|attribution|\bcc|unlicense|public|licen")


def _variants(rng: random.Random, text: str, count: int) -> list[str]:
    """The text with some words lost, in another case, or amid other words."""
    fillers = "we you this project file code package here note that by default with and for more see the of in".split()
    out = []
    for _ in range(count):
        words = [w for w in text.split() if rng.random() > 0.06 or _NAMES.search(w)]
        before, after = ([rng.choice(fillers) for _ in range(rng.randint(0, 5))] for _ in range(2))
        own = " ".join([*before, *words, *after])
        out.append(own.upper() if rng.random() < 0.1 else own)
    return out


def _examples(seed: int) -> tuple[list[str], list[int]]:
    rng = random.Random(seed)
    texts, labels = [], []
    for own, label in _lines():
        times = 10 if label == len(CLASSES) - 1 else 16
        texts += _variants(rng, own, times)
        labels += [label] * times
    loose = [w for own in TEMPLATES.values() for t in own for w in t.split()]
    for _ in range(150):  # licence words without their order say little
        texts.append(" ".join(rng.sample(loose, rng.randint(2, 12))))
        labels.append(len(CLASSES) - 1)
    return texts, labels


#: In this order of the model's classes.
CLASSES = [*TEMPLATES, UNKNOWN, OTHER]


def _lines() -> list[tuple[str, int]]:
    """Every template and other line with its class."""
    listed = [(t, k) for k, own in enumerate(TEMPLATES.values()) for t in own]
    return [*listed, *((t, len(TEMPLATES)) for t in UNLISTED), *((t, len(TEMPLATES) + 1) for t in OTHERS)]


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _matrix(found: list[set[str]], grams: list[str]) -> np.ndarray:
    place = {g: k for k, g in enumerate(grams)}
    x = np.zeros((len(found), len(grams) + 1), dtype=np.float32)
    x[:, -1] = 1
    for row, own in enumerate(found):
        x[row, [place[g] for g in own if g in place]] = 1
    return x


def _fit(found: list[set[str]], labels: list[int], rounds: int, ridge: float) -> tuple[list[str], np.ndarray]:
    """The licences' n-grams that speak for one, in three examples at least, and their weights, the bias last."""
    # Of whole lines: the variants' other words are chance.
    lines = [(ngrams_of(t), k) for t, k in _lines()]
    n, m = (sum((k < len(CLASSES) - 1) is licence for _, k in lines) for licence in (True, False))
    licence, other, seen = Counter(), Counter(), Counter(g for own in found for g in own)
    for own, k in lines:
        (licence if k < len(CLASSES) - 1 else other).update(own)
    # A single word must be in two licences' lines at least, else it says too little.
    grams = sorted(
        g for g, a in licence.items() if seen[g] >= 3 and a / n >= SPEAKS * other[g] / m and not EMPTY.issuperset(words := g.split()) and a >= 2 - (len(words) > 1)
    )
    x, y = _matrix(found, grams), np.eye(len(CLASSES), dtype=np.float32)[labels]
    w = np.zeros((x.shape[1], len(CLASSES)), dtype=np.float32)
    speed = np.zeros_like(w)
    for _ in range(rounds):
        ahead = w + 0.9 * speed
        step = x.T @ (y - _softmax(x @ ahead)) / len(x) - ridge * ahead
        speed = 0.9 * speed + 1.0 * step
        w = w + speed
    return grams, w


@lru_cache(maxsize=1)
def train(seed: int = 7, rounds: int = 400, ridge: float = 1e-4, folds: int = 3) -> Model:
    texts, labels = _examples(seed)
    found = [ngrams_of(t) for t in texts]
    grams, w = _fit(found, labels, rounds, ridge)
    # Held-out templates: whole lines, with all their variants, are judged by models without them.
    rng, lines = random.Random(seed + 1), _lines()
    made = [[ngrams_of(v) for v in _variants(rng, t, 6)] for t, _ in lines]
    judged, want = [], []
    for fold in range(folds):
        learned = [(own, label) for k, (_, label) in enumerate(lines) if k % folds != fold for own in made[k]]
        some, v = _fit([own for own, _ in learned], [label for _, label in learned], rounds // 4, ridge)
        held = [(own, label) for k, (_, label) in enumerate(lines) if k % folds == fold for own in made[k]]
        judged.append(_matrix([own for own, _ in held], some) @ v)
        want += [label for _, label in held]
    z = np.concatenate(judged)
    scale = min((0.2, 0.3, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5), key=lambda s: -np.log(_softmax(s * z)[np.arange(len(want)), want] + 1e-12).mean())
    w = (w * scale).astype(float)
    templates = {f: [sorted(ngrams_of(t)) for t in own] for f, own in TEMPLATES.items()}
    return Model(CLASSES, grams, w[:-1], w[-1], templates)


@lru_cache(maxsize=4)
def _pattern(grams: tuple[str, ...]) -> str:
    def any_of(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for r in rest:
            heads.setdefault(r[:1], []).append(r[1:])
        some = [("[^a-z0-9]+" if c == " " else c) + (any_of(own) if own != [""] else "") for c, own in sorted(heads.items()) if c]
        return f"(?:{'|'.join(some)})" + "?" * ("" in heads)

    held = set(grams)
    short = [g for g in grams if not any(" ".join(own) in held for words in [g.split()] for n in range(1, len(words)) for k in range(len(words) - n + 1) for own in [words[k : k + n]])]
    return rf"(?i)(?<![a-z0-9]){any_of(short)}(?![a-z0-9])" if short else "(?!)"


def pattern(model: Model) -> str:
    """Finds a paragraph that has some n-gram of the model: a trie of those that hold no shorter one."""
    return _pattern(tuple(model.grams))


def __getattr__(name: str) -> str:
    if name == "PATTERN":  # of the trained model
        return pattern(train())
    raise AttributeError(name)


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _grams(paragraph: Column) -> Column:
    def joined(words: Column) -> Column:
        def runs(n: int) -> Column:
            return F.when(
                F.size(words) >= n,
                F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda k: F.concat_ws(" ", *[F.get(words, k + j) for j in range(n)])),
            ).otherwise(F.array().cast("array<string>"))

        return F.concat(words, runs(2), runs(3))

    return let(F.regexp_extract_all(F.lower(paragraph), F.lit(_WORD), 0), joined)


def classify(paragraph: Column, model: Model) -> Column:
    """struct(family, probability, similarity) of a paragraph; similarity is 0 for `other`."""
    known = _constant(sorted({*model.grams, *(g for own in model.templates.values() for t in own for g in t)}), "array<string>")
    weights = _constant({g: [round(float(v), 6) for v in w] for g, w in zip(model.grams, model.weights)}, "map<string, array<double>>")
    bias = _constant([round(float(v), 6) for v in model.bias], "array<double>")
    templates = _constant([[t for t in model.templates.get(c, [])] for c in model.classes], "array<array<array<string>>>")
    classes = _constant(model.classes, "array<string>")

    def told(found: Column) -> Column:
        z = F.aggregate(
            F.filter(F.transform(found, lambda g: F.try_element_at(weights, g)), lambda w: w.isNotNull()),
            bias,
            lambda total, w: F.zip_with(total, w, lambda a, b: a + b),
        )

        def chosen(z: Column) -> Column:
            top = F.array_max(z)
            at = F.array_position(z, top).cast("int")
            total = F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - top))
            near = F.array_max(F.transform(F.element_at(templates, at), lambda t: F.size(F.array_intersect(t, found)) / F.size(t)))
            return F.struct(F.element_at(classes, at).alias("family"), (F.lit(1.0) / total).alias("probability"), F.coalesce(near, F.lit(0.0)).alias("similarity"))

        return let(z, chosen)

    return let(F.array_intersect(_grams(paragraph), known), told)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_paragraphs, n_candidates, license, probability, similarity, paragraph, licenses) for each row.

    n_candidates counts the paragraphs with an n-gram of the model; of these the confirmed ones (a family
    is predicted, and a template of it shares at least CONFIRMED of its n-grams) give licenses,
    one struct(paragraph, family, probability, similarity) each, in order. license is the family
    of the most probable (ties: the first), `unknown` if none is confirmed but some candidate isn't
    `other` (a licence of no family, or too unlike its family's templates), else `none`; the three values beside it are null unless a
    licence is confirmed. A null text has no paragraphs and an empty one has one. Repeated rows
    come out as often as they go in.
    """
    model = model or train()
    gate = pattern(model)
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    marked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        let(
            lines,
            lambda own: F.struct(
                F.size(own).alias("n"),
                F.filter(F.transform(own, lambda p, k: F.when(p.rlike(gate), F.struct(k.alias("k"), p.alias("p")))), lambda x: x.isNotNull()).alias("some"),
            ),
        ).alias("m"),
    )
    judged = marked.select(
        "doc_id",
        F.when(F.col("m.n") >= 0, F.col("m.n")).otherwise(0).cast("long").alias("n_paragraphs"),
        F.coalesce(
            F.transform("m.some", lambda x: let(classify(x["p"], model), lambda c: F.struct(x["k"].cast("long").alias("paragraph"), c["family"].alias("family"), c["probability"].alias("probability"), c["similarity"].alias("similarity")))),
            F.array().cast("array<struct<paragraph: bigint, family: string, probability: double, similarity: double>>"),
        ).alias("all"),
    )
    sure = judged.withColumn("licenses", F.filter("all", lambda x: (x["family"] != OTHER) & (x["similarity"] >= CONFIRMED)))
    best = F.element_at(F.array_sort(F.transform("licenses", lambda x: F.struct((-x["probability"]).alias("p"), x.alias("x")))), 1)["x"]
    return sure.withColumn("best", F.when(F.size("licenses") > 0, best)).select(
        "doc_id",
        "n_paragraphs",
        F.size("all").cast("long").alias("n_candidates"),
        F.when(F.col("best").isNotNull(), F.col("best.family"))
        .when(F.exists("all", lambda x: x["family"] != OTHER), F.lit("unknown"))
        .otherwise(F.lit("none"))
        .alias("license"),
        F.col("best.probability").alias("probability"),
        F.col("best.similarity").alias("similarity"),
        F.col("best.paragraph").alias("paragraph"),
        "licenses",
    )
