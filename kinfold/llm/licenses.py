"""Licence scans: a trained classifier of paragraphs, with confirmation by templates.

Windows of a paragraph are described by the word n-grams they share with the
templates. A softmax regression over these sparse features gives the family or
"unknown". Its temperature and threshold are fitted on statements whose templates a first
fit has not seen; the final fit has them all. A prediction counts if its probability reaches the threshold, a
template of the family is similar enough, and no negation stands in the statement that the template lacks.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import MIX, arrow_map, likely_least, mixed, narrow, word_hashes, word_hashes_of

#: Statements by family. Fixed values, from the public texts of the licences.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache 2.0 license.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL v2 or later.",
        "either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "This file is part of the program and is licensed under the terms of the GNU GPL.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL license.",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Released under the AGPL license.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0 Universal.", "Dedicated to the public domain under the Creative Commons CC0 license."),
    "cc-by-nc-sa": ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",),
    "cc-by-nd": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",),
    "cc-by-nc-nd": ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ),
    "bsl-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
    ),
    "proprietary": ("All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "Proprietary and confidential. All rights reserved."),
}
#: Sentences about licences that grant none. Fixed values.
NO_LICENCE = (
    "You need a driving license to rent a car in this country.",
    "The license plate of the car was covered in mud and no one could read it.",
    "Under the new law the city will grant a license to any restaurant.",
    "The general public is invited to the free concert in the park.",
    "She released her first album under the name of her mother.",
    "The software version was distributed to all of the users last week.",
    "Permission to enter the building must be granted by the head of the school.",
    "The committee discussed the conditions of the license and the terms of the sale.",
    "MIT researchers published a paper about free software last year.",
    "The source of the river is in the mountains, and the library is in the town.",
)
#: Names and identifiers of the licences in short statements. Fixed values.
NAMES = {
    "apache-2.0": (("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache Software License"), ("Apache-2.0",)),
    "mit": (("MIT License", "MIT/X11 license", "MIT"), ("MIT",)),
    "bsd": (("BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "New BSD License", "simplified BSD license"), ("BSD-3-Clause", "BSD-2-Clause", "0BSD")),
    "gpl": (("GNU General Public License", "GNU GPL", "GPLv2", "GPLv3", "GPL v3", "GNU General Public License v2.0", "GNU General Public License, version 2"), ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+")),
    "lgpl": (("GNU Lesser General Public License", "LGPL", "LGPLv3", "LGPL v2.1", "GNU LGPL"), ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later")),
    "agpl": (("GNU Affero General Public License", "AGPL", "AGPLv3", "GNU AGPL v3"), ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")),
    "mpl-2.0": (("Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"), ("MPL-2.0",)),
    "isc": (("ISC License", "ISC licence"), ("ISC",)),
    "unlicense": (("Unlicense", "Unlicense public domain dedication"), ("Unlicense",)),
    "cc-by": (("CC BY 4.0", "CC-BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 license"), ("CC-BY-4.0", "CC-BY-3.0")),
    "cc-by-sa": (("CC BY-SA 4.0", "CC-BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 license"), ("CC-BY-SA-4.0", "CC-BY-SA-3.0")),
    "cc-by-nc": (("CC BY-NC 4.0", "CC-BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 license"), ("CC-BY-NC-4.0",)),
    "cc-by-nc-sa": (("CC BY-NC-SA 4.0", "CC-BY-NC-SA 4.0", "CC BY-NC-SA", "Creative Commons Attribution-NonCommercial-ShareAlike license"), ("CC-BY-NC-SA-4.0",)),
    "cc-by-nd": (("CC BY-ND 4.0", "CC-BY-ND 4.0"), ("CC-BY-ND-4.0",)),
    "cc-by-nc-nd": (("CC BY-NC-ND 4.0", "CC-BY-NC-ND 4.0"), ("CC-BY-NC-ND-4.0",)),
    "cc0": (("CC0 1.0", "CC0", "Creative Commons Zero license"), ("CC0-1.0",)),
    "epl": (("Eclipse Public License", "Eclipse Public License v2.0", "EPL 2.0"), ("EPL-1.0", "EPL-2.0")),
    "zlib": (("zlib License", "zlib/libpng license"), ("Zlib",)),
    "bsl-1.0": (("Boost Software License", "Boost Software License 1.0"), ("BSL-1.0",)),
}
#: Short statements around a name.
FORMS = ("Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This project is licensed under the terms of the {}.", "Distributed under the {}.", "This work is made available under the {}.", "License: {}")
#: The same forms around what is no licence, and mentions that grant none; both are unknown.
OTHER_NAMES = ("terms of the sale", "new city law", "name of her mother", "state gaming act", "supervision of a doctor", "brand of the company")
MENTIONS = (
    "This project is not licensed under the terms of the {}.", "The code was never released under the {}.", "It is no longer distributed under the {}.", "Unlike the {}, these terms are strict.",
    "They compared the {} with other terms last year.", "The {} was written by a committee.", "Code that is not covered by the {} must go.", "The {} does not apply to this file.",
)
FAMILIES = ("unknown", *TEMPLATES)


def templates() -> list[tuple[int, str]]:
    """(family, statement): the texts, and each form around each name."""
    out = []
    for k, family in enumerate(TEMPLATES, 1):
        names, identifiers = NAMES.get(family, ((), ()))
        short = [form.format(n) for n in names for form in FORMS] + [f"SPDX-License-Identifier: {i}" for i in identifiers]
        out += [(k, t) for t in (*TEMPLATES[family], *short)]
    return out


def unknown_statements() -> list[str]:
    return [*NO_LICENCE, *(f.format(n) for f in FORMS for n in OTHER_NAMES), *(f.format(n) for f in MENTIONS for names, _ in NAMES.values() for n in names[:2])]


#: Words of a window and the step between windows of a longer paragraph.
WINDOW, STEP = 48, 24
#: Lines of the corpus that the classifier sees as unknown text, at most.
SAMPLE_LINES = 3000
MIN_SIMILARITY = 0.6
#: Comment marks that are words, before the words of a line; others are punctuation.
MARKS = re.compile(r"^[ \t]*(?:dnl|rem|REM)(?=[ \t]|$)", re.MULTILINE)
TABLE_BITS = 18
#: Punctuation that separates words, also where it ends one; marks inside names and versions stay.
BLANKED = bytes(32 if chr(c) in "\"'()[]{}<>,;:*`!?#|=\\_-/%" else c for c in range(256))
QUOTES = tuple(q.encode() for q in "\u201c\u201d\u2018\u2019\u00ab\u00bb")
#: Words that turn a statement into its contrary where its template has none. Fixed values.
NEGATIONS = ("not", "never", "neither", "nor", "isn", "wasn", "aren", "weren", "unlike", "longer")
#: Words that may stand between a negation and a statement, and before one behind it. Fixed values.
ARTICLES, AUXILIARIES = ("the", "a", "an", "this"), ("is", "was", "does", "did", "has", "are")
#: Words between two words of one statement that its template lacks, at most.
GAP = 3
#: The number of a version or of BSD's clauses, and whether later ones are allowed.
VERSION = re.compile(r"(?:version|\bv|licen[cs]e|gpl|apache|mpl|epl|attribution\S*|sharealike|derivatives|noncommercial|cc0|by(?: n[cd]| sa)*)[ .v]*(\d(?:\.\d)?)(?![\d.]*\d)|\b([023]) ?(?=clause|bsd)", re.IGNORECASE)
LATER = re.compile(r"\+|\bor +(?:at your option +)?(?:any +)?later", re.IGNORECASE)


def plain(text: str) -> str:
    """The text with punctuation around words blanked; lines stay lines."""
    data = text.encode()
    for quote in () if text.isascii() else QUOTES:
        data = data.replace(quote, b" ")
    data = data.translate(BLANKED)
    for end in (b" ", b"\n", b"\r"):
        data = data.replace(b"." + end, b" " + end)
    return data.rstrip(b".").decode()


def version_of(statement: str) -> str | None:
    """Version named by a statement, "+" behind it where later ones are allowed; for BSD the number of clauses."""
    found = VERSION.search(statement)
    if not found:
        return None
    later = LATER.search(statement, found.end())
    return (found[1] or f"{found[2]}-clause") + ("+" if later and later.start() - found.end() <= 16 else "")


def grams(words: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Hashes of the 1-, 2- and 3-grams of a sequence of word hashes, with their lengths."""
    out, total = [(words, 1)], words
    with np.errstate(over="ignore"):
        for n in (2, 3):
            total = mixed(total[:-1] * MIX + words[n - 1 :]) if len(words) >= n else words[:0]
            out.append((total, n))
    return out


class Classifier(NamedTuple):
    features: np.ndarray
    table: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    families: np.ndarray  # of the templates
    members: np.ndarray  # features x templates
    sizes: np.ndarray
    stated: np.ndarray  # features that a template has
    negations: np.ndarray
    articles: np.ndarray
    auxiliaries: np.ndarray
    reliability: tuple[float, float]  # held out: mean probability of predictions, share that is right


def hits(words: np.ndarray, features: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, feature) of the n-grams of a text that templates have."""
    at, length, feature = [], [], []
    for values, n in grams(words):
        where = np.flatnonzero(table[values & np.uint64(len(table) - 1)])
        k = np.minimum(np.searchsorted(features, values[where]), len(features) - 1)
        ok = features[k] == values[where]
        at.append(where[ok])
        length.append(np.full(int(ok.sum()), n))
        feature.append(k[ok])
    return np.concatenate(at), np.concatenate(length), np.concatenate(feature)


def vector(feature: np.ndarray, size: int) -> np.ndarray:
    x = np.zeros(size, np.float32)
    x[feature] = 1
    return x / max(1.0, x.sum() ** 0.5)


def feature_table() -> tuple[np.ndarray, np.ndarray]:
    texts = [t for _, t in templates()] + unknown_statements()
    values = np.unique(np.concatenate([g for w in word_hashes_of([plain(t) for t in texts]) for g, _ in grams(w)]))
    table = np.zeros(1 << TABLE_BITS, bool)
    table[values & np.uint64(len(table) - 1)] = True
    return values, table


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(-1, keepdims=True))
    return z / z.sum(-1, keepdims=True)


def fitted(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax regression in which each family counts the same."""
    weights, bias = np.zeros((x.shape[1], len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    share = (1 / np.maximum(1, target.sum(0)))[y]
    share = (share / share.sum()).astype(np.float32)
    step, lift = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(steps):
        error = (softmax(x @ weights + bias) - target) * share[:, None]
        step = 0.9 * step - 20 * (x.T @ error + np.float32(1e-5) * weights)
        lift = 0.9 * lift - 20 * error.sum(0)
        weights, bias = weights + step, bias + lift
    return weights, bias


def train(lines: list[str], seed: int = 11) -> Classifier:
    """Classifier from the templates, altered and set among ``lines`` of unknown text.

    Every fourth template of a family, and of the unknown statements, is held out with all its alterations for the
    temperature and the threshold.
    """
    rng = np.random.default_rng(seed)
    features, table = feature_table()
    vec = lambda words: vector(hits(words, features, table)[2], len(features))
    known = [(k, w) for (k, _), w in zip(templates(), word_hashes_of([plain(t) for _, t in templates()]), strict=True)]
    families = np.array([k for k, _ in known])
    members = np.zeros((len(features), len(known)), np.float32)
    for c, (_, w) in enumerate(known):
        members[np.unique(hits(w, features, table)[2]), c] = 1
    sizes = members.sum(0)
    # a line that already holds most of a template is no example of unknown text
    around = word_hashes_of([plain(t) for t in lines]) if lines else []
    clean = [w for w in around if (members[np.unique(hits(w, features, table)[2])].sum(0) / sizes).max() < 0.5]
    rows, labels, held = [], [], []
    nth = [int((families[:c] == k).sum()) for c, k in enumerate(families)]
    unknown = [(0, w) for w in word_hashes_of([plain(t) for t in unknown_statements()])]
    for (k, t), n in zip(known + unknown, nth + list(range(len(unknown))), strict=True):
        for turn in range(6 if k else 3):
            keep = t if turn < 3 else t[rng.random(len(t)) > rng.choice([0.05, 0.1, 0.15])]
            left, right = (clean[rng.integers(len(clean))][: rng.integers(0, 20)] if clean and turn % 3 else t[:0] for _ in range(2))
            rows.append(vec(np.concatenate([left, keep, right])))
            labels.append(k)
            held.append(n % 4 == 3)
    for n, w in enumerate(clean):
        rows.append(vec(w))
        labels.append(0)
        held.append(n % 4 == 3)
    x, y, out = np.stack(rows), np.array(labels), np.array(held)
    weights, bias = fitted(x[~out], y[~out])
    logits, truth = x[out] @ weights + bias, y[out]
    loss = {t: -np.log(np.maximum(1e-9, softmax(logits / t)[np.arange(len(logits)), truth])).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)}
    temperature = min(loss, key=loss.get)
    p = softmax(logits / temperature)
    said = p.argmax(1)
    # the least probability from which nine in ten predictions of a family are right
    order = np.argsort(-p.max(1), kind="stable")
    order = order[said[order] != 0]
    right = np.cumsum(said[order] == truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= 0.9)
    least = float(np.clip(p.max(1)[order[good[-1]]] if len(good) else 0.8, 0.5, 0.8))
    weights, bias = fitted(x, y)
    confident = said != 0
    reliability = (float(p.max(1)[confident].mean()), float((said == truth)[confident].mean())) if confident.any() else (0.0, 0.0)
    return Classifier(features, table, weights, bias, temperature, least, families, members, sizes, members.any(1), *(word_hashes(" ".join(w)) for w in (NEGATIONS, ARTICLES, AUXILIARIES)), reliability)


class Text(NamedTuple):
    """The words of a text and its n-grams that templates have, in order."""

    words: np.ndarray
    at: np.ndarray
    length: np.ndarray
    feature: np.ndarray

    @classmethod
    def of(cls, text: str, model: Classifier) -> Text:
        words = word_hashes(text)
        at, length, feature = hits(words, model.features, model.table)
        order = np.argsort(at, kind="stable")
        return cls(words, at[order], length[order], feature[order])

    def strong(self, model: Classifier) -> np.ndarray:
        """Which n-grams are of two words or more and of a template; a statement has one."""
        return (self.length >= 2) & model.stated[self.feature]


def negated(text: Text, inside: np.ndarray, template: int, model: Classifier) -> bool:
    """Whether a negation that the template lacks stands in the longest run of its words, or right before it."""
    own = inside[(model.members[text.feature[inside], template] > 0) & (text.length[inside] >= 2)]
    if not len(own):
        return False
    covered = np.unique(np.concatenate([text.at[own] + k for k in range(3)])[np.concatenate([text.length[own] > k for k in range(3)])])
    run = max(np.split(covered, np.flatnonzero(np.diff(covered) > GAP) + 1), key=len)
    first, last = int(run[0]) - 1, int(run[-1]) + 1
    while first > 0 and text.words[first] in model.articles:
        first -= 1
    if last + 1 < len(text.words) and text.words[last] in model.auxiliaries:
        last += 2
    between = np.setdiff1d(np.arange(max(0, first), last), covered)
    return bool(np.isin(text.words[between], model.negations).any())


def judged(text: Text, i: int, j: int, model: Classifier) -> tuple[int, float, float, int, np.ndarray] | None:
    """(family, probability, similarity, template, places of hits) of the words i to j, if they are a statement."""
    lo, hi = np.searchsorted(text.at, (i, j))
    inside = lo + np.flatnonzero(text.at[lo:hi] + text.length[lo:hi] <= j)
    mine = np.unique(text.feature[inside])
    if len(mine) < 3:
        return None
    # no family can confirm where the most similar template of all does not
    shares = model.members[mine].sum(0) / model.sizes
    if shares.max() < MIN_SIMILARITY:
        return None
    p = softmax((model.weights[mine].sum(0) / len(mine) ** 0.5 + model.bias) / model.temperature)
    k = int(p.argmax())
    if not k or p[k] < model.least:
        return None
    template = int(np.where(model.families == k, shares, -1).argmax())
    if shares[template] < MIN_SIMILARITY or negated(text, inside, template, model):
        return None
    return k, float(p[k]), float(shares[template]), template, inside


def windows(first: int, size: int) -> np.ndarray:
    return np.arange(first, first + max(1, size - (WINDOW - STEP)), STEP)


def wrapped(text: str, read: Text, model: Classifier, seen: dict[tuple[int, int], tuple]) -> list[tuple[int, str, str | None, float, float, str]]:
    """Statements that run over line ends: (line with the first words, family, version, probability, similarity, words of the window).

    Paragraphs end at lines without words; their lines are joined, less comment marks, and read in the same windows.
    The best window of each paragraph and family counts. One with words on a line of ``seen``, by (line, family), takes
    that statement's place if its template is longer, and is left out if not.
    """
    unmarked = MARKS.sub("", text)
    if unmarked != text:
        read = Text.of(unmarked, model)
    lines = unmarked.split("\n")
    sizes = np.array([len(x.encode().split()) for x in lines])
    strong = np.append(0, np.cumsum(read.strong(model)))
    ends = np.cumsum(sizes)
    blank = np.flatnonzero(sizes == 0)
    out = []
    for a, b in zip(np.append(0, blank + 1), np.append(blank, len(sizes)), strict=True):
        if b - a < 2:
            continue
        first, size = int(ends[a] - sizes[a]), int(ends[b - 1] - ends[a] + sizes[a])
        starts = windows(first, size)
        lo, hi = np.searchsorted(read.at, starts), np.searchsorted(read.at, np.minimum(starts + WINDOW, first + size))
        best: dict[int, tuple] = {}
        for i in starts[(hi - lo >= 3) & (strong[hi] > strong[lo])]:
            j = min(i + WINDOW, first + size)
            hit = judged(read, i, j, model)
            if not hit or (hit[0] in best and (hit[2], hit[1]) <= best[hit[0]][:2]):
                continue
            k, p, s, template, inside = hit
            own = inside[(model.members[read.feature[inside], template] > 0) & (read.length[inside] >= 2)]
            held, n = np.unique(np.searchsorted(ends, read.at[own], "right"), return_counts=True)
            held = held[n >= min(2, n.max(initial=0))]
            onto = [(int(x), k) for x in held if (int(x), k) in seen]
            if len(held) and all(seen[x][-1] < model.sizes[template] for x in onto):
                for x in onto:
                    del seen[x]
                best[k] = (s, p, int(held[0]), b" ".join("\n".join(lines[a:b]).encode().split()[i - first : j - first]).decode())
        out += [(line, FAMILIES[k], version_of(shown), p, s, shown) for k, (s, p, line, shown) in best.items()]
    return out


def found_in(text: str, model: Classifier) -> list[tuple[int, str, str | None, float, float, str]]:
    """(line, family, version, probability, similarity, words of the window): the best window of each line and family, then statements over several lines."""
    out: dict[tuple[int, int], tuple] = {}
    text = plain(text)
    read = Text.of(text, model)
    strong = np.unique(read.at[read.strong(model)])
    if len(strong) == 0:
        return []
    lines = text.split("\n")
    sizes = np.array([len(x.encode().split()) for x in lines])
    ends = np.cumsum(sizes)
    for line in np.unique(np.searchsorted(ends, strong, "right")):
        first, size = int(ends[line] - sizes[line]), int(sizes[line])
        own = None
        for i in windows(first, size):
            j = min(i + WINDOW, first + size)
            hit = judged(read, i, j, model)
            if hit:
                k, p, s = hit[:3]
                old = out.get((int(line), k))
                if old is None or (s, p) > (old[4], old[3]):
                    own = own or lines[line].encode().split()
                    shown = b" ".join(own[i - first : j - first]).decode()
                    out[int(line), k] = (int(line), FAMILIES[k], version_of(shown), p, s, shown, model.sizes[hit[3]])
    longer = wrapped(text, read, model, out)
    return sorted([*(x[:-1] for x in out.values()), *longer], key=lambda x: (x[0], x[1], -x[4]))


def sample_lines(texts: DataFrame) -> list[str]:
    """At most SAMPLE_LINES lines of all texts, chosen by a hash, each cut to a window."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n"))).where(F.length("col") > 0)
    lines = lines.select(F.xxhash64("doc_id", "pos").alias("h"), "col")
    few = likely_least(lines, F.col("h").cast("double") / 2.0**64 + 0.5, SAMPLE_LINES)
    words = F.array_join(F.slice(F.split("col", " "), 1, WINDOW), " ")
    rows = few.select("h", words.alias("line")).orderBy("h", "line").limit(SAMPLE_LINES).collect()
    return [r.line for r in rows if r.line.split()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, version, probability, similarity, excerpt) of each licence statement found.

    Lines are read by themselves, and joined up to the next blank line for statements that are wrapped; longer ones are
    read in overlapping windows. ``paragraph`` is the line, counted from 0, on which the statement begins; ``excerpt`` has
    the window's words less punctuation; ``version`` is null where none is named. A negated statement is none; one that is only quoted counts.
    Whole texts are read; null and empty texts have no statement; copies have each their own rows;
    an empty table gives none. The sample for training is bounded by SAMPLE_LINES. Only two columns are read.
    """
    texts = narrow(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(train(sample_lines(texts)))

    def of_chunk(ids: list, batch: list[str]) -> dict:
        rows = [(i, *found) for i, t in zip(ids, batch, strict=True) for found in found_in(t, sent.value)]
        return {n: [r[c] for r in rows] for c, n in enumerate(("doc_id", "paragraph", "family", "version", "probability", "similarity", "excerpt"))}

    return arrow_map(texts, of_chunk, "doc_id long, paragraph long, family string, version string, probability double, similarity double, excerpt string")
