"""Licence scans: statements, negations, versions, and all windows by dense features of plain strings."""

import random
import re

import numpy as np
import pytest

from kinfold.llm import licenses

PROSE = "and then the river ran on for many miles through the green valley to the sea".split()
GPL2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."


@pytest.fixture(scope="module", params=[1, 2])
def model(request):
    """A classifier from a sample of its own."""
    rng = random.Random(request.param)
    return licenses.train([" ".join(rng.choices(PROSE, k=30)) for _ in range(300)], seed=request.param)


@pytest.mark.parametrize(
    "text, family, version",
    [
        ("// SPDX-License-Identifier: MIT", "mit", None), ("# SPDX-License-Identifier: GPL-2.0-or-later", "gpl", "2.0+"), ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa", "4.0"),
        (GPL2, "gpl", "2+"), ("Distributed under the Boost Software License, Version 1.0.", "bsl-1.0", "1.0"), ("Licensed under the BSD 3-Clause License.", "bsd", "3-clause"),
        ("We do not care. Licensed under the MIT License.", "mit", None), ("available under the terms of the Eclipse Public License v2.0", "epl", "2.0"),
        ("Licensed under the Apache License, Version 2.0 (the \u201cLicense\u201d); you may not use this file except in compliance with the License.", "apache-2.0", "2.0"),
    ],
)
def test_statements(model, text, family, version):
    assert [(x[1], x[2]) for x in licenses.found_in(text, model)] == [(family, version)]


@pytest.mark.parametrize("text", ["This project is not licensed under the terms of the MIT license.", "The MIT license does not apply here.", "It was never released under the Apache 2.0 license.", "Unlike the GNU General Public License, this is short.", "released under the new city law", "", " \n\n", "-- // **"])
def test_no_statements(model, text):
    assert licenses.found_in(text, model) == []


def test_every_template_and_reliability(model):
    missed = [t for k, t in licenses.templates() if licenses.FAMILIES[k] not in {x[1] for x in licenses.found_in(t, model)}]
    assert len(missed) <= 0.02 * len(licenses.templates())
    said, right = model.reliability
    assert right >= 0.8 and abs(said - right) <= 0.1


def plain_grams(words):
    return [(i, n, " ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_words(text):
    return re.sub(r"[.](?=[ \n\r])|[.]+$", " ", re.sub(r"""["'()\[\]{}<>,;:*`!?#|=\\_/-]""", " ", text)).lower().split()


def test_all_windows_by_dense_features(model):
    """Each text is one line, so windows of lines are all there is."""
    hashed = lambda words: licenses.grams(licenses.word_hashes(" ".join(words)))
    every = [plain_words(t) for _, t in licenses.templates()]
    column = {}
    for words in every + [plain_words(t) for t in licenses.unknown_statements()]:
        for (_, _, g), h in zip(plain_grams(words), np.concatenate([v for v, _ in hashed(words)]), strict=True):
            column[g] = int(np.searchsorted(model.features, h))
            assert model.features[column[g]] == h
    assert len(set(column.values())) == len(column) == len(model.features)
    rng = random.Random(7)
    statements = [t for _, t in licenses.templates()]
    texts = [" ".join([*rng.choices(PROSE, k=rng.randrange(70)), rng.choice(statements + licenses.unknown_statements()), *rng.choices(PROSE, k=rng.randrange(70)), rng.choice(statements)]) for _ in range(150)]
    for text in texts:
        words, want = plain_words(text), {}
        for i in range(0, max(1, len(words) - 24), 24):
            grams = [(a + i, n, g) for a, n, g in plain_grams(words[i : i + 48]) if g in column]
            mine = {g for _, _, g in grams}
            if len(mine) < 3:
                continue
            dense = np.zeros(len(model.features))
            dense[[column[g] for g in mine]] = 1 / len(mine) ** 0.5
            z = np.exp((dense @ model.weights + model.bias) / model.temperature)
            k = int(z.argmax())
            if not k or z[k] / z.sum() < model.least:
                continue
            shares = [len({g for _, _, g in plain_grams(t)} & mine) / len({g for _, _, g in plain_grams(t)}) if f == k else -1 for t, (f, _) in zip(every, licenses.templates(), strict=True)]
            best = int(np.argmax(shares))
            if shares[best] < licenses.MIN_SIMILARITY - 1e-6:
                continue
            own = {g for _, _, g in plain_grams(every[best])}
            covered = sorted({a + x for a, n, g in grams if n > 1 and g in own for x in range(n)})
            runs = []
            for a in covered:
                if runs and a - runs[-1][-1] <= 1 + licenses.GAP - 1:
                    runs[-1].append(a)
                else:
                    runs.append([a])
            run = max(runs, key=len) if runs else []
            if run:
                first, last = run[0] - 1, run[-1] + 1
                while first > 0 and words[first] in licenses.ARTICLES:
                    first -= 1
                if last + 1 < len(words) and words[last] in licenses.AUXILIARIES:
                    last += 2
                if any(words[a] in licenses.NEGATIONS for a in range(max(0, first), last) if a not in run):
                    continue
            found = (round(shares[best], 5), round(float(z[k] / z.sum()), 3))
            want[licenses.FAMILIES[k]] = max(want.get(licenses.FAMILIES[k], (0, 0)), found)
        got = {x[1]: (round(x[4], 5), round(x[3], 3)) for x in licenses.found_in(text, model)}
        assert got.keys() == want.keys(), text
        assert all(abs(got[f][0] - want[f][0]) < 1e-4 and abs(got[f][1] - want[f][1]) < 2e-3 for f in got), (text, got, want)


def test_a_long_line_takes_linear_time(model):
    import time

    def seconds(n):
        start = time.process_time()
        licenses.found_in("the terms of the license " * n, model)
        return time.process_time() - start

    assert seconds(80_000) <= 12 * max(0.05, seconds(10_000))
