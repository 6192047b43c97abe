"""N-gram Jaccard join and benchmark decontamination against brute force."""

import random
import re

import numpy as np
import pytest

from conftest_llm import shingles
from kinfold.llm import decontaminate, jaccard
from kinfold.llm.components import components


def brute(rows, threshold=80):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).update(shingles(t))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in ids}


def near_copies(seed, groups=12, size=7, words=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    boiler = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, words))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append(" ".join((boiler if g % 3 == 0 else []) + text))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("cells_hot", [False, True])
def test_components_equal_brute_force(spark, make, monkeypatch, cells_hot):
    if cells_hot:  # every token is frequent, so all signatures are combinations
        monkeypatch.setattr(jaccard, "_frequent", lambda texts, buckets: np.full(jaccard.FLAGS // 8, 255, np.uint8))
    rows = near_copies(3 + cells_hot)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(make(rows)).collect()}
    assert got == brute(rows)
    assert len(set(got.values())) < len(rows)


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    for often in (0, 255, 170):
        frequent = np.full(jaccard.FLAGS // 8, often, np.uint8)
        for n in [1, 2, 3, 4, 5, 6, 9, 10, 16, 25, 40, 64, 100, 333, 1000]:
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64))
            for lost in range(n // 5 + 1):
                y = np.unique(np.concatenate([x[rng.permutation(len(x))[lost:]], rng.integers(0, 2**63, rng.integers(0, max(1, n // 5 - lost + 1)), dtype=np.int64).astype(np.uint64)]))
                both = len(np.intersect1d(x, y))
                if not np.array_equal(x, y) and 100 * both >= 80 * (len(x) + len(y) - both):
                    assert len(np.intersect1d(jaccard.signatures(x, frequent), jaccard.signatures(y, frequent))) > 0


def test_large_group_of_copies(make):
    rows = [(i, "same words in every one of these texts " + ("tail" if i % 2 else "tail tail")) for i in range(3000)]
    got = jaccard.jaccard_components(make(rows)).groupBy("component_id").count().collect()
    assert sum(r["count"] for r in got) == 3000 and len(got) <= 2


def test_awkward_rows(awkward, empty):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_components(awkward).collect()}
    by_id = {i: c for (i, _), c in got.items()}
    assert by_id[5] == 4 and by_id[6] == 0 and by_id[1] == 1 and by_id[2] == 2 and by_id[3] == 3 and by_id[8] == 7 and by_id[None] is None
    assert got[(1, 0)] == 1 and got[(4, 1)] == 4
    assert jaccard.jaccard_components(awkward).count() == awkward.count()
    assert jaccard.jaccard_components(empty).count() == 0
    kept = jaccard.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [0, 1, 2, 3, 4, 7, 9, 10]
    assert jaccard.one_of_each(empty).count() == 0


def test_threshold_has_a_floor(empty):
    with pytest.raises(ValueError):
        jaccard.jaccard_components(empty, 70)


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def contained(rows, items):
    out = set()
    for i, t in rows:
        own = shingles(t)
        for k, text in items:
            s = shingles(text)
            if s and 100 * len(s & own) >= 80 * len(s):
                out.add((i, k, len(s & own), len(s)))
    return out


def test_items_inside_long_texts(spark, make):
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(3000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, words(n)) for k, n in enumerate([5, 7, 12, 20, 21, 40, 64, 90, 300, 3, 1])]
    rows = []
    for i in range(60):
        text = words(rng.choice([10, 300, 6000]))
        k, item = rng.choice(items)
        at = rng.randrange(len(text))
        changed = [w if rng.random() > 0.02 else "changed" for w in item]
        rows.append((i, " ".join(text[:at] + changed + text[at:]) if i % 3 else " ".join(text)))
    rows += [(100, " ".join(items[9][1])), (101, " ".join(items[10][1]).upper())]
    items = [(k, " ".join(w)) for k, w in items] + [(50, " ".join(items[3][1])), (51, ""), (52, None)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.contaminated(make(rows), table).collect()}
    assert got == contained(rows, items)
    assert {i for i, *_ in got} >= {100, 101}
    kept = {r.doc_id for r in decontaminate.clean(make(rows), table).collect()}
    assert kept == {i for i, _ in rows} - {i for i, *_ in got}


def test_blocks_of_items_give_the_same(spark, make, monkeypatch):
    rows = [(i, re.sub("w", f"w{i % 4} ", "aw bw cw dw ew fw gw hw")) for i in range(20)]
    table = spark.createDataFrame([(k, t) for k, t in rows[:6]], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(make(rows), table).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    assert sorted(map(tuple, decontaminate.contaminated(make(rows), table).collect())) == whole and whole


def test_awkward_items(spark, awkward, empty):
    items = spark.createDataFrame([(1, "one two"), (2, None), (None, "x")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(awkward, items).collect()} == {4, 5}
    assert decontaminate.contaminated(empty, items).count() == 0
    none = items.where("item_id > 9")
    assert decontaminate.contaminated(awkward, none).count() == 0
    assert decontaminate.clean(awkward, none).count() == awkward.count()
    assert decontaminate.clean(awkward, items).columns == awkward.columns
