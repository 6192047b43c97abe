"""Importance resampling against a version that builds every n-gram."""

import math
import random
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from kinfold.llm import resampling
from kinfold.llm.resampling import features, ranked, resample, running_crcs, shifted

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets_of(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [crc32(g.encode()) % 10000 for g in grams]


def brute(rows, target, percent=5):
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, text in rows:
        np.add.at(s, buckets_of(text)[1], 1)
    for text in target:
        np.add.at(t, buckets_of(text)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * float(s.sum() + 10000) / ((s[b] + 1) * float(t.sum() + 10000)))) for b in range(10000)]
    out, entered = [], []
    for i, text in rows:
        n, found = buckets_of(text)
        weight = sum(gain[b] for b in found)
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
        if n >= 20:
            entered.append(out[-1])
    entered.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(entered[: percent * len(entered) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_prefixes_and_cancellation():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(3000))
    crcs = running_crcs(data)
    assert [int(c) for c in crcs] == [crc32(data[:k]) for k in range(len(data) + 1)]
    s = np.array([rng.randrange(1500) for _ in range(300)] + [0, 5, 2999])
    e = np.array([rng.randrange(1500, 3001) for _ in range(300)] + [3000, 5, 3000])
    assert [int(x) for x in crcs[e] ^ shifted(crcs[s], e - s)] == [crc32(data[a:b]) for a, b in zip(s, e, strict=True)]


@pytest.mark.parametrize("texts", [["a b  c", "", "é-x 漢字, 12 A", "..."], ["one"], [""], ["x" * 70000 + " y " + "z" * 200]])
def test_buckets_of_runs(texts):
    found, bounds = features(texts, 10000, 3)
    for k, text in enumerate(texts):
        mine = [b for at, bucket in found for a, b in zip(at, bucket, strict=True) if bounds[k] <= a < bounds[k + 1]]
        assert sorted(mine) == sorted(buckets_of(text)[1])


def test_equals_brute_force(make, awkward, spark):
    target = ["the village on the hill", None, "Long war, long PEACE"]
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(resample(awkward, aims, percent=40)) == brute(rows, target, 40)
    rng = random.Random(4)
    many = [(k, " ".join(rng.choice(["the", "War", "hill", "x9", "ö", "tax"]) for _ in range(rng.randint(5, 60)))) for k in range(400)]
    result = got(resample(make(many), aims))
    assert result == brute(many, target)
    assert sum(r[4] is not None for r in result) > 5


def test_ranks_of_ties_and_large_shares(spark):
    rows = spark.range(2000).selectExpr("id AS doc_id", "id % 7 AS n_features", "0L AS weight", "id % 3 AS score", "id % 5 <> 0 AS entered")
    for drawn in (0, 1, 700, 1600):
        found = {r.doc_id: r["rank"] for r in ranked(rows, drawn).collect()}
        order = sorted((i for i in range(2000) if i % 5), key=lambda i: (-(i % 3), i))
        assert found == {i: None for i in range(2000)} | {i: k + 1 for k, i in enumerate(order[:drawn])}


def test_empty_tables(make, empty, spark):
    none = spark.createDataFrame([], "text string")
    assert resample(empty, none).collect() == []
    rows = [(1, "a b c"), (2, None)]
    assert got(resample(make(rows), none)) == brute(rows, [])


def test_chunks_do_not_matter(make, spark, monkeypatch):
    from kinfold.llm import common

    rows = [(k, f"the hill {k} " * 30) for k in range(50)]
    aims = spark.createDataFrame([("the hill",)], "text string")
    monkeypatch.setattr(common, "CHUNK_BYTES", 100)
    assert got(resample(make(rows), aims)) == brute(rows, ["the hill"])
    assert resampling.BUCKETS == 10000
