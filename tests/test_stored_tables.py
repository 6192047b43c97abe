"""Stored neighbour tables know their depth; vocabularies, matrices and joins without limits."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinfold.operators import effects, fingerprints, neighbors
from kinfold.operators.block_search import Part
from kinfold.operators.distribution import numbered
from kinfold.sources import writers


def sets(spark, n=60, seed=3):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, sorted(rng.sample(range(20), rng.randint(2, 9)))) for i in range(n)], "id long, ds array<int>")


def test_depth_is_stored_with_the_table(spark, tmp_path):
    df = sets(spark)
    targets = df.select("id").where("id < 9")
    table = neighbors.neighbor_table(df, [Part("ds")], "f", "no_filter", k=6)
    table.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    for known in (table, read, read.where("similarity > 0.1")):
        assert neighbors.table_depth(known) == 6
        with pytest.raises(ValueError, match="holds 6"):
            neighbors.expand_graph(targets, known, 1, 6, 0.0)
    assert neighbors.expand_graph(targets, read, 1, 5, 0.0).count() > 0
    # a filtered table's longest list says nothing about the depth
    hits, missing = neighbors.stored_lookup(targets, read.where("rank <= 3"), 3, 0.0)
    assert missing.count() == 0 and hits.count() == 27
    unknown = read.select("id", F.col("rank").cast("long").alias("rank"), "nn_id", "similarity", "fp_id")
    for call in (lambda: neighbors.expand_graph(targets, unknown, 1, 2, 0.0), lambda: neighbors.stored_lookup(targets, unknown, 2, 0.0)):
        with pytest.raises(ValueError, match="give its depth"):
            call()


def test_numbers_follow_the_order(spark):
    rows = [(f"w{i:05d}",) for i in range(5000)]
    got = {r.bit: r.position for r in numbered(spark.createDataFrame(rows, "bit string").repartition(5), ["bit"]).collect()}
    assert got == {w: i for i, (w,) in enumerate(rows)}


def test_bits_of_a_large_vocabulary(spark):
    """50,000 names: no driver list, no refusal."""
    names = [f"n{i:05d}" for i in range(50_000)]
    features = spark.createDataFrame([(1, ["n00000", "n49999"]), (2, ["n00007", "n00003"]), (3, [])], "id long, ds array<string>")
    members = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 2), (3, 1, 3)], "target long, rank int, id long")
    rows = {(r.target, r["rank"]): r.bits for r in writers.neighbour_bits(members, features, spark.createDataFrame([(n,) for n in names], "bit string")).collect()}
    assert all(len(b) == 50_000 for b in rows.values())
    ones = {k: [i for i, c in enumerate(b) if c == "1"] for k, b in rows.items()}
    assert ones == {(1, 1): [0, 49_999], (1, 2): [3, 7], (2, 1): [3, 7], (3, 1): []}


def test_block_matrix(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), f"f{rng.randrange(3000):04d}") for _ in range(6000)]
    names = sorted({b for _, b in rows})
    got = {(r.id, r.block * 100 + p) for r in fingerprints.block_matrix(spark.createDataFrame(rows, "id long, bit string"), 100).collect() for p in r.places}
    assert got == {(i, names.index(b)) for i, b in rows}


def test_requirements_of_few_guidelines(spark):
    """The join in parts gives the rows of a full outer join, nulls and one-sided guidelines included."""
    rng = random.Random(4)
    guideline = lambda: rng.choice([None, 1, 2, 3, 4])
    positive = [(guideline(), rng.randrange(3), f"t{rng.randrange(4)}") for _ in range(50)] + [(8, 1, "t")]
    missing = [(guideline(), f"m{i}") for i in range(60)] + [(9, "m")]
    p = spark.createDataFrame(positive, "study_guideline_id int, study int, target string")
    m = spark.createDataFrame(missing, "study_guideline_id int, target string")
    got = Counter(tuple(r) for r in effects.classified_effects(p, p.limit(0), m, ["study"]).where("effect_class = 0").collect())
    studies = p.select("study_guideline_id", "study").distinct()
    want = Counter((*r, 0) for r in studies.join(m, "study_guideline_id", "full").select("study_guideline_id", "study", "target").collect())
    assert got == want
