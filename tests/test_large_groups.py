"""Copies, hot keys and outliers: what a group sends must not grow with its square or meet in one task."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.operators import similarity
from kinfold.operators.block_search import best_rows, distance, nearest_vectors
from kinfold.operators.distribution import bounded_lists, running_totals


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_write_linear_rows(spark):
    rows = [(i, ["a", "b", "c", "d"]) for i in range(10_000)] + [(10_000, ["a", "b", "c", "d", "e"]), (10_001, ["x"])]
    df = spark.createDataFrame(rows, "id long, ds array<string>")
    found = similarity.similar_sets(df, df, 0.5)
    assert [tuple(r) for r in found.pairs.collect()] == [(0, 10_000, 4, 0.8)]
    members = Counter(r.rep for r in found.targets.collect())
    assert members == {0: 10_000, 10_000: 1, 10_001: 1}


@pytest.mark.parametrize(("mirrored", "itself"), [(True, True), (True, False), (False, True), (False, False)])
def test_expansion(spark, mirrored, itself):
    rng = random.Random(2)
    rows = [(i, sorted(rng.sample(range(8), rng.randint(1, 6)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ds array<int>")
    got = {(r.id, r.nn_id): r.overlap for r in similarity.set_similarity_join(df, df, 0.6, mirrored, itself).collect()}
    want = {}
    for i, a in rows:
        for j, b in rows:
            both = len(set(a) & set(b))
            if both >= 0.6 * len(set(a) | set(b)) and (mirrored or i <= j) and (itself or i != j):
                want[i, j] = both
    assert got == want


def test_one_outlier_leaves_ranges_even(spark):
    """A value of 1e9 among 200,000 small ones; totals stay exact."""
    rows = spark.range(200_000).select(F.lit("k").alias("k"), (F.col("id") % 50_000).cast("double").alias("v"), F.lit(1).alias("n"))
    rows = rows.unionAll(spark.createDataFrame([("k", 1e9, 1), ("small", 2.0, 1), ("small", 1.0, 1), ("small", 2.0, 1)], "k string, v double, n int"))
    totals = running_totals(rows, ["k"], "v", ["n"])
    got = {(r.k, r.v): r.cum_n for r in totals.collect()}
    assert got["k", 1e9] == 200_001 and got["k", 49_999.0] == 200_000 and all(got["k", float(v)] == 4 * (v + 1) for v in range(0, 50_000, 997))
    assert got["small", 1.0] == 1 and got["small", 2.0] == 3
    cuts = rows.where("k = 'k'").groupBy("v").count().agg(F.percentile_approx("v", [k / 256 for k in range(1, 256)], 10_000)).first()[0]
    sizes = np.bincount(np.searchsorted(np.unique(cuts), np.append(np.arange(50_000.0), 1e9)))
    assert sizes.max() <= 500


def test_lists_of_a_hot_key(spark):
    """Half of all records have one key, and many are equal: every record is kept, parts are bounded and dealt out."""
    rows = [("hot", i % 300, None if i % 7 == 0 else "x") for i in range(5000)] + [("hot", 7, "same")] * 3000 + [(f"k{i % 900}", i, "y") for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, a int, b string")
    lists = bounded_lists(df, ["k"], ["a", "b"], "found", limit=500)
    got = [(r.k, r.part, [tuple(x) for x in r.found]) for r in lists.collect()]
    assert Counter((k, *x) for k, _, found in got for x in found) == Counter(rows)
    hot = [found for k, _, found in got if k == "hot"]
    assert len(hot) >= 8 and max(map(len, hot)) <= 3000
    assert all(found == sorted(found, key=lambda x: (x[0], x[1] is not None, x[1] or "")) for found in hot)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning(k" in plan_of(lists) and "REPARTITION_BY_COL" in plan_of(lists)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("metric", ["euclid", "cosine"])
def test_preselection_equals_exact_distances(metric):
    """Ties, copies, nulls and vectors of very different length."""
    rng = np.random.default_rng(5)
    a = rng.random((90, 16)) * np.where(rng.random((90, 1)) < 0.2, 1000, 1)
    a[10:20] = a[0]
    a[30] = a[31] + 1e-9
    if metric == "cosine":
        a /= np.sqrt((a * a).sum(1, keepdims=True))
    else:
        a /= a.max()
    rows = [None if k % 11 == 3 else a[k].tolist() for k in range(90)]
    column = pa.array(rows, pa.list_(pa.float64()))
    known = np.array([r is not None for r in rows])
    for k, floor in ((1, 0.0), (5, 0.0), (5, 0.9), (200, 0.3)):
        d = distance(a[known], a[known])
        scores = np.zeros((90, 90))
        scores[np.ix_(known, known)] = np.round(1 - d / 4 if metric == "euclid" else 1 - d**2 / 2, 12)
        row, col = best_rows(scores, k, np.full(90, floor))
        got = nearest_vectors(metric, column, column, k, np.full(90, floor))
        assert got[0].tolist() == row.tolist() and got[1].tolist() == col.tolist() and got[2].tolist() == scores[row, col].tolist()
