"""Properties that hold whatever the data, and the queries without SQL against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.functions.numbers import property_text
from kinfold.functions.text import id_kind
from kinfold.operators import compare, distribution, fingerprints, neighbors, predict, roc, similarity
from kinfold.operators.block_search import Part


@pytest.fixture(scope="module")
def sets(spark):
    rnd = random.Random(11)
    rows = [(i, sorted(rnd.sample(range(40), rnd.randint(2, 15))), sorted(rnd.sample(range(40), rnd.randint(2, 15)))) for i in range(80)]
    return spark.createDataFrame(rows, "id long, a array<int>, b array<int>").persist()


def near(sets, spec, k=6):
    parts = [Part(name, weight=w) for name, w in neighbors.parse_blend(spec)]
    rows = neighbors.nearest(sets, sets, parts, k).collect()
    return {(r["target"], r["rank"], r["id"], round(r["similarity"], 3)) for r in rows}


def test_blend_of_weight_zero_drops_the_part(sets):
    assert near(sets, "a_W1_and_b_W0") == near(sets, "a")


def test_only_weight_ratios_matter_and_order_does_not(sets):
    assert near(sets, "a_W3_and_b_W2") == near(sets, "a_W1.5_and_b_W1") == near(sets, "b_W2_and_a_W3")


def test_blend_differs_from_both_parts(sets):
    blend = near(sets, "a_W1_and_b_W1")
    assert blend != near(sets, "a") and blend != near(sets, "b")


def test_neighbours_start_with_the_target_and_fall(sets):
    for target in range(0, 80, 9):
        mine = sorted(r for r in near(sets, "a") if r[0] == target)
        assert mine[0][2] == target and mine[0][3] == 1
        assert all(x[3] >= y[3] for x, y in zip(mine, mine[1:]))


def test_stored_equals_computed(spark, sets):
    ds = sets.select("id", F.col("a").alias("ds"))
    table = neighbors.neighbor_table(ds, [Part("ds")], "a", "no_filter", k=5)
    hits, missing = neighbors.stored_lookup(ds.select("id"), table, 5, 0.0)
    stored = {(r["id"], r["nn_id"]) for r in hits.collect()}
    computed = neighbors.nearest(ds, ds, [Part("ds")], 6).where("id <> target")
    assert stored == {(r["target"], r["id"]) for r in computed.collect()}
    assert missing.count() == 0
    _, all_missing = neighbors.stored_lookup(ds.select("id"), table, 101, 0.0)
    assert all_missing.count() == 80
    deep = neighbors.lookup_or_compute(ds.select("id"), table, ds, [Part("ds")], 9, 0.0)
    computed = neighbors.nearest(ds, ds, [Part("ds")], 10).where("id <> target")
    assert {(r["id"], r["nn_id"]) for r in deep.collect()} == {(r["target"], r["id"]) for r in computed.collect()}
    with pytest.raises(ValueError):
        neighbors.expand_graph(ds.select("id"), table, 2, 5, 0.0, depth=5)


@pytest.mark.parametrize("s0", [0.2, 0.5, 0.8])
def test_set_join_matches_brute_force(spark, s0, monkeypatch):
    monkeypatch.setattr(similarity, "HOT_FEATURE", 7)
    rnd = random.Random(3)
    rows = [(i, sorted(rnd.sample([f"f{j}" for j in range(25)], rnd.randint(1, 12)))) for i in range(70)]
    rows += [(100 + i, rows[0][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, ds array<string>")
    got = {(r["id"], r["nn_id"]) for r in similarity.set_similarity_join(df, df.where("id % 2 = 0"), s0).collect()}
    j = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    assert got == {(i, k) for i, x in rows for k, y in rows if k % 2 == 0 and j(x, y) >= s0}


def test_running_totals_and_medians_of_large_groups(spark):
    rnd = random.Random(2)
    rows = [(i % 3, round(rnd.gauss(0, 10), 1)) for i in range(999)] + [(7, 1.0), (7, 4.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    split = distribution.exact_median(df, ["k"], "v", "m", large=100).collect()
    plain = df.groupBy("k").agg(F.median("v").alias("m")).collect()
    assert {(r["k"], round(r["m"], 9)) for r in split} == {(r["k"], round(r["m"], 9)) for r in plain}
    totals = distribution.running_totals(df.withColumn("one", F.lit(1)), ["k"], "v", ["one"], descending=True)
    for r in totals.where("k = 1").collect():
        assert r["cum_one"] == sum(1 for k, v in rows if k == 1 and v >= r["v"])


def test_bounded_lists_keep_every_record(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("x"))
    lists = distribution.bounded_lists(df, ["k"], ["x"], "xs", limit=100)
    assert lists.agg(F.sum(F.size("xs"))).first()[0] == 1000
    assert lists.where("k = 0").count() == 5


def test_auc_matches_pair_counting_and_one_class_rule(spark):
    rnd = random.Random(4)
    rows = [(e, i, round(rnd.random(), 1), rnd.randint(0, 1)) for e in ("x", "y") for i in range(60)] + [("z", 1, 0.4, 1)]
    df = spark.createDataFrame(rows, "e string, id long, s double, y int")
    for bounded in (True, False):
        for r in roc.auc_and_threshold(df, ["e"], "s", "y", bounded).collect():
            pos = [s for e, _, s, y in rows if e == r["e"] and y]
            neg = [s for e, _, s, y in rows if e == r["e"] and not y]
            want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg) if pos and neg else 0
            assert math.isclose(r["auc"], want)
            if r["e"] == "z":
                assert r["t0"] == 0.5


def test_permutation_p_value_is_repeatable_and_counts_greater_aucs(spark):
    # a perfect score cannot be beaten, a reversed one nearly always is
    rows = [("perfect", i, i / 20, int(i >= 10)) for i in range(20)] + [("reversed", i, -i / 20, int(i >= 10)) for i in range(20)]
    rows += [("one class", i, i / 20, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "e string, id long, s double, y int")
    got = {r["e"]: r["p_val"] for r in roc.permutation_p_value(df, ["e"], "s", "y", 200).collect()}
    assert got["perfect"] == 0 and got["reversed"] > 0.95 and got["one class"] == 1
    assert got == {r["e"]: r["p_val"] for r in roc.permutation_p_value(df, ["e"], "s", "y", 200).collect()}


def test_permutation_p_value_against_every_shuffle_drawn_anew(spark):
    rnd = random.Random(4)
    rows = [(e, i, rnd.randint(0, 6) / 6, rnd.randint(0, 1)) for e in "uvwxyz" for i in range(rnd.choice((1, 2, 7, 40)))]
    low = 2**32 - 1

    def draw(e, i, number):
        h = (int(hashlib.md5(f"3:{e}:{i}".encode()).hexdigest()[:8], 16) + 2654435761 * number) & low
        h = ((h ^ h >> 16) * 0x85EBCA6B) & low
        h = ((h ^ h >> 13) * 0xC2B2AE35) & low
        return h ^ h >> 16, i

    def area(pos, neg):
        return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)

    df = spark.createDataFrame(rows, "e string, id long, s double, y int").repartition(3)
    got = {r["e"]: r["p_val"] for r in roc.permutation_p_value(df, ["e"], "s", "y", 50, 3).collect()}
    assert set(got) == set("uvwxyz")
    for e in got:
        cell = {i: (s, y) for f, i, s, y in rows if f == e}
        n_pos = sum(y for _, y in cell.values())
        seen = area([s for s, y in cell.values() if y], [s for s, y in cell.values() if not y])
        greater = 0
        for number in range(1, 51):
            order = sorted(cell, key=lambda i: draw(e, i, number))
            greater += area([cell[i][0] for i in order[:n_pos]], [cell[i][0] for i in order[n_pos:]]) > seen
        assert got[e] == (greater / 50 if 0 < n_pos < len(cell) else 1.0)


def test_lists_of_mutual_neighbours_need_no_pairs(spark):
    rnd = random.Random(5)
    lists = spark.createDataFrame([(i // 9, i % 9, i) for i in range(45)], "list_id long, pos long, id long")
    obs = spark.createDataFrame([(i, e, rnd.randint(0, 1)) for i in range(45) for e in "ab" if rnd.random() < 0.8], "id long, endpoint string, obs int")
    near = predict.given_neighbourhoods(lists)
    known = predict.list_observations(near, obs)
    act = predict.sides(known)
    a, b = near.select("target", F.col("id").alias("a")), near.select("target", F.col("id").alias("b"))
    pairs = a.join(b, "target").where("a <> b").withColumn("similarity", F.lit(1.0))
    rounded = lambda df: {tuple(r) for r in df.withColumn("a_p", F.round("a_p", 9)).collect()}
    assert rounded(predict.leave_one_out_of_lists(near, act)) == rounded(predict.leave_one_out(near, pairs, act, 9))
    first = predict.read_across_lists(predict.given_neighbourhoods(lists, first_only=True), known).collect()
    every = {tuple(r) for r in predict.read_across_lists(near, known).collect()}
    heads = {f"{i}|{9 * i}" for i in range(5)}
    assert {tuple(r) for r in first} == {r for r in every if r[0] in heads} and {r["k0"] for r in first} == {9}


def test_pairs_of_a_neighbourhood_by_matrix_products(spark, monkeypatch):
    rnd = random.Random(9)
    ds = {i: rnd.sample([f"w{j}" for j in range(60)], rnd.randint(0, 30)) for i in range(40)} | {40: None}
    rows = [(t, i) for t in range(6) for i in rnd.sample(range(43), 15)] + [(6, 1), (6, 1), (6, 2)]
    members = spark.createDataFrame(rows, "target long, id long")
    features = spark.createDataFrame(list(ds.items()), "id long, ds array<string>")
    got = {(r["target"], r["a"], r["b"]): r["similarity"] for r in similarity.neighbourhood_pairs(members, features, [Part("ds")]).collect()}
    want = {}
    for t, a in rows:
        for u, b in rows:
            if t == u and a != b and a in ds and b in ds:
                x, y = set(ds[a] or ()), set(ds[b] or ())
                want[t, a, b] = len(x & y) / len(x | y) if x | y else 0
    assert got == want
    monkeypatch.setattr(similarity, "DENSE", 50)
    codes = [sorted(rnd.sample(range(90), n)) for n in (0, 5, 40, 90)]
    shared = similarity._overlaps(np.array([len(c) for c in codes]), np.array(sum(codes, [])))
    assert shared.tolist() == [[len(set(x) & set(y)) for y in codes] for x in codes]


def test_an_analog_in_both_sets_counts_in_both(spark):
    members = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5), (1, 3, 0.4)], "target long, id long, similarity double")
    obs = spark.createDataFrame([(2, "e", 1), (2, "e", 0), (3, "e", 0)], "id long, endpoint string, obs int")
    row = predict.weighted_activity(members, predict.sides(obs)).first()
    assert (row["posnb"], row["negnb"]) == (1, 2)
    row = predict.weighted_activity(members, predict.activity(obs)).first()
    assert (row["posnb"], row["negnb"]) == (1, 1)


def test_read_across_of_a_subset_of_endpoints_is_the_same(spark, sets):
    ds = sets.select("id", F.col("a").alias("ds"))
    rnd = random.Random(8)
    obs = spark.createDataFrame([(i, e, rnd.randint(0, 1)) for i in range(80) for e in ("liver", "kidney") if rnd.random() < 0.8], "id long, endpoint string, obs int")
    members = neighbors.nearest(ds, ds, [Part("ds")], 8)
    run = lambda o: {tuple(r) for r in predict.read_across(members, ds, [Part("ds")], o, "a", 8, 0.0).collect()}
    full = run(obs)
    assert {r for r in full if r[1] == "liver"} == run(obs.where("endpoint = 'liver'"))
    assert {r[-1] for r in full} <= {"TP", "TN", "FP", "FN", "Pos", "Neg"}


def test_hashed_bits(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "")], "id long, text string")
    got = {r["id"]: (r["ds"], r["n"]) for r in fingerprints.hashed_fingerprints(texts, F.array_remove(F.split("text", " "), ""), "w").collect()}
    assert set(got) == {1, 2} and got[1][1] == 2 and len(set(got[1][0]) & set(got[2][0])) == 1
    assert all(b.startswith("w_") and 0 <= int(b[2:]) < 2048 for ds, _ in got.values() for b in ds)


def test_sample_is_whole_and_repeatable(spark):
    a, b = spark.range(50), spark.range(20, 90)
    first = compare.sample_ids(a, b, 10)
    assert {r["id"] for r in first.collect()} <= set(range(20, 50)) and first.count() == 10
    assert first.collect() == compare.sample_ids(b, a, 10).collect()


def test_id_kinds(spark):
    texts = ["DTXCID101", "dtxsid7", "80-05-7", "1234567-89-0 x", "Bisphenol A", "CC(C)O", "12345678-99-9"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    kinds = [r[0] for r in df.select(id_kind(F.col("t"))).collect()]
    assert kinds == ["cid", "sid", "casrn", "casrn", "name", "name", "name"]


def test_property_text(spark):
    values = [0.0, 0.00001234, 0.05, 0.1, 1.236, -0.004, 120.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shown = [r[0] for r in df.select(property_text(F.col("v"), 2)).collect()]
    assert shown == ["0.00", "1.23e-05", "0.05", "0.1", "1.24", "-0.004", "120.00", None]


def test_thresholds_and_registry():
    assert neighbors.effective_threshold(0.1, [0.005]) == 0.005
    assert neighbors.effective_threshold(0.001, [0.005]) == 0.001
    assert neighbors.effective_threshold(0.1, [0.005, None]) == 0.1
    with pytest.raises(ValueError):
        fingerprints.register(fingerprints.FingerprintSpec("twice", lambda t: t))
        fingerprints.register(fingerprints.FingerprintSpec("twice", lambda t: t))
    fingerprints.REGISTRY.pop("twice")


def test_neighbourhoods_are_compared_many_at_a_time(spark, monkeypatch):
    # no group of its own for each neighbourhood
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInArrow", lambda *_: pytest.fail("one call for each neighbourhood"))
    sets = [(i, [f"w{j}" for j in range(i % 7)] + (["x"] if i % 2 else [])) for i in range(60)] + [(60, None)]
    features = spark.createDataFrame(sets, "id long, ds array<string>")
    # neighbourhoods of 1 to 20, a repeated member and one without features
    near = [(t, (t * 7 + i) % 61) for t in range(40) for i in range(1 + t % 20)] + [(3, 21), (3, 21), (5, 999)]
    got = similarity.neighbourhood_pairs(spark.createDataFrame(near, "target long, id long"), features, [Part("ds")]).collect()
    known, of = {i: set(ds or []) for i, ds in sets}, {}
    for t, i in near:
        of.setdefault(t, set()).add(i)
    want = [(t, a, b, len(known[a] & known[b]) / max(1, len(known[a] | known[b]))) for t, ids in of.items() for a in ids for b in ids if a != b and {a, b} <= set(known)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("k0", [3, 100])
def test_votes_are_counted_where_a_target_is(spark, k0):
    rnd = random.Random(k0)
    near = [(t, i) for t in range(8) for i in rnd.sample(range(12), 6)] + [(2, 50), (2, 50), (2, 51), (None, 3)]
    act = [(i, e, rnd.choice([0, 1, None])) for i in [*range(12), 50, 51] for e in ("x", "y", None) if rnd.random() < 0.7]
    score = {(t, a, b): rnd.choice([0.0, 0.25, 0.5]) for t in range(8) for a in {i for u, i in near if u == t} for b in {i for u, i in near if u == t} if a != b}
    got = predict.leave_one_out(
        spark.createDataFrame(near, "target long, id long"), spark.createDataFrame([(*key, s) for key, s in score.items()], "target long, a long, b long, similarity double"),
        spark.createDataFrame(act, "id long, endpoint string, obs int"), k0,
    )
    # neither a window nor a join moves rows of (target, endpoint, a, b)
    assert "Window" not in got._jdf.queryExecution().toString()
    seen, want = [(t, e, i, o) for t, i in near for j, e, o in act if i == j], []
    for t, e, a, obs in seen:
        voters = [(-score[t, a, b], b, o) for u, f, b, o in seen if (u, f) == (t, e) and e is not None and (t, a, b) in score]
        copies = sum((t, e, a, obs) == s for s in seen)
        voters = [v for v in sorted(voters, key=lambda v: v[:2]) for _ in range(copies)][:k0]
        weight = -sum(s for s, _, _ in voters)
        a_p = sum(-s * (o or 0) for s, _, o in voters) / weight if weight else 0.0
        want.append((t, e, a, obs, round(a_p, 9), sum(o == 1 for *_, o in voters), sum(o == 0 for *_, o in voters)))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((*r[:4], round(r[4], 9), *r[5:]) for r in map(tuple, got.collect())), key=key) == sorted(want, key=key)
