"""Block search against brute force, with copies, ties and several blocks."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfold.operators import block_search, neighbors
from kinfold.operators.block_search import Part, SizeBlocks, compact, set_overlap, set_scores, top_matches
from kinfold.operators.packed_sets import pack_sets, unpack_sets


def brute(targets, candidates, similarity, k):
    out = []
    for i, a in targets:
        scored = sorted((-similarity(a, b), j) for j, b in candidates if j != i and similarity(a, b) > 0)
        out += [(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def euclid(a, b):
    return 1 - math.dist(a, b) / math.sqrt(len(a))


def result(df):
    return sorted((r["id"], r["rank"], r["nn_id"], round(r["similarity"], 9)) for r in df.collect())


def random_sets(n, seed=1):
    rnd = random.Random(seed)
    rows = [(i, sorted(rnd.sample(range(60), rnd.randint(1, 25)))) for i in range(n)]
    # a third of all rows are copies of one set
    return rows + [(n + i, rows[0][1]) for i in range(n // 2)]


def test_overlap_counts_rare_and_frequent_features():
    rnd = np.random.default_rng(0)
    left = [rnd.choice(4000, size=rnd.integers(0, 30), replace=False).tolist() + [9999] for _ in range(70)]
    right = [rnd.choice(4000, size=rnd.integers(0, 30), replace=False).tolist() + [9999] for _ in range(50)]
    want = [[len(set(a) & set(b)) for b in right] for a in left]
    arrow = lambda sets: pa.array(sets, pa.list_(pa.int64()))
    assert set_overlap(arrow(left), arrow(right)).tolist() == want


@pytest.mark.parametrize("block_rows", [20, 1000])
def test_sets_match_brute_force(spark, block_rows):
    rows = random_sets(120)
    df = spark.createDataFrame(rows, "id long, ds array<int>")
    got = top_matches(df, df, [Part("ds")], 7, block_rows=block_rows)
    assert result(got) == brute(rows, rows, jaccard, 7)


def test_filtered_candidates(spark):
    rows = random_sets(100, 3)
    df = spark.createDataFrame(rows, "id long, ds array<int>")
    got = top_matches(df, df.where("id % 3 = 0"), [Part("ds")], 5, block_rows=15)
    assert result(got) == brute(rows, [r for r in rows if r[0] % 3 == 0], jaccard, 5)


@pytest.mark.parametrize("block_rows", [25, 1000])
def test_vectors_match_brute_force(spark, block_rows):
    rnd = random.Random(5)
    rows = [(i, [rnd.random() for _ in range(4)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = top_matches(df, df, [Part("v", "euclid")], 6, block_rows=block_rows)
    assert result(got) == brute(rows, rows, euclid, 6)


def test_blend_with_missing_parts(spark):
    rnd = random.Random(6)
    a = {i: sorted(rnd.sample(range(30), rnd.randint(1, 12))) for i in range(90) if i % 4}
    b = {i: sorted(rnd.sample(range(30), rnd.randint(1, 12))) for i in range(90) if i % 5}
    rows = [(i, (a.get(i), b.get(i))) for i in range(90) if i in a or i in b]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in rows], "id long, a array<int>, b array<int>")

    def blend(p, q):
        part = lambda x, y: jaccard(x, y) if x and y else 0.0
        return 0.75 * part(p[0], q[0]) + 0.25 * part(p[1], q[1])

    got = top_matches(df, df, [Part("a", weight=3), Part("b", weight=1)], 8, block_rows=16)
    assert result(got) == brute(rows, rows, blend, 8)


def test_ties_follow_the_given_order(spark):
    rows = [(1, [1, 2], "t"), (2, [1, 3], "b"), (3, [2, 3], "a"), (4, [1, 9], "a")]
    df = spark.createDataFrame(rows, "id long, ds array<int>, name string")
    got = top_matches(df.where(F.col("id") == 1), df, [Part("ds")], 3, order=["name"])
    assert [r["nn_id"] for r in got.orderBy("rank").collect()] == [3, 4, 2]


def test_blend_does_not_depend_on_blocks(spark):
    rows = [(i, [f"a{k}" for k in range(i % 7, 30 + i % 11)], [f"b{k}" for k in range(i % 5, 9 + i % 3)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a array<string>, b array<string>")
    parts = [Part("a", weight=2.0), Part("b", weight=0.3)]
    run = lambda n, floor: sorted(map(tuple, top_matches(df, df, parts, 5, floor=floor, block_rows=n).collect()))
    whole = run(1000, 0.0)
    floor = whole[len(whole) // 2][-1]
    for block_rows in (1, 16):
        assert run(block_rows, 0.0) == whole
        assert run(block_rows, floor) == run(1000, floor)


def test_blocks_without_candidates_are_not_visited(spark):
    rnd = random.Random(12)
    rows = [(i, sorted(rnd.sample(range(300), 1 + i % 120))) for i in range(600)]
    targets = spark.createDataFrame(rows, "id long, ds array<int>")
    candidates = targets.where("size(ds) BETWEEN 40 AND 44")
    named = lambda df: df.withColumn("sig", F.col("id").cast("string"))
    blocks = SizeBlocks([named(targets), named(candidates)], "ds", 20)
    held = blocks.assign(named(candidates))
    blocks.hold(held)
    own = {r["block"] for r in held.collect()}
    assert set(np.flatnonzero(blocks.held)) == own and len(own) < blocks.count / 3
    assert all(blocks.lo[b] >= 40 and blocks.hi[b] <= 44 for b in own)
    pool = [(i, ds) for i, ds in rows if 40 <= len(ds) <= 44]
    assert result(top_matches(targets, candidates, [Part("ds")], 4, block_rows=20)) == brute(rows, pool, jaccard, 4)


def test_tiles_of_a_block_give_what_the_whole_block_gives(monkeypatch):
    rnd = np.random.default_rng(4)
    sets = [rnd.choice(50, size=rnd.integers(0, 12), replace=False).tolist() for _ in range(90)] + [None]
    rows = pa.table({"ds": pa.array(sets, pa.list_(pa.int64()))})
    monkeypatch.setattr(block_search, "SET_TILE", 16)
    for face, frequent in ((7, 1024), (40, 2), (91, 0)):
        monkeypatch.setattr(block_search, "SET_FACE", face)
        monkeypatch.setattr(block_search, "FREQUENT", frequent)
        for floor in (0.0, 0.25):
            got = [(r, c, s) for tile in set_scores([Part("ds")], rows, rows, 4, np.full(91, floor)) for r, c, s in zip(*(x.tolist() for x in tile))]
            want = []
            for i, a in enumerate(sets):
                scored = sorted((-round(jaccard(a or [], b or []), 12), j) for j, b in enumerate(sets))
                want += [(i, j, -s) for s, j in scored[:4] if s < 0 and -s >= floor]
            assert got == want


def test_only_what_may_reach_the_floor_is_compared_exactly(monkeypatch):
    rnd = np.random.default_rng(5)
    sets = [rnd.choice(50, size=rnd.integers(0, 40), replace=False).tolist() for _ in range(120)] + [None]
    other = [rnd.choice(300, size=rnd.integers(0, 20), replace=False).tolist() for _ in range(121)]
    arrow = lambda x: pa.array(x, pa.list_(pa.int64()))
    rows = pa.table({"ds": arrow(sets), "os": arrow(other)})
    seen = []
    monkeypatch.setattr(block_search, "jaccard", lambda o, a, b, f=block_search.jaccard: seen.append(np.size(o)) or f(o, a, b))
    monkeypatch.setattr(block_search, "SET_TILE", 16)
    monkeypatch.setattr(block_search, "FIRST_FACE", 5, raising=False)
    monkeypatch.setattr(block_search, "SET_PIECE", 24, raising=False)
    for parts in ([Part("ds")], [Part("ds", weight=2.0), Part("os")]):
        for frequent in (0, 20, 1024):
            monkeypatch.setattr(block_search, "FREQUENT", frequent)
            score = lambda i, j: round(sum(p.weight / sum(q.weight for q in parts) * jaccard(x[i] or [], x[j] or []) for p, x in zip(parts, (sets, other))), 12)
            # sizes differ widely, so a bound by the least size of a tile would let most pairs through
            seen.clear()
            got = [(r, c, s) for tile in set_scores(parts, rows, rows, 121, np.full(121, 0.5)) for r, c, s in zip(*(x.tolist() for x in tile))]
            want = [(i, j, -s) for i in range(121) for s, j in sorted((-score(i, j), j) for j in range(121)) if -s >= 0.5]
            assert got == want
            assert sum(seen) <= len(parts) * len(want)


def test_sets_travel_as_numbers_in_few_blocks_of_bounded_size(spark):
    rows = [(i, [f"a long feature name {i * j % 97}" for j in range(1, 9)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, ds array<string>")
    assert compact(df, "ds").schema["ds"].dataType.elementType.typeName() == "long"
    assert math.ceil(600_000 / block_search.block_size(600_000, 12, block_search.MAX_SETS)) <= 10
    named = df.selectExpr("CAST(id AS STRING) AS sig", "id", "ds")
    blocks = SizeBlocks([named, named], "ds", 1000, block_features=400)
    held = blocks.assign(named).groupBy("block").agg(F.sum(F.size("ds")).alias("n")).collect()
    assert blocks.count >= 6 and max(r["n"] for r in held) < 800


def test_a_tile_of_vectors_stays_small():
    assert 5 * 8 * block_search.TILE * block_search.MAX_BLOCK <= 100 * 2**20


def test_packed_sets_come_back_whole():
    rnd = random.Random(9)
    words = np.array(rnd.sample(range(-5000, 5000), 2000), dtype=np.int64)
    sets = [None, [], [rnd.randrange(-(2**63), 2**63)], words.tolist()]
    sets += [[*rnd.sample(words.tolist(), rnd.randint(0, 40)), *(rnd.randrange(2**40) for _ in range(i % 3))] for i in range(200)]
    rows = pa.array(sets, pa.list_(pa.int64()))
    for known in (words, words[:3], words[:0]):
        packed = pack_sets(rows, known)
        assert [sorted(x) for x in unpack_sets(packed, known).to_pylist()] == [sorted(set(x or [])) for x in sets]
        assert [x is None for x in packed.to_pylist()] == [x is None for x in sets]
        shuffled = pa.array([x and rnd.sample(x, len(x)) for x in sets], pa.list_(pa.int64()))
        assert pack_sets(shuffled, known).equals(packed)
    assert sum(len(x) for x in pack_sets(pa.array([list(range(0, 150, 4))] * 9), np.arange(150)).to_pylist()) == 9 * (8 + 38)


def shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_a_search_moves_little_whatever_its_blocks(spark):
    rnd = random.Random(10)
    rows = [(i, [f"feature {x}" for x in rnd.sample(range(150), 30 + i % 9)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, ds array<string>").repartition(4).persist()
    df.count()
    before = shuffled(spark)
    made = top_matches(df, df, [Part("ds")], 20, block_rows=250)
    assert made.groupBy("id").count().where("count = 20").count() == 3000
    # some 40 bytes a set and visit, and no list of neighbours
    assert shuffled(spark) - before < 5_000_000


def test_candidates_are_not_moved_to_each_block(spark):
    rnd = random.Random(13)
    rows = [(i, rnd.sample(range(150), 30 + i % 9)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, ds array<int>").repartition(4).persist()
    df.count()
    moved, made = [], []
    for block_rows in (1500, 40):
        before = shuffled(spark)
        made.append(result(top_matches(df, df, [Part("ds")], 3, block_rows=block_rows)))
        moved.append(shuffled(spark) - before)
    # a few bytes a set and block were over a megabyte
    assert moved[1] < 1.3 * moved[0] and made[0] == made[1] == brute(rows, rows, jaccard, 3)


def test_hopeless_tiles_are_left_out_and_results_are_whole(monkeypatch, spark):
    rnd = random.Random(11)
    rows = [(i, rnd.sample(range(400), 1 + i % 90)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, ds array<int>")
    monkeypatch.setattr(block_search, "STREAM_FEATURES", 300)
    got = top_matches(df, df.where("id % 2 = 0"), [Part("ds")], 4, floor=0.1, block_rows=60)
    want = [r for r in brute(rows, [r for r in rows if r[0] % 2 == 0], jaccard, 4) if r[3] >= 0.1]
    assert result(got) == want


@pytest.mark.parametrize("way", ["fields", "lists", "bits"])
@pytest.mark.parametrize("kinds, most", [(40, 30), (300, 290), (5000, 4800)])
def test_overlaps_by_fields_of_products_by_lists_and_by_bits(monkeypatch, way, kinds, most):
    rnd = np.random.default_rng(kinds)
    # sizes for three, two and one field of a product
    sets = [sorted(rnd.choice(kinds, size=n, replace=False).tolist()) for n in [0, 1, 2, most, most, *rnd.integers(1, most, 60)]]
    arrow = lambda x: pa.array(x, pa.list_(pa.int64()))
    monkeypatch.setattr(block_search, "SET_PIECE", 24)
    monkeypatch.setattr(block_search, "SET_CHUNK", 7)
    monkeypatch.setattr(block_search, "BIT_CHUNK", 9)
    monkeypatch.setattr(block_search, "SHORT_LIST", 5)
    monkeypatch.setattr(block_search, "PLANE_WORDS", 20)
    monkeypatch.setattr(block_search, "FREQUENT", 0 if way == "lists" else 10_000)
    monkeypatch.setattr(block_search.Overlap, "_dense", lambda *_: way == "bits")
    both = block_search.Overlap(arrow(sets[:30]), arrow(sets))
    both.face(0, len(sets), by_size=True)
    floor = np.linspace(0, 1, 30)
    row, col, shared = both.reaching(0, 30, floor)
    got = sorted(zip(row.tolist(), col.tolist(), shared.tolist()))
    assert got == [(i, j, len(set(a) & set(b))) for i, a in enumerate(sets[:30]) for j, b in enumerate(sets) if set(a) & set(b) and jaccard(a, b) >= floor[i] - 1e-12]


def test_sets_are_packed_once_for_a_search(spark):
    df = spark.createDataFrame([(i, [i, i + 1, 7]) for i in range(40)], "id long, ds array<long>")
    known, words = neighbors._packed(df, [Part("ds")])
    assert known.storageLevel.useMemory and words is not None
    known.unpersist()
