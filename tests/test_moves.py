"""How often rows are read and moved, and that results stay whole."""

import random
import re
from collections import Counter

from kinfold.operators import effects, fingerprints, grid, predict


def plan(df, text):
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return len(re.findall(text, df._jdf.queryExecution().executedPlan().toString()))
    finally:
        df.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_inverted_index_moves_its_facts_once(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "LIST", 50, raising=False)
    facts = [(i, "every") for i in range(1500)] + [(i, f"of {i % 300}") for i in range(1500)] + [(7, "every")]
    bits = spark.createDataFrame(facts, "id long, bit string")
    made = fingerprints.inverted_index(bits)
    lists = made.collect()
    assert Counter((i, r["bit"]) for r in lists for i in r["ids"]) == Counter(facts)
    assert all(r["ids"] == sorted(r["ids"]) and len(r["ids"]) <= 100 for r in lists)
    assert {r["part"] for r in lists if r["bit"] != "every"} == {0}
    # one for the facts, one for the sizes of long lists, which has a row for each feature and task
    assert plan(fingerprints.inverted_index(bits), "Exchange hashpartitioning") == 2


def test_points_of_departure_move_their_rows_once(spark):
    rnd = random.Random(3)
    pick = lambda values: rnd.choice(values)
    rows = [
        (pick([1, 2, None]), pick([1, 2]), "s", "rat", pick([0, 1, 2, 3, None]), pick([None, 1.0, 2.0, 5.0, 9.0]), "mg/kg/day", pick([0, 1, None]), pick([0, 1]))
        for _ in range(150)
    ]
    columns = ["chem_id", "study_id", "study_type", "species", "level", "dose", "unit", "effect_trt_related", "effect_critical"]
    table = spark.createDataFrame(rows, "chem_id int, study_id int, study_type string, species string, level int, dose double, unit string, effect_trt_related int, effect_critical int")
    made = effects.points_of_departure(table)
    least = lambda values: min((v for v in values if v is not None), default=None)
    want = Counter()
    for r in rows:
        if r[0] is None:
            continue
        study = [x for x in rows if x[:4] == r[:4]]
        out = []
        for mark in (7, 8):
            low, level = (least([x[c] for x in study if x[mark] == 1]) for c in (5, 4))
            below = least([x[5] for x in study if level is not None and level > 1 and x[4] == level - 1])
            out += [low, below]
        want[(*r, *out)] += 1
    got = Counter(tuple(r[c] for c in [*columns, "lel", "nel", "loael", "noael"]) for r in made.collect())
    assert got == want
    assert plan(effects.points_of_departure(table), "Exchange hashpartitioning") == 1


def test_distinct_rows_of_a_chain_are_held_by_shares(spark):
    facts = spark.createDataFrame([(i, i % 7, i % 3) for i in range(400)] + [(None, 1, 1)], "k int, a int, b int")
    names = spark.createDataFrame([(i, None if i == 5 else f"n{i % 2}") for i in range(300)], "k int, name string")
    made = effects.join_chain(facts, [(names, ["k"])], ["a", "b", "name"])
    assert Counter(map(tuple, made.collect())) == Counter({(i % 7, i % 3, None if i == 5 else f"n{i % 2}") for i in range(300)})
    # nothing is put together before the rows are dealt out, and they are dealt out once
    text = effects.join_chain(facts, [(names, ["k"])], ["a", "b", "name"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in text.split("REPARTITION_BY_COL")[0] and "HashAggregate" not in text.split("REPARTITION_BY_COL")[-1]
    assert text.count("REPARTITION_BY_COL") == 1


def test_an_assay_catalogue_reads_each_table_once(spark):
    make = spark.createDataFrame
    assays = make([(1, 10), (1, 11), (2, 10), (3, 12), (4, 10)], "aid int, acid int")
    components = make([(1, 5), (2, 6), (3, 7), (3, None)], "aid int, aeid int")
    endpoints = make([(10, "x"), (11, "y"), (12, "z")], "acid int, name string")
    genes = make([(5, "g"), (5, "h"), (7, None), (None, "n")], "aeid int, gene string")
    made = effects.assay_catalogue(assays, components, endpoints, genes)
    got = Counter(tuple(r[c] for c in ("aid", "acid", "aeid", "name", "gene")) for r in made.collect())
    assert got == Counter(
        [(1, 10, 5, "x", "g"), (1, 10, 5, "x", "h"), (1, 11, 5, "y", "g"), (1, 11, 5, "y", "h"), (2, 10, 6, "x", None), (3, 12, 7, "z", None), (3, 12, None, "z", None)]
    )
    assert plan(effects.assay_catalogue(assays, components, endpoints, genes), "Scan ExistingRDD") == 4


def test_targets_without_data_need_no_second_set_of_cells(spark):
    observations = spark.createDataFrame([(1, "a", 1), (1, "a", 0), (2, "b", 1), (2, "c", None)], "id int, endpoint string, obs int")
    targets = spark.createDataFrame([(1,), (3,), (3,)], "id int")
    got = Counter(tuple(r) for r in grid.negative_first_cells(observations, targets).collect())
    assert got == Counter([(1, "a", 0), (2, "b", 1), (2, "c", None), (3, None, None)])
    # partial and final
    assert plan(grid.negative_first_cells(observations, targets), r"HashAggregate\(keys=\[id#\d+, endpoint#\d+") == 2


def test_a_grid_moves_its_cells_once(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 2), (2, 1), (3, 3), (4, 9), (4, None), (None, 1), (5, 1), (5, 1)], "target int, id int")
    seen = [(1, "a", 1, 2.0, "mg"), (1, "a", 1, 1.0, "kg"), (1, "a", 0, None, None), (2, "b", 0, None, None), (2, None, 1, 3.0, "mg"), (9, "c", None, None, None), (7, "d", 1, None, None)]
    observations = spark.createDataFrame(seen, "id int, endpoint string, obs int, dose double, unit string")
    made = grid.read_across_grid(members, observations)
    got = Counter(tuple(r[c] for c in ("target", "endpoint", "id", "text", "value")) for r in made.collect())
    hit, none, low = ("1.0 kg", "pos_effect"), ("no_data", "no_data"), ("no_effect", "no_effect")
    want = [(1, "a", 1, *hit), (1, "a", 2, *none), (1, "a", 3, *none), (1, "b", 1, *none), (1, "b", 2, *low), (1, "b", 3, *none)]
    want += [(1, None, i, *none) for i in (1, 2, 3)] + [(2, None, i, *none) for i in (1, 2)]
    want += [(2, "a", 1, *hit), (2, "a", 2, *none), (2, "b", 1, *none), (2, "b", 2, *low), (3, "NO_DATA", 3, *none)]
    want += [(4, "c", 9, *none), (4, "c", None, *none), (None, "NO_DATA", None, *none)] + [(5, "a", 1, *hit)] * 4
    assert got == Counter(want)
    # observations and members by id; what is seen and members by target
    assert plan(grid.observation_counts(grid.read_across_grid(members, observations), ["target", "endpoint"]), "Exchange hashpartitioning") == 4


def random_lists(spark):
    rnd = random.Random(5)
    lists = [(i // 4, i % 4, i) for i in range(40)] + [(1, 4, 20), (2, 4, 9), (2, 5, 9), (None, 0, 3), (77, 0, 78)]
    seen = [(rnd.randrange(45), f"e{rnd.randrange(3)}", rnd.choice([0, 1, None])) for _ in range(160)]
    return spark.createDataFrame(lists, "list_id int, pos int, id int"), spark.createDataFrame(seen, "id int, endpoint string, obs int")


def test_a_vote_in_lists_moves_no_pairs(spark):
    lists, observations = random_lists(spark)
    near = predict.given_neighbourhoods(lists)
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    for least in (1, 2):
        want = rows(predict.vote(near, predict.list_observations(near, observations), least, least))
        assert want and rows(predict.vote_in_lists(lists, observations, least, least)) == want
    # observations by entity and by list; lists by both
    assert plan(predict.vote_in_lists(lists, observations), "Exchange hashpartitioning") <= 6


def test_leave_one_out_of_lists_makes_its_rows_once(spark):
    lists, observations = random_lists(spark)
    near = predict.given_neighbourhoods(lists.where("id <> 9"))
    act = predict.sides(predict.list_observations(near, observations)).where("obs IS NOT NULL")
    near, act = (spark.createDataFrame(df.collect(), df.schema) for df in (near, act))
    made = predict.leave_one_out_of_lists(near, act)
    seen = [tuple(r) for r in near.join(act, "id").select("target", "endpoint", "id", "obs").collect()]
    want = Counter()
    for t, e, i, o in seen:
        votes = [x[3] for x in seen if x[:2] == (t, e) and x[2] != i]
        want[(t, e, i, o, sum(votes) / len(votes) if votes else 0.0, sum(votes), len(votes) - sum(votes))] += 1
    assert Counter(tuple(r) for r in made.collect()) == want
    assert plan(predict.leave_one_out_of_lists(near, act), r"Join \[") == 1
