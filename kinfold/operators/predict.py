"""Read-across predictions from analogs.

The target is always a column: one target and a million share one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.numbers import from_log_molar
from kinfold.operators.block_search import Part
from kinfold.operators.roc import auc_and_threshold, permutation_p_value
from kinfold.operators.similarity import neighbourhood_pairs
from kinfold.session import cut_lineage

CELL = ["target", "endpoint"]


def activity(observations: DataFrame) -> DataFrame:
    """(id, endpoint, obs): positive wins; absence of a row is no data."""
    return observations.groupBy("id", "endpoint").agg(F.max("obs").alias("obs"))


def sides(observations: DataFrame) -> DataFrame:
    """``activity`` with ``pos`` and ``neg``, 1 if the entity is in the positive or the negative set; it may be in both."""
    return observations.groupBy("id", "endpoint").agg(
        F.max("obs").alias("obs"), F.max((F.col("obs") == 1).cast("int")).alias("pos"), F.max((F.col("obs") == 0).cast("int")).alias("neg")
    )


def include_checked(members: DataFrame, checked: DataFrame) -> DataFrame:
    """Neighbourhood restricted to the entities the user kept."""
    return members.join(checked.select("id").distinct(), "id", "left_semi")


def leave_one_out(members: DataFrame, pairs: DataFrame, act: DataFrame, k0: int) -> DataFrame:
    """(target, endpoint, id, a_t, a_p, n_p, n_n): each observed member predicted from the others."""
    # a target's cells and its pairs meet where the target is; rows of (cell, a, b) are not moved
    seen = members.select("target", "id").join(act.select("id", "endpoint", "obs"), "id").repartition("target")
    cells = seen.groupBy(*CELL).agg(F.collect_list(F.struct("id", "obs")).alias("_seen"))
    of = pairs.where("a IS NOT NULL").repartition("target").groupBy("target", "a").agg(F.collect_list(F.struct("b", "similarity")).alias("_b"))
    near = of.groupBy("target").agg(F.map_from_entries(F.collect_list(F.struct("a", "_b"))).alias("_near"))
    rows = cells.join(near, "target", "left").select(*CELL, F.explode("_seen").alias("_m"), "_seen", "_near")
    others = lambda p: F.transform(
        F.filter("_seen", lambda o: o["id"] == p["b"]), lambda o: F.struct((-p["similarity"]).alias("far"), p["b"].alias("b"), o["obs"].alias("obs"))
    )
    known = F.when(F.col("endpoint").isNotNull(), F.flatten(F.transform(F.try_element_at("_near", F.col("_m.id")), others)))
    # a member that is listed so many times has each voter as often
    times = F.size(F.filter("_seen", lambda o: o["id"] == F.col("_m.id")))
    voters = rows.select(*CELL, "_m", F.coalesce(known, F.array()).alias("_v"), times.alias("_times"))
    first = F.slice(F.flatten(F.transform(F.array_sort("_v"), lambda v: F.array_repeat(v, F.col("_times")))), 1, k0)
    many = F.size("_v") * F.col("_times").cast("long") > k0
    voters = voters.select(*CELL, "_m", F.when(many, first).otherwise(F.col("_v")).alias("_v"), F.when(many, 1).otherwise(F.col("_times")).cast("long").alias("_times"))
    total = lambda of: F.aggregate("_v", F.lit(0.0), lambda s, v: s + F.coalesce(of(v), F.lit(0.0)))
    votes, weight = total(lambda v: v["obs"] * -v["far"]), total(lambda v: -v["far"])
    return voters.select(
        *CELL, F.col("_m.id").alias("id"), F.col("_m.obs").alias("a_t"), F.coalesce(F.try_divide(votes, weight), F.lit(0.0)).alias("a_p"),
        (F.col("_times") * F.size(F.filter("_v", lambda v: v["obs"] > 0))).alias("n_p"),
        (F.col("_times") * F.size(F.filter("_v", lambda v: v["obs"] == 0))).alias("n_n"),
    )


def weighted_activity(members: DataFrame, act: DataFrame, k0: int | None = None) -> DataFrame:
    """(target, endpoint, share, posnb, negnb, a_t): similarity-weighted positive share without the target.

    ``act`` from ``sides`` counts an analog that is in both sets as a positive and as a negative one.
    """
    return _weighted(members.join(act, "id"), k0)


def _weighted(cells: DataFrame, k0: int | None = None) -> DataFrame:
    """``weighted_activity`` of members that meet their observations already."""
    pos, neg = (F.col("pos") == 1, F.col("neg") == 1) if "pos" in cells.columns else (F.col("obs") == 1, F.col("obs") == 0)
    own = F.col("id") == F.col("target")
    if k0 is not None:
        near = W.partitionBy(*CELL).orderBy(own.cast("int"), F.desc("similarity"), "id")
        cells = cells.withColumn("_r", F.row_number().over(near)).where(own | (F.col("_r") <= k0))
    return cells.groupBy(*CELL).agg(
        F.try_divide(
            F.sum(F.when(~own, F.col("obs") * F.col("similarity"))), F.sum(F.when(~own, F.col("similarity")))
        ).alias("share"),
        F.count_if(~own & pos).alias("posnb"), F.count_if(~own & neg).alias("negnb"),
        F.max(F.when(own, F.col("obs"))).alias("a_t"),
    )


def call_class(a_t: Column, a_p: Column) -> Column:
    return (
        F.when(a_t > 0, F.when(a_p == 1, "TP").otherwise("FN"))
        .when(a_t == 0, F.when(a_p == 1, "FP").otherwise("TN"))
        .otherwise(F.when(a_p == 1, "Pos").otherwise("Neg"))
    )


def enough_neighbours(pos_min: int, neg_min: int) -> Column:
    few = (F.col("posnb") < pos_min) & (F.col("negnb") < neg_min)
    return ~few & (F.col("posnb") + F.col("negnb") > 0)


def enough_for_call(pos_min: int, neg_min: int) -> Column:
    negative = F.col("pred").isin("Neg", "TN", "FN")
    return F.when(negative, F.col("negnb") >= neg_min).otherwise(F.col("posnb") >= pos_min)


def display_auc(auc: Column, n_pos: Column, n_neg: Column) -> Column:
    return F.when((n_pos >= 2) & (n_neg >= 2), auc)


def read_across(
    members: DataFrame,
    features: DataFrame,
    parts: list[Part],
    observations: DataFrame,
    fp: str,
    k0: int,
    s0: float,
    pos_min: int = 1,
    neg_min: int = 1,
    rounds: int = 200,
    seed: int = 1,
    pairs: DataFrame | None = None,
) -> DataFrame:
    """Class predictions with leave-one-out ROC and permutation test, one row per (target, endpoint).

    ``members`` is the output of ``nearest``, at most k0 rows per target.
    """
    if pairs is None:
        pairs = neighbourhood_pairs(members, features, parts)
    act = sides(observations)
    return _classes(members, act, leave_one_out(members, pairs, act, k0), fp, k0, s0, pos_min, neg_min, rounds, seed)


def read_across_lists(
    members: DataFrame, observations: DataFrame, fp: str = "given", pos_min: int = 1, neg_min: int = 1, rounds: int = 200, seed: int = 1
) -> DataFrame:
    """``read_across`` within ``given_neighbourhoods``: every analog has similarity 1, so no pair is made.

    ``observations`` come from ``list_observations``. ``k0`` in the result is the size of the target's list.
    """
    act = sides(observations)
    sizes = members.groupBy("target").agg(F.count(F.lit(1)).cast("int").alias("size"))
    # these rows are all that classes need
    loo = _out_of_lists(members.select("target", "id", "similarity").join(act, "id"), ["similarity", "pos", "neg"])
    found = _classes(None, act, loo, fp, None, 1.0, pos_min, neg_min, rounds, seed)
    return found.join(sizes, "target").withColumn("k0", F.col("size")).drop("size")


def leave_one_out_of_lists(members: DataFrame, act: DataFrame) -> DataFrame:
    """``leave_one_out`` where all members of a neighbourhood are alike: the share of positives among the others."""
    return _out_of_lists(members.select("target", "id").join(act, "id"), [])


def _out_of_lists(seen: DataFrame, kept: list[str]) -> DataFrame:
    # totals of a neighbourhood by a window: a join with them would make the rows twice
    cell = W.partitionBy(*CELL)
    seen = seen.withColumns({"p": F.sum("obs").over(cell), "n": F.count(F.lit(1)).over(cell)}).dropna(subset=CELL)
    others = F.col("p") - F.col("obs")
    return seen.select(
        *CELL, "id", F.col("obs").alias("a_t"), F.coalesce(F.try_divide(others, F.col("n") - 1), F.lit(0.0)).alias("a_p"),
        others.alias("n_p"), (F.col("n") - 1 - others).alias("n_n"), *kept,
    )


def _classes(
    members: DataFrame | None, act: DataFrame, loo: DataFrame, fp: str, k0: int | None, s0: float, pos_min: int, neg_min: int, rounds: int, seed: int
) -> DataFrame:
    """Classes, gates and tests on leave-one-out scores, whose rows stand for members and act if there are no ``members``. Scores that differ by the order of their sums only are ties."""
    # kept, since curve and permutations read it
    loo = cut_lineage(loo.withColumn("a_p", F.round("a_p", 9)))
    roc = auc_and_threshold(loo, CELL, "a_p", "a_t", bounded=True)
    chance = permutation_p_value(loo, CELL, "a_p", "a_t", rounds, seed)
    near = _weighted(loo.withColumnRenamed("a_t", "obs"), k0) if members is None else weighted_activity(members, act, k0)
    near = near.where(enough_neighbours(pos_min, neg_min) & F.col("share").isNotNull())
    t0 = F.when(F.col("p_val") > 0.2, 0.5).otherwise(F.col("t0"))
    return (
        near.withColumn("share", F.round("share", 9)).join(roc, CELL).join(chance, CELL)
        .withColumn("a_p", (F.col("share") >= t0).cast("int"))
        .withColumn("pred", call_class(F.col("a_t"), F.col("a_p")))
        .where(enough_for_call(pos_min, neg_min))
        .select(
            "target", F.col("endpoint").alias("out"), F.lit(fp).alias("fp"), F.lit(k0).cast("int").alias("k0"), F.lit(s0).alias("s0"),
            "n_pos", "n_neg", "a_t", F.bround("share", 3).alias("a_s"), "a_p", "auc", "p_val", "t0", "pred",
        )
    )


def vote(members: DataFrame, observations: DataFrame, pos_min: int = 1, neg_min: int = 1) -> DataFrame:
    """Weighted-vote class: every observed analog votes with its similarity."""
    share = weighted_activity(members, activity(observations))
    return (
        share.where(F.col("share").isNotNull())
        .withColumn("pred", (F.col("share") > 0.5).cast("int"))
        .where(F.when(F.col("pred") == 1, F.col("posnb") >= pos_min).otherwise(F.col("negnb") >= neg_min))
        .select("target", "endpoint", "pred", F.bround("share", 3).alias("a_s"), "posnb", "negnb")
    )


def vote_with_uncertainty(
    members: DataFrame,
    features: DataFrame,
    parts: list[Part],
    observations: DataFrame,
    pos_min: int = 1,
    neg_min: int = 1,
    rounds: int = 100,
    seed: int = 1,
) -> DataFrame:
    """``vote`` with AUC and p-value from the analogs' leave-one-out scores; one class gives 0 and 1."""
    others = members.where(F.col("id") != F.col("target"))
    pairs = neighbourhood_pairs(others, features, parts)
    loo = cut_lineage(leave_one_out(others, pairs, activity(observations), 2**31 - 1))
    roc = auc_and_threshold(loo, CELL, "a_p", "a_t", bounded=True).select(*CELL, "auc")
    chance = permutation_p_value(loo, CELL, "a_p", "a_t", rounds, seed)
    return vote(members, observations, pos_min, neg_min).join(roc, CELL).join(chance, CELL)


def minimum_doses(observations: DataFrame) -> DataFrame:
    """(id, endpoint, dose, unit): smallest positive dose and its unit."""
    return (
        observations.where(F.col("dose") > 0).groupBy("id", "endpoint")
        .agg(F.min(F.struct("dose", "unit")).alias("least")).select("id", "endpoint", "least.*")
    )


def dose_regression(members: DataFrame, doses: DataFrame, weights: DataFrame, pos_min: int = 1) -> tuple[DataFrame, DataFrame]:
    """(predictions, dropped): similarity-weighted mean of the analogs' log molar dose.

    ``doses`` has (id, endpoint, norm_dose), ``weights`` (id, mol_weight). The
    predicted dose is calculated back with the target's own weight. Entities
    without a weight are dropped and reported.
    """
    weighted = weights.where(F.col("mol_weight") > 0)
    dropped = members.select("id").distinct().join(weighted, "id", "left_anti")
    analogs = members.where(F.col("id") != F.col("target")).join(weighted, "id", "left_semi")
    y = F.when(F.col("similarity") > 0, F.col("norm_dose"))
    predicted = (
        analogs.join(doses.where(F.col("norm_dose").isNotNull()), "id").groupBy(*CELL)
        .agg(
            F.try_divide(F.sum(F.col("similarity") * y), F.sum("similarity")).alias("estimate"),
            F.count(F.lit(1)).alias("n"),
        )
        .where((F.col("n") >= pos_min) & F.col("estimate").isNotNull())
        .join(weighted.select(F.col("id").alias("target"), "mol_weight"), "target")
        .select(*CELL, "n", "estimate", from_log_molar(F.col("estimate"), F.col("mol_weight")).alias("pred_dose"))
    )
    return predicted, dropped


def given_neighbourhoods(lists: DataFrame, first_only: bool = False) -> DataFrame:
    """(target, id, entity, similarity) for lists (list_id, pos, id) of mutual neighbours at similarity 1.

    Each entity of a list is a target in turn, or only the first one. Since an
    entity may be in several lists, ``target`` and ``id`` are "list|entity".
    """
    within = lambda c: F.concat_ws("|", F.col("list_id"), F.col(c))
    heads = (lists.where(F.col("pos") == 0) if first_only else lists).select("list_id", F.col("id").alias("head"))
    return heads.join(lists, "list_id").select(
        within("head").alias("target"), within("id").alias("id"), F.col("id").alias("entity"), F.lit(1.0).alias("similarity")
    )


def list_observations(members: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations keyed like the members of given neighbourhoods."""
    known = observations.select(F.col("id").alias("entity"), "endpoint", "obs")
    return members.select("id", "entity").distinct().join(known, "entity").select("id", "endpoint", "obs")


def vote_in_lists(lists: DataFrame, observations: DataFrame, pos_min: int = 1, neg_min: int = 1) -> DataFrame:
    """``vote`` within the ``given_neighbourhoods`` of ``lists``, each entity a target.

    Observations move once by entity and once by list, where each list is read against its
    targets; rows of (target, analog) are not moved.
    """
    entries = lists.where(F.col("list_id").isNotNull()).groupBy("list_id", "id").agg(F.count(F.lit(1)).alias("copies"))
    heads = entries.groupBy("list_id").agg(F.collect_list(F.struct("id", "copies")).alias("heads"))
    act = activity(observations.select("id", "endpoint", "obs").repartition("id"))
    seen = act.join(entries, "id").repartition("list_id").groupBy("list_id", "endpoint").agg(F.collect_list(F.struct("id", "obs", "copies")).alias("seen"))
    cells = seen.join(heads, "list_id").select("list_id", "endpoint", "seen", F.explode("heads").alias("head"))
    cells = cells.withColumn("others", F.filter("seen", lambda x: ~x["id"].eqNullSafe(F.col("head.id"))))
    total = lambda of: F.aggregate("others", F.lit(0).cast("double"), lambda s, x: s + F.coalesce(of(x), F.lit(0.0)) * x["copies"])
    number = lambda value: (F.col("head.copies") * total(lambda x: (x["obs"] == value).cast("double"))).cast("long")
    known = F.exists("others", lambda x: x["obs"].isNotNull())
    return (
        cells.where(known).select(
            F.concat_ws("|", "list_id", "head.id").alias("target"), "endpoint",
            (total(lambda x: x["obs"].cast("double")) / total(lambda x: F.lit(1.0))).alias("share"), number(1).alias("posnb"), number(0).alias("negnb"),
        )
        .withColumn("pred", (F.col("share") > 0.5).cast("int"))
        .where(F.when(F.col("pred") == 1, F.col("posnb") >= pos_min).otherwise(F.col("negnb") >= neg_min))
        .select("target", "endpoint", "pred", F.bround("share", 3).alias("a_s"), "posnb", "negnb")
    )


def audit(predictions: DataFrame, counts: DataFrame) -> DataFrame:
    """(study, share_zero_auc, n): share of predictions with AUC 0 and their observations, by study prefix."""
    study = F.get(F.split("out", ":"), 0)
    return (
        predictions.join(counts.withColumnRenamed("endpoint", "out"), "out")
        .groupBy(study.alias("study"))
        .agg(
            F.avg((F.col("auc") == 0).cast("int")).alias("share_zero_auc"),
            F.sum(F.col("pos_obs") + F.col("neg_obs")).alias("observations"), F.count(F.lit(1)).alias("n"),
        )
    )
