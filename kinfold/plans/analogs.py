"""Queries of neighbour search, prediction and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import fingerprints, grid, neighbors, predict, properties, similarity
from kinfold.operators.block_search import Part
from kinfold.operators.fingerprints import REGISTRY, FingerprintSpec, register
from kinfold.plans.aggregates import GRID, basket_grid, norm_doses, rounded
from kinfold.plans.joins import scaled_embeddings
from kinfold.plans.registry import big, query, r6, text
from kinfold.plans.tables import Tables, cte, engine, knn, members, pairs

BITS = [Part("ds")]

register(FingerprintSpec("word", lambda t: t.word_lists))
register(FingerprintSpec("word_hashed", lambda t: t.word_bits, cutoff=0.05))
register(FingerprintSpec("basket", lambda t: t.basket_sets))
register(FingerprintSpec("range", lambda t: t.range_sets, cutoff=0.005))
register(FingerprintSpec("embedding", scaled_embeddings, metric="euclid"))


def near_documents(t: Tables, k0: int, s0: float = 0.0):
    return neighbors.nearest(t.word_lists, t.word_lists, BITS, k0, s0, t.labelled)


def near_customers(t: Tables, k0: int, s0: float = 0.0):
    return neighbors.nearest(t.basket_sets, t.basket_sets, BITS, k0, s0, t.returners)


def cells_text(df, *names: str):
    """Columns with similarity rounded for output."""
    return df.select(*names, r6("similarity", "similarity"))


@query(
    "H01_nearest_labelled_documents",
    cte("words", "labelled", members("words", 10, "labelled")) + "SELECT target, rank, id, round(similarity, 6) AS similarity FROM members",
)
def nearest(t: Tables):
    return near_documents(t, 10).select("target", big("rank", "rank"), "id", r6("similarity", "similarity"))


@query(
    "H02_cutoff_override",
    cte("ranges", members("ranges", 5, floor=0.005)) + "SELECT target, rank, id, round(similarity, 6) AS similarity FROM members",
)
def cutoff(t: Tables):
    spec = REGISTRY["range"]
    s0 = neighbors.effective_threshold(0.1, [spec.cutoff])
    near = neighbors.nearest(t.range_sets, spec.builder(t), [Part("ds", spec.metric)], 5, s0)
    return near.select("target", big("rank", "rank"), "id", r6("similarity", "similarity"))


def blend_sql(k: int) -> str:
    n = 10**9
    return (
        cte("baskets", "ranges", "returners", knn("baskets", n, "returners", "b"), knn("ranges", n, "returners", "r"))
        + ", blend AS (SELECT id, nn_id, sum(w * similarity / 3) AS similarity FROM (SELECT id, nn_id, similarity, 2::DOUBLE AS w FROM b UNION ALL SELECT id, nn_id, similarity, 1::DOUBLE FROM r) GROUP BY id, nn_id), "
        "ranked AS (SELECT id AS target, 1 + row_number() OVER (PARTITION BY id ORDER BY round(similarity, 12) DESC, nn_id) AS rank, nn_id AS id, similarity FROM blend WHERE similarity >= 0.15) "
        f"SELECT target, round(similarity, 6) AS similarity, count(*) AS n FROM (SELECT target, similarity FROM ranked WHERE rank <= {k} UNION ALL SELECT DISTINCT id, 1.0::DOUBLE FROM baskets) GROUP BY ALL"
    )


def blended_sets(t: Tables):
    baskets = t.basket_sets.select("id", F.col("ds").alias("basket"))
    return baskets.join(t.range_sets.select("id", F.col("ds").alias("range")), "id", "full")


@query("H03_weighted_hybrid", blend_sql(6))
def hybrid(t: Tables):
    parts = [Part(name, weight=w) for name, w in neighbors.parse_blend("basket_W2_and_range_W1_and_word_W0")]
    sets = blended_sets(t)
    near = neighbors.nearest(sets, sets, parts, 6, 0.15, t.returners)
    return near.groupBy("target", r6("similarity", "similarity")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "H03_hybrid_neighbours",
    blend_sql(6).rpartition("SELECT target, round(similarity, 6)")[0]
    + "SELECT target, rank, id, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 6 UNION ALL SELECT DISTINCT id, 1, id, 1.0::DOUBLE FROM baskets",
)
def hybrid_neighbours(t: Tables):
    parts = [Part(name, weight=w) for name, w in neighbors.parse_blend("basket_W2_and_range_W1")]
    sets = blended_sets(t)
    near = neighbors.nearest(sets, sets, parts, 6, 0.15, t.returners)
    return near.select("target", big("rank", "rank"), "id", r6("similarity", "similarity"))


@query(
    "H04_all_pairs_neighbour_table",
    cte("baskets", knn("baskets", 100)) + "SELECT 'basket' AS fp_id, 'no_filter' AS sel_by, id, rank, nn_id, round(round(similarity, 10), 6) AS similarity FROM knn",
)
def table(t: Tables):
    out = neighbors.neighbor_table(t.basket_sets, BITS, "basket", "no_filter")
    return out.select("fp_id", "sel_by", "id", big("rank", "rank"), "nn_id", r6("similarity", "similarity"))


@query(
    "H05_stored_neighbour_lookup",
    cte("baskets", "rich AS (SELECT b.* FROM baskets b JOIN customer ON c_custkey = b.id WHERE c_acctbal > 0)", "returners", knn("rich", 6))
    + "SELECT id, nn_id, round(similarity, 6) AS similarity FROM knn WHERE id IN (FROM returners) AND rank <= 4 AND similarity >= 0.25 "
    "UNION ALL SELECT id, -1, 0 FROM returners WHERE id NOT IN (SELECT id FROM knn)",
)
def lookup(t: Tables):
    rich = t.basket_sets.join(t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id")), "id", "left_semi")
    stored = neighbors.neighbor_table(rich, BITS, "basket", "no_filter", k=6)
    hits, missing = neighbors.stored_lookup(t.returners, stored, 4, 0.25)
    return cells_text(hits, "id", "nn_id").unionByName(missing.select("id", big(F.lit(-1), "nn_id"), F.lit(0.0).alias("similarity")))


@query(
    "H05_lookup_or_compute",
    cte("baskets", "returners", knn("baskets", 8)) + "SELECT id, rank, nn_id, round(similarity, 6) AS similarity FROM knn WHERE id IN (FROM returners) AND similarity >= 0.25",
)
def lookup_or_compute(t: Tables):
    stored = neighbors.neighbor_table(t.basket_sets, BITS, "basket", "no_filter", k=3)
    near = neighbors.lookup_or_compute(t.returners, stored, t.basket_sets, BITS, 8, 0.25)
    return near.select("id", big("rank", "rank"), "nn_id", r6("similarity", "similarity"))


@query(
    "H06_filter_fallback",
    cte("baskets", "returners", knn("baskets", 1, "returners", "f"), knn("baskets", 1, name="o"))
    + "SELECT c_custkey AS id, CASE WHEN f.id IS NULL AND o.id IS NOT NULL THEN 'no_filter' ELSE 'returners' END AS effective_sel_by, f.id IS NULL AND o.id IS NOT NULL AS switched FROM customer "
    "LEFT JOIN (FROM f WHERE similarity >= 0.3) f ON f.id = c_custkey LEFT JOIN (FROM o WHERE similarity >= 0.3) o ON o.id = c_custkey",
)
def fallback(t: Tables):
    kept = neighbors.neighbor_table(t.basket_sets, BITS, "basket", "returners", t.returners, k=3)
    stats = neighbors.neighbor_stats(kept.unionByName(neighbors.neighbor_table(t.basket_sets, BITS, "basket", "no_filter", k=3)))
    return neighbors.fallback_filter(t.customer.select(F.col("c_custkey").alias("id")), stats, "basket", "returners", 0.3)


PAIRS = pairs("words")


@query(
    "H07_pairwise_similarity_in_neighbourhood",
    cte("words", "labelled", members("words", 5, "labelled"), PAIRS) + "SELECT target, a, b, round(similarity, 6) AS similarity FROM pairs",
)
def pairwise(t: Tables):
    return cells_text(similarity.neighbourhood_pairs(near_documents(t, 5), t.word_lists, BITS), "target", "a", "b")


@query("H08_activity_matrix", cte("dose_obs") + "SELECT id, endpoint, max(obs) AS obs FROM dose_obs GROUP BY id, endpoint")
def activity(t: Tables):
    return predict.activity(t.dose_obs)


LOO = (
    "act AS (SELECT id, endpoint, max(obs) AS obs FROM label_obs GROUP BY id, endpoint), seen AS (SELECT target, endpoint, m.id, obs FROM {m} m JOIN act USING (id)), "
    "loo AS (SELECT s.target, s.endpoint, s.id, any_value(s.obs) AS a_t, coalesce(sum(o.obs * p.similarity) / nullif(sum(p.similarity), 0), 0) AS a_p, "
    "count(*) FILTER (o.obs = 1) AS n_p, count(*) FILTER (o.obs = 0) AS n_n FROM seen s LEFT JOIN (pairs p JOIN seen o ON o.target = p.target AND o.id = p.b) "
    "ON p.target = s.target AND p.a = s.id AND o.endpoint = s.endpoint GROUP BY ALL)"
)


@query(
    "H09_leave_one_out_activity",
    cte("words", "labelled", "label_obs", members("words", 6, "labelled"), PAIRS, LOO.format(m="members")) + "SELECT target, endpoint, id, a_t, round(a_p, 6) AS a_p, n_p, n_n FROM loo",
)
def leave_one_out(t: Tables):
    near = near_documents(t, 6)
    pairs = similarity.neighbourhood_pairs(near, t.word_lists, BITS)
    loo = predict.leave_one_out(near, pairs, predict.activity(t.label_obs), 6)
    return loo.withColumn("a_p", F.round("a_p", 6))


SHARE = (
    "act AS (SELECT id, endpoint, max(obs) AS obs FROM label_obs GROUP BY id, endpoint), "
    "share AS (SELECT target, endpoint, sum(CASE WHEN m.id <> target THEN obs * similarity END) / nullif(sum(CASE WHEN m.id <> target THEN similarity END), 0) AS share, "
    "count(*) FILTER (m.id <> target AND obs = 1) AS posnb, count(*) FILTER (m.id <> target AND obs = 0) AS negnb, max(CASE WHEN m.id = target THEN obs END) AS a_t FROM members m JOIN act USING (id) GROUP BY ALL), "
    "called AS (SELECT *, CASE WHEN a_t = 1 THEN CASE WHEN share >= 0.5 THEN 'TP' ELSE 'FN' END WHEN a_t = 0 THEN CASE WHEN share >= 0.5 THEN 'FP' ELSE 'TN' END "
    "WHEN share >= 0.5 THEN 'Pos' ELSE 'Neg' END AS pred FROM share WHERE share IS NOT NULL)"
)


def called(t: Tables):
    share = predict.weighted_activity(near_documents(t, 8), predict.activity(t.label_obs)).where("share IS NOT NULL")
    a_p = (F.col("share") >= 0.5).cast("int")
    return share.withColumn("pred", predict.call_class(F.col("a_t"), a_p))


@query(
    "H10_target_prediction_class",
    cte("words", "labelled", "label_obs", members("words", 8, "labelled"), SHARE) + "SELECT target, endpoint, round(share, 6) AS a_s, pred FROM called",
)
def prediction(t: Tables):
    return called(t).select("target", "endpoint", r6("share", "a_s"), "pred")


@query(
    "H11_prediction_gates",
    cte("words", "labelled", "label_obs", members("words", 8, "labelled"), SHARE)
    + "SELECT target, endpoint, posnb, negnb, pred FROM called WHERE NOT (posnb < 3 AND negnb < 2) AND CASE WHEN pred IN ('Neg', 'TN', 'FN') THEN negnb >= 2 ELSE posnb >= 3 END",
)
def gates(t: Tables):
    kept = called(t).where(predict.enough_neighbours(3, 2)).where(predict.enough_for_call(3, 2))
    return kept.select("target", "endpoint", "posnb", "negnb", "pred")


@query(
    "H11_gates_with_both_sides",
    cte("baskets", "returners", "dose_obs", members("baskets", 6, "returners"), SHARE.replace("label_obs", "dose_obs").replace("share >= 0.5", "round(share, 9) >= 0.5"))
    + ", b AS (SELECT DISTINCT target, endpoint, m.id, d.obs FROM members m JOIN dose_obs d ON d.id = m.id WHERE m.id <> target), "
    "n AS (SELECT target, endpoint, count(*) FILTER (obs = 1) AS posnb, count(*) FILTER (obs = 0) AS negnb FROM b GROUP BY ALL) "
    "SELECT target, endpoint, n.posnb, n.negnb, pred FROM called JOIN n USING (target, endpoint) WHERE CASE WHEN pred IN ('Neg', 'TN', 'FN') THEN n.negnb >= 1 ELSE n.posnb >= 1 END",
)
def gates_both(t: Tables):
    share = predict.weighted_activity(near_customers(t, 6), predict.sides(t.dose_obs)).where("share IS NOT NULL")
    made = share.withColumn("pred", predict.call_class(F.col("a_t"), (F.round("share", 9) >= 0.5).cast("int")))
    return made.where(predict.enough_neighbours(1, 1)).where(predict.enough_for_call(1, 1)).select("target", "endpoint", "posnb", "negnb", "pred")


AUC = (
    "auc AS (SELECT a.target, a.endpoint, count(*) AS pairs_n, avg(CASE WHEN a.a_p > b.a_p THEN 1.0 WHEN a.a_p = b.a_p THEN 0.5 ELSE 0.0 END) AS auc FROM rounded a JOIN rounded b "
    "ON a.target = b.target AND a.endpoint = b.endpoint AND a.a_t = 1 AND b.a_t = 0 GROUP BY ALL)"
)
ROUNDED = "rounded AS (SELECT target, endpoint, id, a_t, a_p FROM loo)"


@query(
    "H12_read_across_classification",
    cte("words", "labelled", "label_obs", members("words", 8, "labelled"), PAIRS, LOO.format(m="members"), ROUNDED, AUC, SHARE.replace("act AS (SELECT id, endpoint, max(obs) AS obs FROM label_obs GROUP BY id, endpoint), ", ""))
    + ", sizes AS (SELECT target, endpoint, count(*) FILTER (a_t = 1) AS n_pos, count(*) FILTER (a_t = 0) AS n_neg FROM loo GROUP BY ALL) "
    "SELECT target, endpoint AS out, n_pos, n_neg, round_even(share, 3) AS a_s, round(coalesce(auc, 0), 3) AS auc FROM share JOIN sizes USING (target, endpoint) LEFT JOIN auc USING (target, endpoint) WHERE share IS NOT NULL",
)
def read_across(t: Tables):
    out = predict.read_across(near_documents(t, 8), t.word_lists, BITS, t.label_obs, "word", 8, 0.0, pos_min=0, neg_min=0)
    return out.select("target", "out", "n_pos", "n_neg", "a_s", F.round("auc", 3).alias("auc"))


@query(
    "H12_read_across_with_p_values",
    cte("words", "labelled", "label_obs", members("words", 10, "labelled", floor=0.05), PAIRS, engine("members", "label_obs", "pairs", "10", 0.05, "word")) + "FROM engine",
)
def read_across_full(t: Tables):
    return rounded(predict.read_across(near_documents(t, 10, 0.05), t.word_lists, BITS, t.label_obs, "word", 10, 0.05))


@query(
    "H13_weighted_vote",
    cte("words", "labelled", "label_obs", members("words", 8, "labelled"), "others AS (SELECT * FROM members WHERE id <> target)", PAIRS, LOO.format(m="others"), ROUNDED, AUC,
        SHARE.replace("act AS (SELECT id, endpoint, max(obs) AS obs FROM label_obs GROUP BY id, endpoint), ", ""))
    + "SELECT target, endpoint, (share > 0.5)::INTEGER AS pred, round_even(share, 3) AS a_s, posnb, negnb, round(coalesce(auc, 0), 3) AS auc FROM share LEFT JOIN auc USING (target, endpoint) "
    "WHERE share IS NOT NULL AND CASE WHEN share > 0.5 THEN posnb >= 2 ELSE negnb >= 1 END",
)
def vote(t: Tables):
    out = predict.vote_with_uncertainty(near_documents(t, 8), t.word_lists, BITS, t.label_obs, pos_min=2)
    return out.select("target", "endpoint", "pred", "a_s", "posnb", "negnb", F.round("auc", 3).alias("auc"))


@query(
    "H14_dose_regression",
    cte("baskets", "returners", members("baskets", 6, "returners"), "dose_obs")
    + ", m AS (SELECT id, endpoint, dose, unit FROM dose_obs WHERE dose > 0 QUALIFY row_number() OVER (PARTITION BY id, endpoint ORDER BY dose, unit) = 1), "
    "y AS (SELECT id, endpoint, log10(dose * CASE unit WHEN 'mg/kg/wk' THEN 1.0::DOUBLE / 7 ELSE 1 END / c_acctbal) AS y FROM m JOIN customer ON c_custkey = id WHERE c_acctbal > 0), "
    "e AS (SELECT target, endpoint, sum(similarity * y) / sum(similarity) AS estimate, count(*) AS n FROM members JOIN y USING (id) WHERE id <> target GROUP BY ALL HAVING count(*) >= 2) "
    "SELECT target, endpoint, n, round(estimate, 6) AS estimate, round(power(10, estimate) * c_acctbal, 4) AS pred_dose FROM e JOIN customer ON c_custkey = target WHERE c_acctbal > 0",
)
def regression(t: Tables):
    weights = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("mol_weight"))
    predicted, _ = predict.dose_regression(near_customers(t, 6), norm_doses(t), weights, pos_min=2)
    return predicted.select("target", "endpoint", "n", r6("estimate", "estimate"), F.round("pred_dose", 4).alias("pred_dose"))


@query(
    "H14_entities_without_weight",
    cte("baskets", "returners", members("baskets", 6, "returners")) + "SELECT DISTINCT id FROM members WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def weightless(t: Tables):
    weights = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("mol_weight"))
    return predict.dose_regression(near_customers(t, 6), norm_doses(t), weights)[1]


@query(
    "H15_auc_display_rule",
    cte("words", "labelled", "label_obs", members("words", 8, "labelled"), PAIRS, engine("members", "label_obs", "pairs", "8", 0.0, "word"))
    + "SELECT target, out, n_pos, n_neg, CASE WHEN n_pos >= 2 AND n_neg >= 2 THEN auc END AS shown FROM engine",
)
def display(t: Tables):
    made = rounded(predict.read_across(near_documents(t, 8), t.word_lists, BITS, t.label_obs, "word", 8, 0.0))
    return made.select("target", "out", "n_pos", "n_neg", predict.display_auc(F.col("auc"), F.col("n_pos"), F.col("n_neg")).alias("shown"))


LISTED = "lists AS (SELECT c_custkey // 4 AS list_id, c_custkey % 4 AS pos, c_custkey AS id FROM customer), act AS (SELECT id, endpoint, max(obs) AS obs FROM dose_obs GROUP BY ALL)"


@query(
    "H16_given_neighbourhoods",
    cte("dose_obs", LISTED)
    + ", v AS (SELECT h.list_id || '|' || h.id AS target, endpoint, avg(obs) AS share, count(*) FILTER (obs = 1) AS posnb, count(*) FILTER (obs = 0) AS negnb FROM lists h JOIN lists o ON o.list_id = h.list_id AND o.id <> h.id "
    "JOIN act ON act.id = o.id GROUP BY ALL) SELECT target, endpoint, (share > 0.5)::INTEGER AS pred, round_even(share, 3) AS a_s, posnb, negnb FROM v WHERE CASE WHEN share > 0.5 THEN posnb >= 1 ELSE negnb >= 1 END",
)
def given(t: Tables):
    lists = t.customer.selectExpr("c_custkey DIV 4 AS list_id", "c_custkey % 4 AS pos", "c_custkey AS id")
    return predict.vote_in_lists(lists, t.dose_obs)


@query(
    "H16_first_of_given_neighbourhoods",
    cte("dose_obs", LISTED)
    + ", m AS (SELECT h.list_id || '|' || h.id AS target, o.list_id || '|' || o.id AS id, o.id AS entity, 1.0::DOUBLE AS similarity FROM lists h JOIN lists o USING (list_id) WHERE h.pos = 0), "
    "known AS (SELECT DISTINCT m.id, endpoint, obs FROM m JOIN dose_obs d ON d.id = m.entity), sizes AS (SELECT target, count(*)::INTEGER AS k FROM m GROUP BY target), "
    + engine("m", "known", "", "NULL", 1.0, "given") + " SELECT engine.* REPLACE (k AS k0) FROM engine JOIN sizes USING (target)",
)
def given_first(t: Tables):
    lists = t.customer.selectExpr("c_custkey DIV 4 AS list_id", "c_custkey % 4 AS pos", "c_custkey AS id")
    near = predict.given_neighbourhoods(lists, first_only=True)
    return rounded(predict.read_across_lists(near, predict.list_observations(near, t.dose_obs)))


BATCH = (
    "act AS (SELECT id, endpoint, max(obs) AS obs FROM dose_obs GROUP BY ALL), every AS (SELECT 'basket' AS fp, * FROM b UNION ALL SELECT 'range', * FROM r), "
    "v AS (SELECT fp, target, endpoint, sum(obs * similarity) / sum(similarity) AS share, count(*) FILTER (obs = 1) AS posnb, count(*) FILTER (obs = 0) AS negnb FROM every e JOIN act ON act.id = e.id WHERE e.id <> target GROUP BY ALL)"
)


@query(
    "H17_batch_over_fingerprints",
    cte("baskets", "ranges", "returners", "dose_obs", members("baskets", 4, "returners", "b"), members("ranges", 4, "returners", "r"), BATCH)
    + "SELECT fp, endpoint, count(*) AS n, count(*) FILTER (share > 0.5) AS positive FROM v WHERE CASE WHEN share > 0.5 THEN posnb >= 1 ELSE negnb >= 1 END GROUP BY fp, endpoint",
)
def batch(t: Tables):
    out = None
    for fp in ("basket", "range"):
        sets = REGISTRY[fp].builder(t)
        near = neighbors.nearest(sets, sets, BITS, 4, holders=t.returners)
        one = predict.vote(near, t.dose_obs).withColumn("fp", F.lit(fp))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("fp", "endpoint").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == 1).alias("positive"))


@query(
    "H17_batch_read_across",
    cte("baskets", "ranges", "returners", "dose_obs", members("baskets", 4, "returners", "b"), members("ranges", 4, "returners", "r"), pairs("baskets", "b", "bp"), pairs("ranges", "r", "rp"),
        engine("b", "dose_obs", "bp", "4", 0.0, "basket", name="be"), engine("r", "dose_obs", "rp", "4", 0.0, "range", name="re"))
    + "SELECT fp, out, count(*) AS n, sum(a_p)::BIGINT AS positive, sum(n_pos + n_neg)::BIGINT AS observed, round(avg(auc), 6) AS auc, round(avg(p_val), 6) AS p_val FROM (FROM be UNION ALL FROM re) GROUP BY fp, out",
)
def batch_engine(t: Tables):
    made = None
    for fp in ("basket", "range"):
        sets = REGISTRY[fp].builder(t)
        near = neighbors.nearest(sets, sets, BITS, 4, holders=t.returners)
        one = rounded(predict.read_across(near, sets, BITS, t.dose_obs, fp, 4, 0.0))
        made = one if made is None else made.unionByName(one)
    return made.groupBy("fp", "out").agg(
        F.count(F.lit(1)).alias("n"), F.sum("a_p").alias("positive"), F.sum(F.col("n_pos") + F.col("n_neg")).alias("observed"),
        F.round(F.avg("auc"), 6).alias("auc"), F.round(F.avg("p_val"), 6).alias("p_val"),
    )


def graph_sql(out_only: bool) -> str:
    entered = "AND dst NOT IN (SELECT dst FROM e1 WHERE e1.target = d.target)" if out_only else ""
    once = "QUALIFY row_number() OVER (PARTITION BY target, dst ORDER BY src, rank) = 1" if out_only else ""
    return (
        cte("baskets", "returners", knn("baskets", 3, "returners"))
        + ", near AS (SELECT id AS src, rank, nn_id AS dst, round(similarity, 10) AS similarity FROM knn WHERE similarity >= 0.2), "
        "e1 AS (SELECT src AS target, src, rank, dst, similarity, least(src, dst) AS low, greatest(src, dst) AS high FROM near WHERE rank <= 2), "
        "f AS (SELECT DISTINCT target, dst AS src FROM e1), c AS (SELECT f.target, n.*, least(n.src, n.dst) AS low, greatest(n.src, n.dst) AS high FROM f JOIN near n ON n.src = f.src WHERE rank <= 2 OR n.src <> f.target), "
        "d AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM e1 WHERE e1.target = c.target AND e1.low = c.low AND e1.high = c.high) QUALIFY row_number() OVER (PARTITION BY target, low, high ORDER BY src, rank) = 1), "
        f"o AS (SELECT * FROM d {once}), e2 AS (SELECT * FROM o d WHERE true {entered}), "
        "edges AS (SELECT target, 1 AS step, src, dst, similarity FROM e1 UNION ALL SELECT target, 2, src, dst, similarity FROM e2) "
    )


def graph(t: Tables, out_only: bool):
    table = neighbors.neighbor_table(t.basket_sets, BITS, "basket", "returners", t.returners, k=3)
    return neighbors.expand_graph(t.basket_sets.select("id"), table, 2, 2, 0.2, out_only)


@query("H18_graph_expansion", graph_sql(False) + "SELECT target, 'basket' AS fp_id, step, src, dst, round_even(similarity, 3) AS similarity FROM edges")
def expansion(t: Tables):
    return graph(t, False)


@query("H18_graph_out_only", graph_sql(True) + "SELECT target, 'basket' AS fp_id, step, src, dst, round_even(similarity, 3) AS similarity FROM edges")
def out_only(t: Tables):
    return graph(t, True)


@query(
    "H18_graph_nodes",
    graph_sql(False)
    + "SELECT target, id, c_name AS name, bool_or(expanded) AS expanded, id = target AS is_target FROM (SELECT target, src AS id, true AS expanded FROM edges UNION ALL SELECT target, dst, false FROM edges) JOIN customer ON c_custkey = id GROUP BY ALL",
)
def nodes(t: Tables):
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return neighbors.graph_nodes(graph(t, False), customers)


@query(
    "H19_read_across_grid",
    cte("baskets", "returners", members("baskets", 4, "returners"), "dose_obs", GRID)
    + ", d AS (SELECT id, endpoint, dose, unit FROM dose_obs WHERE obs = 1 AND dose > 0 QUALIFY row_number() OVER (PARTITION BY id, endpoint ORDER BY dose, unit) = 1) "
    "SELECT target, endpoint, g.id, value, CASE WHEN value = 'pos_effect' THEN coalesce(dose || ' ' || unit, 'hit') ELSE value END AS txt FROM grid g LEFT JOIN d USING (id, endpoint)",
)
def cells(t: Tables):
    return basket_grid(t).select("target", "endpoint", "id", "value", F.col("text").alias("txt"))


@query(
    "H19_grid_without_data",
    cte("baskets", "returners", members("baskets", 2, "returners"), "dose_obs", GRID.replace("FROM dose_obs GROUP BY", "FROM dose_obs WHERE dose > 49 AND obs = 1 AND endpoint LIKE 'PROMO%' GROUP BY"))
    + "SELECT target, endpoint, id, value FROM grid UNION ALL SELECT DISTINCT target, 'NO_DATA', target, 'no_data' FROM members WHERE target NOT IN (SELECT target FROM seen)",
)
def empty_cells(t: Tables):
    rare = t.dose_obs.where("dose > 49 AND obs = 1 AND endpoint LIKE 'PROMO%'")
    return grid.read_across_grid(near_customers(t, 2), rare).select("target", "endpoint", "id", "value")


@query(
    "H20_data_availability",
    cte("baskets", "returners", members("baskets", 4, "returners"), "dose_obs", GRID) + "SELECT target, endpoint, id, (value <> 'no_data')::INTEGER AS has_data FROM grid",
)
def availability(t: Tables):
    return grid.availability(basket_grid(t))


CATALOGUE = [properties.Property("balance", "Account balance", "USD", 1), properties.Property("nation", "Nation", "", 0), properties.Property("absent", "Absent")]


@query(
    "H21_property_table",
    cte("baskets", "returners", members("baskets", 3, "returners"))
    + "SELECT target, id, place, prop_id, label, CASE WHEN v IS NULL THEN 'N/A' WHEN v <> 0 AND abs(round_even(v, places)) <= 0.1 THEN format('{:.3g}', v) WHEN places = 1 THEN format('{:.1f}', round_even(v, 1)) ELSE format('{:.0f}', v) END AS txt FROM ("
    "SELECT target, m.id, 0 AS place, 'balance' AS prop_id, 'Account balance (USD)' AS label, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal END AS v, 1 AS places, max(CASE WHEN c_mktsegment <> 'MACHINERY' THEN 1 END) OVER (PARTITION BY target) AS any_v FROM members m JOIN customer ON c_custkey = m.id "
    "UNION ALL SELECT target, m.id, 1, 'nation', 'Nation', c_nationkey::DOUBLE, 0, 1 FROM members m JOIN customer ON c_custkey = m.id) WHERE any_v = 1",
)
def property_table(t: Tables):
    rows = t.customer.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").alias("nation")
    )
    out = properties.property_table(near_customers(t, 3), properties.property_values([(rows, ["balance", "nation"])]), CATALOGUE)
    return out.withColumnRenamed("text", "txt")


@query(
    "H22_fingerprint_availability",
    cte("words", "entities")
    + ", ids AS (SELECT c_custkey + 100 AS id FROM customer), s AS (SELECT id, 'word' AS fp_id, count(*) AS n FROM words GROUP BY id UNION ALL SELECT doc_id, 'label', count(*) FROM labels GROUP BY doc_id), "
    "a AS (SELECT ids.id, f.fp_id, coalesce(n, 0) > 0 AS has_data FROM ids CROSS JOIN (VALUES ('word'), ('label')) f(fp_id) LEFT JOIN s ON s.id = ids.id AND s.fp_id = f.fp_id), "
    "k AS (SELECT id, count(*) FILTER (has_data) AS k FROM a GROUP BY id) "
    "SELECT a.id, fp_id, has_data, k >= 2 AS hybrid_possible, CASE WHEN k > 0 THEN '' WHEN e.id IS NULL THEN 'not found' WHEN smiles IS NULL THEN 'id only' WHEN regexp_matches(smiles, '[|*]') THEN 'no defined structure' ELSE '' END AS reason "
    "FROM a JOIN k USING (id) LEFT JOIN entities e ON e.id = a.id",
)
def fp_availability(t: Tables):
    ids = t.customer.select((F.col("c_custkey") + 100).alias("id"))
    tall = t.word_lists.select("id", F.lit("word").alias("fp_id"), big(F.size("ds"), "n")).unionByName(
        t.labels.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).withColumn("fp_id", F.lit("label"))
    )
    return grid.fingerprint_availability(fingerprints.fingerprint_sizes(ids, tall, ["word", "label"]), t.entities, ids)


@query(
    "H23_numeric_fingerprints",
    "SELECT p_partkey AS id, p_retailprice AS price, p_size::DOUBLE AS size FROM part WHERE p_size > 10",
)
def numeric(t: Tables):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"))
    return fingerprints.numeric_fingerprints(properties.property_values([(rows, ["price", "size"])]), ["price", "size"])


POSITION = "('0x' || substr(md5(bit), 1, 8))::BIGINT % 2048"


@query("H24_hashed_fingerprints", cte("words") + f"SELECT id, string_agg('word_' || p, ' ' ORDER BY p) AS ds, count(*)::INTEGER AS n FROM (SELECT DISTINCT id, {POSITION} AS p FROM words) GROUP BY id")
def hashed(t: Tables):
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    out = fingerprints.hashed_fingerprints(texts, F.array_remove(F.split(F.lower("text"), r"[^\p{L}]+"), ""), "word")
    return out.select("id", text("ds", "ds"), "n")


@query(
    "H25_endpoint_labels",
    cte("dose_obs")
    + ", e AS (SELECT DISTINCT endpoint FROM dose_obs), l AS (SELECT p_type || ':' || p_brand AS endpoint, min(p_name) AS label FROM part WHERE p_brand <> 'Brand#7' GROUP BY ALL) "
    "SELECT e.endpoint, e.endpoint || coalesce(': ' || label, '') AS description FROM e LEFT JOIN l USING (endpoint)",
)
def labels(t: Tables):
    named = t.part.where("p_brand <> 'Brand#7'").groupBy(F.expr("p_type || ':' || p_brand").alias("endpoint")).agg(F.min("p_name").alias("label"))
    return grid.with_labels(t.dose_obs.select("endpoint").distinct(), named)


@query(
    "J01_fingerprint_registry",
    cte("words", "baskets", "ranges")
    + "SELECT 'word' AS fp_id, 'jaccard' AS metric, -1.0::DOUBLE AS cutoff, count(DISTINCT id) AS entities FROM words UNION ALL SELECT 'word_hashed', 'jaccard', 0.05, count(DISTINCT id) FROM words "
    "UNION ALL SELECT 'basket', 'jaccard', -1, count(DISTINCT id) FROM baskets UNION ALL SELECT 'range', 'jaccard', 0.005, count(DISTINCT id) FROM ranges UNION ALL SELECT 'embedding', 'euclid', -1, count(*) FROM embeddings",
)
def registry(t: Tables):
    out = None
    for spec in REGISTRY.values():
        one = spec.builder(t).agg(F.countDistinct("id").alias("entities")).select(
            F.lit(spec.fp_id).alias("fp_id"), F.lit(spec.metric).alias("metric"), F.lit(-1.0 if spec.cutoff is None else spec.cutoff).alias("cutoff"), "entities"
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "J02_hashed_block_search",
    cte("words", f"hashed AS (SELECT DISTINCT id, {POSITION} AS bit FROM words)", knn("hashed", 100)) + "SELECT id, rank, nn_id, round(similarity, 6) AS similarity FROM knn",
)
def block_search(t: Tables):
    near = neighbors.neighbor_table(t.word_bits, BITS, "word_hashed", "no_filter")
    return near.select("id", big("rank", "rank"), "nn_id", r6("similarity", "similarity"))
