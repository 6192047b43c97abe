"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions import numbers
from kinfold.functions.text import feature_name
from kinfold.operators import compare, effects, fingerprints, grid, neighbors, predict
from kinfold.operators.block_search import Part
from kinfold.plans.registry import big, query, r6, text
from kinfold.plans.tables import SALES, Tables, cte, engine, knn, members, pairs

BITS = [Part("ds")]


@query("E01_set_fingerprints", cte("baskets") + "SELECT id, string_agg(bit, ' ' ORDER BY bit) AS ds, count(*) AS n FROM baskets GROUP BY id")
def sets(t: Tables):
    return fingerprints.set_fingerprints(t.baskets).select("id", text("ds", "ds"), big("n", "n"))


@query(
    "E02_positive_and_negative_sets",
    f"SELECT o_custkey AS id, string_agg(DISTINCT CASE WHEN l_discount > 0.09 THEN p_brand END, ' ' ORDER BY CASE WHEN l_discount > 0.09 THEN p_brand END) AS pos, "
    f"count(DISTINCT CASE WHEN l_discount > 0.09 THEN p_brand END) AS n_pos, count(DISTINCT CASE WHEN l_discount <= 0.09 THEN p_brand END) AS n_neg FROM {SALES} GROUP BY o_custkey",
)
def signed(t: Tables):
    hits = t.sales.selectExpr("o_custkey AS id", "p_brand AS bit", "l_discount AS hitc")
    out = fingerprints.signed_sets(hits, F.col("hitc") > 0.09, F.col("hitc") <= 0.09)
    return out.select("id", F.nullif(F.array_join("pos", " "), F.lit("")).alias("pos"), big("n_pos", "n_pos"), big("n_neg", "n_neg"))


@query(
    "E03_fingerprints_per_source",
    "SELECT doc_id AS id, source, string_agg(DISTINCT lang, ' ' ORDER BY lang) AS ds FROM documents GROUP BY doc_id, source "
    f"UNION ALL SELECT o_custkey, o_orderpriority, string_agg(DISTINCT p_type, ' ' ORDER BY p_type) FROM {SALES} GROUP BY ALL",
)
def per_source(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("bit"))
    orders = t.sales.selectExpr("o_custkey AS id", "o_orderpriority AS source", "p_type AS bit")
    each = [fingerprints.set_fingerprints(rows, ["id", "source"]) for rows in (docs, orders)]
    return each[0].unionByName(each[1]).select("id", "source", text("ds", "ds"))


@query(
    "E04_hit_record_lists",
    "SELECT l_suppkey AS id, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY l_suppkey",
)
def records(t: Tables):
    hits = t.lineitem.select(F.col("l_suppkey").alias("id"), "l_partkey", "l_orderkey", "l_quantity", "l_tax")
    lists = fingerprints.hit_records(hits, ["l_partkey", "l_orderkey", "l_quantity", "l_tax"])
    amount = F.aggregate("hits", F.lit(0.0), lambda s, h: s + h["l_quantity"])
    return lists.groupBy("id").agg(big(F.sum(F.size("hits")), "n"), F.round(F.sum(amount), 2).alias("total"))


@query(
    "E05_disjoint_effect_sets",
    cte("effects")
    + ", b AS (SELECT DISTINCT chem_id AS id, study_type || ':' || effect_target AS fp2, study_type || ':' || effect_target || ':' || coalesce(effect_desc, 'None') AS fp1, "
    "CASE WHEN effect_critical = 1 AND level >= 4 THEN 1 ELSE 0 END AS cls FROM effects), "
    "s AS (SELECT id, 'fp1' AS fp, fp1 AS bit, max(cls) AS cls FROM b GROUP BY ALL UNION ALL SELECT id, 'fp2', fp2, max(cls) FROM b GROUP BY ALL) "
    "SELECT id, fp, count(*) FILTER (cls = 1) AS n_pos, count(*) FILTER (cls = 0) AS n_neg, min(CASE WHEN cls = 0 THEN bit END) AS first_neg FROM s GROUP BY id, fp",
)
def effect_sets(t: Tables):
    c = F.col
    rows = t.effects.select(
        c("chem_id").alias("id"),
        F.when((c("effect_critical") == 1) & (c("level") >= 4), 1).otherwise(0).alias("effect_class"),
        feature_name(c("study_type"), c("effect_target"), c("effect_desc")).alias("fp1"),
        feature_name(c("study_type"), c("effect_target")).alias("fp2"),
    )
    both = [fingerprints.effect_sets(rows, fp).withColumn("fp", F.lit(fp)) for fp in ("fp1", "fp2")]
    return both[0].unionByName(both[1]).select(
        "id", "fp", big(F.size("pos"), "n_pos"), big(F.size("neg"), "n_neg"), F.get("neg", F.lit(0)).alias("first_neg")
    )


@query(
    "E06_grouped_hits",
    "SELECT l_suppkey AS id, l_linestatus AS stype, count(*) AS hits, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_partkey END) AS n FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL",
)
def grouped(t: Tables):
    hits = t.lineitem.select(
        F.col("l_suppkey").alias("id"), F.col("l_linestatus").alias("stype"), F.col("l_discount").alias("hitcall"),
        F.col("l_returnflag").alias("approach"), F.col("l_partkey").alias("endpoint"), "l_orderkey", "l_quantity",
    )
    out = fingerprints.grouped_hits(hits, ["id", "stype"], 0.05, "A", ["endpoint", "l_orderkey", "l_quantity"])
    return out.groupBy("id", "stype", "n").agg(big(F.sum(F.size("hits")), "hits")).select("id", "stype", "hits", big("n", "n"))


@query(
    "E07_median_top_features",
    f"WITH m AS (SELECT o_custkey AS id, o_orderpriority AS cell_type, p_brand AS endpoint, abs(median(round(l_discount * 100) - 5)) AS top, median(l_quantity) AS bmd FROM {SALES} GROUP BY ALL), "
    "c AS (SELECT unnest([10.0, 30.0]) AS cutoff), r AS (SELECT *, row_number() OVER (PARTITION BY id, cell_type, cutoff ORDER BY top DESC, endpoint) AS r FROM m, c WHERE bmd <= cutoff), "
    "s AS (SELECT unnest([2, 4]) AS size) SELECT id, cell_type, size, cutoff::DOUBLE AS cutoff, string_agg(endpoint, ' ' ORDER BY r) AS ds, count(*) AS n FROM r, s WHERE r <= size GROUP BY ALL",
)
def medians(t: Tables):
    hits = t.sales.selectExpr("o_custkey AS id", "o_orderpriority AS cell_type", "p_brand AS endpoint", "round(l_discount * 100) - 5 AS top", "l_quantity AS bmd")
    out = fingerprints.top_features(hits, [2, 4], [10, 30])
    return out.select("id", "cell_type", "size", "cutoff", text("ds", "ds"), big("n", "n"))


CLASSES = (
    "SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'Unknown  MoA' WHEN p_size % 10 <> 1 THEN p_type || ' ' || p_brand END AS moa, p_name AS structure, p_brand AS pesticide FROM part"
)


@query(
    "E08_class_label_fingerprints",
    f"WITH c AS ({CLASSES}), b AS (SELECT id, CASE WHEN moa = 'Unknown  MoA' THEN 'mc_Unknown_MoA_' || id ELSE 'mc_' || replace(moa, ' ', '_') END AS bit FROM c "
    "UNION SELECT id, 'sc_' || replace(structure, ' ', '_') FROM c UNION SELECT id, 'pc_' || pesticide FROM c) SELECT id, string_agg(bit, ' ' ORDER BY bit) AS ds, count(bit) AS n FROM b GROUP BY id",
)
def classes(t: Tables):
    rows = t.part.selectExpr(
        "p_partkey AS id", "CASE WHEN p_size % 10 = 0 THEN 'Unknown  MoA' WHEN p_size % 10 <> 1 THEN p_type || ' ' || p_brand END AS moa",
        "p_name AS structure", "p_brand AS pesticide",
    )
    bits = fingerprints.class_bits(rows, {"mc_": "moa", "sc_": "structure", "pc_": "pesticide"})
    return fingerprints.set_fingerprints(bits).select("id", text("ds", "ds"), big("n", "n"))


POD_SQL = (
    cte("effects")
    + ", f AS (SELECT *, CASE unit WHEN 'mg/kg/day' THEN dose WHEN 'mg/kg/wk' THEN dose * (1.0::DOUBLE / 7) END AS d FROM effects), "
    "s AS (SELECT chem_id, study_id, study_type, species, min(CASE WHEN effect_trt_related = 1 THEN d END) AS lel, min(CASE WHEN effect_trt_related = 1 THEN level END) AS dl, "
    "min(CASE WHEN effect_critical = 1 THEN d END) AS loael, min(CASE WHEN effect_critical = 1 THEN level END) AS dc FROM f GROUP BY ALL), "
    "l AS (SELECT chem_id, study_id, study_type, species, level, min(d) AS d FROM f GROUP BY ALL), "
    "p AS (SELECT s.*, a.d AS nel, b.d AS noael FROM s LEFT JOIN l a ON a.chem_id = s.chem_id AND a.study_id = s.study_id AND a.study_type = s.study_type AND a.species = s.species AND a.level = s.dl - 1 AND s.dl > 1 "
    "LEFT JOIN l b ON b.chem_id = s.chem_id AND b.study_id = s.study_id AND b.study_type = s.study_type AND b.species = s.species AND b.level = s.dc - 1 AND s.dc > 1) "
    "SELECT chem_id, study_id, study_type, species, round(any_value(lel), 6) AS lel, round(any_value(nel), 6) AS nel, round(any_value(loael), 6) AS loael, round(any_value(noael), 6) AS noael, "
    "count(*) FILTER (d = nel AND effect_trt_related = 0 AND level > 0) AS nel_rows, count(*) FILTER (d = lel AND effect_trt_related = {lel} AND level > 0) AS lel_rows, "
    "count(*) FILTER (d = noael AND effect_critical = 0 AND level > 0) AS noael_rows, count(*) FILTER (d = loael AND effect_critical = 1 AND level > 0) AS loael_rows "
    "FROM f JOIN p USING (chem_id, study_id, study_type, species) GROUP BY ALL"
)


def departures(t: Tables, compat: bool):
    rows = effects.points_of_departure(t.effects, compat)
    return rows.groupBy(*effects.STUDY).agg(
        *(F.round(F.max(c), 6).alias(c) for c in ("lel", "nel", "loael", "noael")),
        *(F.count_if(F.col(f"is_{c}")).alias(f"{c}_rows") for c in ("nel", "lel", "noael", "loael")),
    )


@query("E09_points_of_departure", POD_SQL.replace("{lel}", "1"))
def pods(t: Tables):
    return departures(t, False)


@query("E09_points_of_departure_older_rule", POD_SQL.replace("{lel}", "0"))
def pods_compat(t: Tables):
    return departures(t, True)


@query("E10_bit_vocabulary", cte("words") + "SELECT DISTINCT bit FROM words")
def vocabulary(t: Tables):
    return fingerprints.vocabulary(t.words)


BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query(
    "E11_feature_matrix",
    "SELECT l_suppkey AS id, " + ", ".join(f"max(CASE WHEN p_brand = '{b}' THEN 1 ELSE 0 END) AS b{i}" for i, b in enumerate(BRANDS))
    + " FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey",
)
def matrix(t: Tables):
    sold = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    wide = fingerprints.feature_matrix(sold.select(F.col("l_suppkey").alias("id"), F.col("p_brand").alias("bit")), BRANDS)
    return wide.toDF("id", *(f"b{i}" for i in range(len(BRANDS))))


MIN_DOSE = "SELECT id, endpoint, dose, unit FROM dose_obs WHERE dose > 0 QUALIFY row_number() OVER (PARTITION BY id, endpoint ORDER BY dose, unit) = 1"


@query("E12_minimum_positive_dose", cte("dose_obs") + MIN_DOSE)
def min_dose(t: Tables):
    return predict.minimum_doses(t.dose_obs)


@query(
    "E13_fingerprint_sizes",
    cte("words", "baskets")
    + ", ids AS (SELECT doc_id AS id FROM documents UNION SELECT c_custkey FROM customer), s AS (SELECT id, 'word' AS fp_id, count(*) AS n FROM words GROUP BY id "
    "UNION ALL SELECT id, 'basket', count(*) FROM baskets GROUP BY id UNION ALL SELECT doc_id, 'label', quality FROM labels UNION ALL SELECT doc_id, 'label', 1 - quality FROM labels) "
    "SELECT ids.id, f.fp_id, coalesce(sum(n), 0)::BIGINT AS n FROM ids CROSS JOIN (VALUES ('word'), ('basket'), ('label')) f(fp_id) LEFT JOIN s ON s.id = ids.id AND s.fp_id = f.fp_id GROUP BY ALL",
)
def sizes(t: Tables):
    n = lambda df, fp, n: df.select("id", F.lit(fp).alias("fp_id"), big(n, "n"))
    labels = t.labels.withColumnRenamed("doc_id", "id")
    tall = n(t.word_lists, "word", F.size("ds")).unionByName(n(t.basket_sets, "basket", F.size("ds")))
    tall = tall.unionByName(n(labels, "label", F.col("quality"))).unionByName(n(labels, "label", 1 - F.col("quality")))
    ids = t.documents.select(F.col("doc_id").alias("id")).union(t.customer.select("c_custkey"))
    return fingerprints.fingerprint_sizes(ids, tall, ["word", "basket", "label"])


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "E14_summary_pivot",
    "WITH c AS (SELECT user_id AS id, event_type AS prop, count(*) AS n FROM events GROUP BY ALL), ids AS (SELECT DISTINCT o_custkey AS id FROM orders UNION SELECT id FROM c) "
    "SELECT ids.id, " + ", ".join(f"coalesce(min(CASE WHEN prop = '{p}' THEN n END), 0) AS {p}" for p in EVENT_TYPES) + " FROM ids LEFT JOIN c USING (id) GROUP BY ids.id",
)
def summary(t: Tables):
    counts = t.events.groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("prop")).agg(F.count(F.lit(1)).alias("n"))
    return fingerprints.summary_pivot(counts, EVENT_TYPES, t.orders.select(F.col("o_custkey").alias("id")))


@query(
    "E15_inverted_index",
    cte("words") + "SELECT bit, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM words GROUP BY bit",
)
def index(t: Tables):
    lists = fingerprints.inverted_index(t.words)
    return lists.groupBy("bit").agg(
        big(F.sum(F.size("ids")), "n"), F.min(F.array_min("ids")).alias("first_id"), F.max(F.array_max("ids")).alias("last_id")
    )


@query("E15_bit_frequency", cte("words") + "SELECT bit, count(*) AS df FROM words GROUP BY bit")
def frequency(t: Tables):
    return fingerprints.bit_frequency(t.words)


@query(
    "E16_neighbour_table_coverage",
    cte("baskets", "ranges", "returners", knn("baskets", 5, name="bo"), knn("baskets", 5, "returners", "bf"), knn("ranges", 5, "returners", "rf"))
    + "SELECT 'basket' AS fp_id, (SELECT count(DISTINCT id) FROM bo) AS open_present, (SELECT count(DISTINCT id) FROM bo) AS open_populated, (SELECT count(DISTINCT id) FROM bf) AS kept_present, (SELECT count(DISTINCT id) FROM bf) AS kept_populated "
    "UNION ALL SELECT 'range', 0, 0, count(DISTINCT id), count(DISTINCT id) FROM rf",
)
def coverage(t: Tables):
    table = neighbors.neighbor_table(t.basket_sets, BITS, "basket", "no_filter", k=5)
    table = table.unionByName(neighbors.neighbor_table(t.basket_sets, BITS, "basket", "returners", t.returners, k=5))
    table = table.unionByName(neighbors.neighbor_table(t.range_sets, BITS, "range", "returners", t.returners, k=5))
    renamed = {"no_filter": "open", "returners": "kept"}
    wide = neighbors.coverage(compare.rename_filters(table, renamed), ["open", "kept"])
    return wide.select("fp_id", *(big(c, c) for c in wide.columns[1:]))


@query(
    "E17_mean_similarity_of_first_neighbours",
    cte("baskets", "ranges", knn("baskets", 15, name="b"), knn("ranges", 15, name="r"))
    + "SELECT fp_id, round(avg(similarity), 6) AS mean_similarity FROM (SELECT 'basket' AS fp_id, similarity FROM b UNION ALL SELECT 'range', similarity FROM r) GROUP BY fp_id",
)
def mean_similarity(t: Tables):
    tables = [neighbors.neighbor_table(s, BITS, fp, "no_filter", k=20) for fp, s in (("basket", t.basket_sets), ("range", t.range_sets))]
    return neighbors.mean_similarity(tables[0].unionByName(tables[1])).select("fp_id", r6("mean_similarity", "mean_similarity"))


@query(
    "E18_neighbour_count_and_maximum",
    cte("words", "labelled", knn("words", 10, "labelled")) + "SELECT id, 'word' AS fp_id, 'labelled' AS sel_by, count(*) AS n, round(max(similarity), 6) AS max_s0 FROM knn GROUP BY id",
)
def stats(t: Tables):
    table = neighbors.neighbor_table(t.word_lists, BITS, "word", "labelled", t.labelled, k=10)
    return neighbors.neighbor_stats(table).select("id", "fp_id", "sel_by", "n", r6("max_s0", "max_s0"))


@query(
    "E19_range_by_label_prefix",
    cte("dose_obs", f"m AS ({MIN_DOSE})")
    + ", v AS (SELECT split_part(endpoint, ':', 1) AS prefix, log10(dose * CASE unit WHEN 'mg/kg/wk' THEN 1.0::DOUBLE / 7 ELSE 1 END / c_acctbal) AS x FROM m JOIN customer ON c_custkey = id WHERE c_acctbal > 0) "
    "SELECT prefix, round(min(x) - CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END, 6) AS range_min, round(max(x) + CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END, 6) AS range_max FROM v GROUP BY prefix",
)
def ranges(t: Tables):
    return effects.prefix_ranges(norm_doses(t), "endpoint", "norm_dose", []).select(
        "prefix", r6("range_min", "range_min"), r6("range_max", "range_max")
    )


def norm_doses(t: Tables):
    """(id, endpoint, norm_dose): log molar dose of the smallest positive dose."""
    weights = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("mol_weight"))
    norm = numbers.log_molar(numbers.normalised_dose(F.col("dose"), F.col("unit")), F.col("mol_weight"))
    return predict.minimum_doses(t.dose_obs).join(weights, "id").select("id", "endpoint", norm.alias("norm_dose"))


GRID = (
    "cells AS (SELECT id, endpoint, max(obs) AS obs FROM dose_obs GROUP BY id, endpoint), seen AS (SELECT DISTINCT target, endpoint FROM members JOIN cells USING (id)), "
    "grid AS (SELECT s.target, s.endpoint, m.id, CASE WHEN obs IS NULL THEN 'no_data' WHEN obs = 0 THEN 'no_effect' ELSE 'pos_effect' END AS value "
    "FROM seen s JOIN members m USING (target) LEFT JOIN cells c ON c.id = m.id AND c.endpoint = s.endpoint)"
)


def basket_near(t: Tables):
    """Neighbourhoods of customers, searched once for all that reads them."""
    if "near" not in t.__dict__:
        t.near = neighbors.nearest(t.basket_sets, t.basket_sets, BITS, 4, holders=t.returners)
    return t.near


def basket_grid(t: Tables):
    return grid.read_across_grid(basket_near(t), t.dose_obs)


#: SQL of ``basket_classes``.
BASKET_CLASSES = ", ".join([members("baskets", 4, "returners"), pairs("baskets"), engine("members", "dose_obs", "pairs", "4", 0.0, "basket")])


def basket_classes(t: Tables):
    """Classes of customers by the engine with ROC curves and permutation tests."""
    return rounded(predict.read_across(basket_near(t), t.basket_sets, BITS, t.dose_obs, "basket", 4, 0.0))


def rounded(out):
    """Predictions as they are compared."""
    return out.withColumns({"a_t": F.col("a_t").cast("double"), "auc": F.round("auc", 6), "t0": F.round("t0", 6)})


@query(
    "E20_observation_counts",
    cte("baskets", "returners", members("baskets", 4, "returners"), "dose_obs", GRID)
    + "SELECT target, endpoint, count(*) FILTER (value = 'pos_effect') AS pos_obs, count(*) FILTER (value = 'no_effect') AS neg_obs, count(*) FILTER (value <> 'no_data') AS all_obs FROM grid GROUP BY ALL",
)
def observation_counts(t: Tables):
    return grid.observation_counts(basket_grid(t), ["target", "endpoint"])


@query(
    "E21_label_value_counts",
    cte("baskets", "returners", members("baskets", 4, "returners"), "dose_obs", GRID)
    + "SELECT endpoint, count(*) FILTER (value = 'pos_effect') AS pos_effect, count(*) FILTER (value = 'no_effect') AS no_effect, count(*) FILTER (value = 'no_data') AS no_data FROM grid GROUP BY endpoint",
)
def class_counts(t: Tables):
    return grid.class_counts(basket_grid(t))


FITS = (
    "SELECT l_orderkey AS sample_id, l_linenumber AS aeid, max(CASE WHEN l_tax > 0.02 THEN l_tax END) AS hill_aic, max(CASE WHEN l_tax > 0.02 THEN l_quantity END) AS hill_tp, "
    "max(l_discount) AS gnls_aic, max(l_extendedprice) AS gnls_tp FROM lineitem GROUP BY ALL"
)


@query(
    "E22_result_documents",
    f"WITH f AS ({FITS}), p AS (SELECT l_orderkey AS sample_id, l_linenumber AS aeid, count(DISTINCT (l_quantity, l_extendedprice)) AS n_points, string_agg(DISTINCT l_returnflag, ' ' ORDER BY l_returnflag) AS flags "
    "FROM lineitem GROUP BY ALL) SELECT sample_id, aeid, (CASE WHEN hill_aic IS NULL THEN 1 ELSE 2 END)::BIGINT AS n_models, CASE WHEN hill_aic < gnls_aic THEN 'hill' ELSE 'gnls' END AS best, n_points, flags FROM f JOIN p USING (sample_id, aeid)",
)
def documents(t: Tables):
    key = [F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("aeid")]
    taxed = lambda c: F.max(F.when(F.col("l_tax") > 0.02, F.col(c)))
    fits = t.lineitem.groupBy(*key).agg(
        taxed("l_tax").alias("hill_aic"), taxed("l_quantity").alias("hill_tp"), F.max("l_discount").alias("gnls_aic"), F.max("l_extendedprice").alias("gnls_tp")
    )
    points = t.lineitem.select(*key, F.col("l_quantity").alias("conc"), F.col("l_extendedprice").alias("resp"))
    flags = t.lineitem.select(*key, F.col("l_returnflag").alias("flag"))
    docs = effects.result_documents(fits, points, flags, ["gnls", "hill"])
    return docs.select("sample_id", "aeid", big(F.size("fits"), "n_models"), "best", big(F.size("points"), "n_points"), text("flags", "flags"))


@query(
    "E23_prediction_audit",
    cte("baskets", "returners", "dose_obs", BASKET_CLASSES)
    + ", c AS (SELECT endpoint AS out, count(*) FILTER (obs = 1) AS p, count(*) FILTER (obs = 0) AS n FROM dose_obs GROUP BY endpoint) "
    "SELECT split_part(out, ':', 1) AS study, round(avg((auc = 0)::INTEGER), 6) AS share_zero_auc, sum(p + n)::BIGINT AS observations, count(*) AS n FROM engine JOIN c USING (out) GROUP BY study",
)
def audit(t: Tables):
    counts = t.dose_obs.groupBy("endpoint").agg(F.count_if(F.col("obs") == 1).alias("pos_obs"), F.count_if(F.col("obs") == 0).alias("neg_obs"))
    return predict.audit(basket_classes(t), counts).select("study", r6("share_zero_auc", "share_zero_auc"), "observations", "n")


@query(
    "E24_mean_set_sizes",
    "WITH p AS (SELECT l_suppkey AS id, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS hit, l_linestatus AS modl, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL) "
    "SELECT hit, modl, round(avg(n), 6) AS mean_n, count(*) AS entities FROM p GROUP BY ALL",
)
def mean_sizes(t: Tables):
    hits = t.lineitem.select(
        F.col("l_suppkey").alias("id"), F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("hit"), F.col("l_linestatus").alias("modl"), F.col("l_partkey").alias("bit")
    )
    return fingerprints.mean_set_sizes(hits).select("hit", "modl", r6("mean_n", "mean_n"), "entities")


@query(
    "E25_duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicates(t: Tables):
    return compare.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "E25_without_exact_duplicates",
    "SELECT lang, source, count(*) AS n FROM (SELECT DISTINCT lang, source, text FROM documents) GROUP BY ALL",
)
def distinct_rows(t: Tables):
    return t.documents.dropDuplicates(["lang", "source", "text"]).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "E26_status_census",
    "SELECT unnest(['short', 'english', 'unaccounted', 'total']) AS status, unnest([count(*) FILTER (n_chars < 500), count(*) FILTER (lang = 'en'), count(*) FILTER (n_chars >= 500 AND lang <> 'en'), count(*)]) AS n FROM documents",
)
def census(t: Tables):
    return compare.census(t.documents, {"short": F.col("n_chars") < 500, "english": F.col("lang") == "en"})


@query("E26_failing_rows", "SELECT doc_id FROM documents WHERE n_chars >= 500 AND lang <> 'en'")
def failing(t: Tables):
    return compare.failing_rows(t.documents, {"short": F.col("n_chars") < 500, "english": F.col("lang") == "en"}).select("doc_id")
