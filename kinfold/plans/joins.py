"""Queries of joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import effects, fingerprints, ids, neighbors, properties, similarity
from kinfold.operators.block_search import Part, top_matches
from kinfold.plans.registry import big, query, r6
from kinfold.plans.tables import SALES, Tables, cte, knn, members

DIMS = 64


def scaled_embeddings(t: Tables):
    """(id, v): embeddings with every dimension scaled over the population."""
    columns = [f"x{i}" for i in range(DIMS)]
    wide = t.embeddings.select(
        F.col("vec_id").alias("id"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns))
    )
    return properties.population_scaled(wide, columns).select("id", F.array(*columns).alias("v")).persist()


SCALED = (
    "flat AS (SELECT vec_id AS id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)), "
    "span AS (SELECT i, min(x) AS lo, max(x) AS hi FROM flat GROUP BY i), "
    "scaled AS (SELECT id, list(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END ORDER BY i) AS v FROM flat JOIN span USING (i) GROUP BY id)"
)


def vector_knn(score: str, source: str, k: int) -> str:
    return (
        f"pairs AS (SELECT a.id, b.id AS nn_id, {score} AS similarity FROM {source} a JOIN {source} b ON a.id <> b.id), "
        f"near AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, nn_id) AS rank, nn_id, similarity FROM pairs WHERE similarity > 0 QUALIFY rank <= {k}) "
        "SELECT id, rank, nn_id, round(similarity, 6) AS similarity FROM near"
    )


@query(
    "D01_set_similarity_join",
    cte("words")
    + ", n AS (SELECT id, count(*) AS n FROM words GROUP BY id), o AS (SELECT a.id, b.id AS nn_id, count(*) AS overlap FROM words a JOIN words b ON a.bit = b.bit GROUP BY a.id, b.id) "
    "SELECT o.id, nn_id, overlap, round(overlap::DOUBLE / (x.n + y.n - overlap), 6) AS similarity FROM o JOIN n x ON x.id = o.id JOIN n y ON y.id = nn_id "
    "WHERE overlap::DOUBLE / (x.n + y.n - overlap) >= 0.5",
)
def set_join(t: Tables):
    pairs = similarity.set_similarity_join(t.word_lists, t.word_lists, 0.5)
    return pairs.select("id", "nn_id", big("overlap", "overlap"), r6("similarity", "similarity"))


@query(
    "D01_similarity_classes",
    cte("words")
    + ", sets AS (SELECT id, count(*) AS n, list(bit ORDER BY bit) AS ds FROM words GROUP BY id), reps AS (SELECT min(id) AS rep, n, ds, count(*) AS copies FROM sets GROUP BY n, ds), "
    "rw AS (SELECT rep, n, copies, unnest(ds) AS bit FROM reps), "
    "o AS (SELECT a.rep, b.rep AS other, any_value(a.n) AS n, any_value(b.n) AS m, any_value(a.copies) AS copies, any_value(b.copies) AS other_copies, count(*) AS overlap FROM rw a JOIN rw b ON a.bit = b.bit AND a.rep < b.rep GROUP BY ALL) "
    "SELECT rep, other, overlap, round(overlap::DOUBLE / (n + m - overlap), 6) AS similarity, copies, other_copies FROM o WHERE overlap::DOUBLE / (n + m - overlap) >= 0.5",
)
def set_classes(t: Tables):
    found = similarity.similar_sets(t.word_lists, t.word_lists, 0.5)
    copies = found.targets.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    return (
        found.pairs.join(copies.withColumnRenamed("rep", "t"), "t")
        .join(copies.select(F.col("rep").alias("c"), F.col("copies").alias("other_copies")), "c")
        .select(F.col("t").alias("rep"), F.col("c").alias("other"), big("overlap", "overlap"), r6("similarity", "similarity"), "copies", "other_copies")
    )


@query("D02_vector_distance_join", "WITH " + SCALED + ", " + vector_knn("1 - list_distance(a.v, b.v) / sqrt(64)", "scaled", 5))
def vector_join(t: Tables):
    vectors = scaled_embeddings(t)
    near = top_matches(vectors, vectors, [Part("v", "euclid")], 5)
    return near.select("id", big("rank", "rank"), "nn_id", r6("similarity", "similarity"))


@query(
    "D03_hits_with_catalogue",
    "SELECT p_brand, p_type, modl, count(*) AS n FROM (SELECT l_partkey, CASE WHEN l_tax > 0 THEN l_linestatus END AS modl FROM lineitem) JOIN part ON p_partkey = l_partkey "
    "WHERE modl IS NOT NULL GROUP BY ALL",
)
def catalogue_hits(t: Tables):
    results = t.lineitem.select(F.col("l_partkey").alias("aeid"), F.when(F.col("l_tax") > 0, F.col("l_linestatus")).alias("modl"))
    assays = t.part.select(F.col("p_partkey").alias("aeid"), "p_brand", "p_type")
    return effects.hits_with_catalogue(results, assays).groupBy("p_brand", "p_type", "modl").agg(F.count(F.lit(1)).alias("n"))


@query(
    "D04_study_effect_assembly",
    f"SELECT DISTINCT r_name, n_name, c_mktsegment, o_orderstatus, o_orderpriority, l_returnflag, l_linenumber, p_brand, p_type FROM {SALES} "
    "JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN supplier ON s_suppkey = l_suppkey",
)
def study_effects(t: Tables):
    chain = [
        (t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"]),
        (t.part.withColumnRenamed("p_partkey", "l_partkey"), ["l_partkey"]),
        (t.supplier.select(F.col("s_suppkey").alias("l_suppkey")), ["l_suppkey"]),
        (t.customer.withColumnsRenamed({"c_custkey": "o_custkey", "c_nationkey": "n_nationkey"}), ["o_custkey"]),
        (t.nation.withColumnRenamed("n_regionkey", "r_regionkey"), ["n_nationkey"]),
        (t.region, ["r_regionkey"]),
    ]
    columns = "r_name n_name c_mktsegment o_orderstatus o_orderpriority l_returnflag l_linenumber p_brand p_type".split()
    return effects.join_chain(t.lineitem, chain, columns)


@query(
    "D05_guideline_assembly",
    "SELECT DISTINCT n_name AS guideline, c_mktsegment AS profile, s_suppkey AS endpoint FROM nation JOIN customer ON c_nationkey = n_nationkey "
    "JOIN supplier ON s_nationkey = n_nationkey",
)
def guideline(t: Tables):
    profiles = t.customer.select("c_nationkey", F.col("c_mktsegment").alias("profile")).distinct()
    chain = [
        (profiles.withColumnRenamed("c_nationkey", "n_nationkey"), ["n_nationkey"]),
        (t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").alias("endpoint")), ["n_nationkey"]),
    ]
    return effects.join_chain(t.nation.withColumnRenamed("n_name", "guideline"), chain, ["guideline", "profile", "endpoint"])


SOLD = "(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)"


@query(
    "D06_assay_catalogue_assembly",
    f"SELECT l_suppkey AS aid, l_partkey AS acid, p_name, s_name AS gene FROM {SOLD} JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 5000 "
    f"UNION ALL SELECT l_suppkey, l_partkey, p_name, NULL FROM {SOLD} JOIN part ON p_partkey = l_partkey WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)",
)
def catalogue(t: Tables):
    assays = t.lineitem.select(F.col("l_suppkey").alias("aid"), F.col("l_partkey").alias("acid")).distinct()
    components = t.supplier.select(F.col("s_suppkey").alias("aid"), F.col("s_suppkey").alias("aeid"))
    endpoints = t.part.select(F.col("p_partkey").alias("acid"), "p_name")
    genes = t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("aeid"), F.col("s_name").alias("gene"))
    return effects.assay_catalogue(assays, components, endpoints, genes).select("aid", "acid", "p_name", "gene")


@query(
    "D07_assay_result_assembly",
    "SELECT c_mktsegment, modl, hit, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM (SELECT *, CASE WHEN l_tax = 0 THEN 'cnst' WHEN l_tax < 0.05 THEN 'hill' ELSE 'gnls' END AS modl, "
    "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS hit FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey) WHERE modl <> 'cnst' GROUP BY ALL",
)
def results(t: Tables):
    model = F.when(F.col("l_tax") == 0, "cnst").when(F.col("l_tax") < 0.05, "hill").otherwise("gnls")
    fits = t.lineitem.select(F.col("l_orderkey").alias("fit_id"), "l_extendedprice", model.alias("modl"))
    hits = t.orders.select(F.col("o_orderkey").alias("fit_id"), F.col("o_orderkey").alias("sample_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("hit"))
    samples = t.orders.select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("id"))
    customers = t.customer.select(F.col("c_custkey").alias("id"), "c_mktsegment")
    out = effects.assay_results(fits, samples, customers, hits, drop_constant=True)
    return out.groupBy("c_mktsegment", "modl", "hit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


EFFECT = "effect_target, effect_desc"
REQUIRED = "required AS (SELECT DISTINCT p_size % 12 AS study_guideline_id, p_brand AS effect_target, CASE WHEN p_size % 9 <> 0 THEN p_name END AS effect_desc FROM part)"
REPORTED = "reported AS (SELECT * FROM effects WHERE study_guideline_id IS NOT NULL AND effect_critical = 1)"


def required(t: Tables):
    return t.part.selectExpr(
        "p_size % 12 AS study_guideline_id", "p_brand AS effect_target", "CASE WHEN p_size % 9 <> 0 THEN p_name END AS effect_desc"
    ).distinct()


@query(
    "D08_required_but_unreported",
    cte("effects", REQUIRED, REPORTED)
    + "SELECT * FROM required r WHERE NOT EXISTS (SELECT 1 FROM reported e WHERE e.study_guideline_id = r.study_guideline_id "
    "AND e.effect_target = r.effect_target AND e.effect_desc IS NOT DISTINCT FROM r.effect_desc)",
)
def unreported(t: Tables):
    reported = effects.select_effects(t.effects, critical=1)
    return effects.unreported(required(t), reported, ["study_guideline_id", "effect_target", "effect_desc"])


@query(
    "D09_negative_effect_rows",
    cte("effects", REQUIRED, REPORTED)
    + ", missing AS (SELECT * FROM required r WHERE NOT EXISTS (SELECT 1 FROM reported e WHERE e.study_guideline_id = r.study_guideline_id "
    "AND e.effect_target = r.effect_target AND e.effect_desc IS NOT DISTINCT FROM r.effect_desc)), "
    "unrelated AS (SELECT * FROM effects WHERE study_guideline_id IS NOT NULL AND effect_critical = 0), "
    "studies AS (SELECT DISTINCT study_guideline_id, study_type, species FROM reported), "
    f"neg AS (SELECT study_guideline_id, study_type, species, {EFFECT} FROM studies FULL JOIN missing USING (study_guideline_id)), "
    f"every AS (SELECT study_guideline_id, study_type, species, {EFFECT}, 1 AS effect_class FROM reported UNION ALL SELECT study_guideline_id, study_type, species, {EFFECT}, 0 FROM unrelated "
    f"UNION ALL SELECT study_guideline_id, study_type, species, {EFFECT}, 0 FROM neg) "
    "SELECT study_guideline_id, study_type, species, effect_target, effect_class, count(*) AS n, count(effect_desc) AS named FROM every GROUP BY ALL",
)
def negative_rows(t: Tables):
    positive, negative = effects.select_effects(t.effects, critical=1), effects.select_effects(t.effects, critical=0)
    keys = ["study_guideline_id", "effect_target", "effect_desc"]
    reported, missing = effects.split_required(required(t), positive, keys)
    rows = effects.classified_effects(reported, negative, missing, ["study_type", "species"])
    return rows.groupBy("study_guideline_id", "study_type", "species", "effect_target", "effect_class").agg(
        F.count(F.lit(1)).alias("n"), F.count("effect_desc").alias("named")
    )


@query(
    "D10_blended_neighbour_lists",
    cte("baskets", "ranges", "returners", knn("baskets", 20, "returners", "b"), knn("ranges", 20, "returners", "r"))
    + "SELECT id, nn_id, round(sum(w * similarity) / 4, 8) AS similarity FROM (SELECT id, nn_id, round(similarity, 10) AS similarity, 3 AS w FROM b UNION ALL SELECT id, nn_id, round(similarity, 10), 1 FROM r) GROUP BY id, nn_id",
)
def blended(t: Tables):
    lists = None
    for name, bits in (("basket", t.basket_sets), ("range", t.range_sets)):
        one = neighbors.neighbor_table(bits, [Part("ds")], name, "returners", t.returners, k=20)
        lists = one if lists is None else lists.unionByName(one)
    return neighbors.blend_lists(lists, {"basket": 3, "range": 1}).select("id", "nn_id", F.round("similarity", 8).alias("similarity"))


@query(
    "D11_first_match_lookup",
    "SELECT o_orderkey, o_totalprice, l_linenumber::DOUBLE AS line, l_partkey::DOUBLE AS part FROM orders LEFT JOIN "
    "(SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1) ON l_orderkey = o_orderkey",
)
def first_match(t: Tables):
    lookup = t.lineitem.select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("double").alias("line"), F.col("l_partkey").cast("double").alias("part")
    )
    return effects.first_match(t.orders.select("o_orderkey", "o_totalprice"), lookup, "o_orderkey", ["line", "part"])


STALE = (
    "SELECT o_orderkey AS row_id, CASE WHEN o_custkey % 4 <> 0 THEN 'DTXSID' || o_custkey END AS sid, "
    "CASE WHEN o_custkey % 6 <> 0 THEN 'DTXCID' || o_custkey END AS cid, 'old name' AS name, CAST(NULL AS DOUBLE) AS mol_weight FROM orders"
)


def stale(t: Tables):
    return t.orders.selectExpr(
        "o_orderkey AS row_id", "CASE WHEN o_custkey % 4 <> 0 THEN 'DTXSID' || o_custkey END AS sid",
        "CASE WHEN o_custkey % 6 <> 0 THEN 'DTXCID' || o_custkey END AS cid", "'old name' AS name", "CAST(NULL AS DOUBLE) AS mol_weight",
    )


@query(
    "D12_metadata_refresh",
    cte("entities", f"stale AS ({STALE})")
    + ", by_sid AS (SELECT s.row_id, s.sid, coalesce(e.cid, s.cid) AS cid, coalesce(e.name, s.name) AS name, coalesce(e.mol_weight, s.mol_weight) AS mol_weight "
    "FROM stale s LEFT JOIN entities e ON e.sid = s.sid) "
    "SELECT s.row_id, coalesce(e.sid, s.sid) AS sid, s.cid, coalesce(e.name, s.name) AS name, coalesce(e.mol_weight, s.mol_weight) AS mol_weight FROM by_sid s LEFT JOIN entities e ON e.cid = s.cid",
)
def refresh(t: Tables):
    return ids.refresh_metadata(stale(t), t.entities, ["name", "mol_weight"])


@query(
    "D13_id_unification",
    cte("entities", f"stale AS ({STALE})")
    + ", a AS (SELECT s.row_id, s.sid, coalesce(s.cid, e.cid) AS cid, s.name FROM stale s LEFT JOIN entities e ON e.sid = s.sid), "
    "b AS (SELECT a.row_id, coalesce(a.sid, e.sid) AS sid, a.cid, a.name FROM a LEFT JOIN entities e ON e.cid = a.cid) "
    "SELECT b.row_id, b.sid, b.cid, coalesce(p.name, s.name, c.name, b.name) AS name FROM b LEFT JOIN entities p ON p.sid = b.sid AND p.cid = b.cid "
    "LEFT JOIN entities s ON s.sid = b.sid LEFT JOIN entities c ON c.cid = b.cid",
)
def unify(t: Tables):
    return ids.unify_ids(stale(t).drop("mol_weight"), t.entities)


@query("D14_missing_work", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing(t: Tables):
    return fingerprints.missing_ids(t.documents.select(F.col("doc_id").alias("id")), t.labelled)


@query(
    "D15_candidates_in_every_table",
    "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 1000 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') "
    "AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def every(t: Tables):
    base = t.customer.where("c_acctbal > 1000").select(F.col("c_custkey").alias("id"))
    buyers = lambda where: t.orders.where(where).select(F.col("o_custkey").alias("id"))
    return fingerprints.in_every_table(base, buyers("o_orderstatus = 'P'"), buyers("o_orderpriority = '1-URGENT'"))


@query(
    "D16_facts_of_a_neighbourhood",
    cte("baskets", "returners", members("baskets", 4, "returners"))
    + ", meta AS (SELECT DISTINCT lower(p_brand || ':' || p_type) AS feature, p_type = 'PROMO' AS background FROM part) "
    "SELECT target, m.id, rank, bit FROM members m JOIN baskets b ON b.id = m.id JOIN meta ON feature = lower(bit) WHERE NOT background",
)
def facts(t: Tables):
    sets = t.basket_sets
    near = neighbors.nearest(sets, sets, [Part("ds")], 4, holders=t.returners)
    meta = t.part.selectExpr("p_brand || ':' || p_type AS feature", "p_type = 'PROMO' AS background").distinct()
    return neighbors.neighbourhood_facts(near, sets, meta).select("target", "id", big("rank", "rank"), "bit")


@query(
    "D17_stacked_fingerprints",
    cte("baskets", "ranges")
    + "SELECT fp_id, id, count(*) AS n FROM (SELECT 'basket' AS fp_id, id, bit FROM baskets UNION ALL SELECT 'range', id, bit FROM ranges) GROUP BY ALL",
)
def stacked(t: Tables):
    return fingerprints.stacked_bits({"basket": t.baskets, "range": t.ranges}).groupBy("fp_id", "id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "D18_property_lookup",
    "SELECT p_partkey AS id, 'p_retailprice' AS prop_id, p_retailprice AS value FROM part WHERE p_size > 10 UNION ALL SELECT p_partkey, 'p_size', p_size::DOUBLE FROM part "
    "UNION ALL SELECT p.p_partkey, 'p_retailprice', c_acctbal FROM part p JOIN customer ON c_custkey = p.p_partkey WHERE p.p_size <= 10 "
    "UNION ALL SELECT c_custkey, 'p_retailprice', c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT p_partkey FROM part)",
)
def lookup(t: Tables):
    parts = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, F.col("p_retailprice")).alias("p_retailprice"), "p_size")
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("p_retailprice"))
    return properties.property_values([(parts, ["p_retailprice", "p_size"]), (customers, ["p_retailprice"])])


@query(
    "D19_cosine_join",
    "WITH raw AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), " + vector_knn("list_cosine_similarity(a.v, b.v)", "raw", 5),
)
def cosine(t: Tables):
    raw = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    near = top_matches(raw, raw, [Part("v", "cosine")], 5)
    return near.select("id", big("rank", "rank"), "nn_id", r6("similarity", "similarity"))
