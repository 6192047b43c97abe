"""Queries of filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import effects, fingerprints, grid, neighbors, predict, search, similarity
from kinfold.operators.block_search import Part
from kinfold.plans.registry import big, query, r6
from kinfold.plans.tables import Tables, cte, members


@query(
    "C01_usable_structures",
    cte("entities")
    + "SELECT id, smiles FROM entities WHERE cid IS NOT NULL AND smiles IS NOT NULL AND NOT regexp_matches(smiles, '[|*]') AND smiles <> 'FAIL' AND trim(smiles) <> ''",
)
def structures(t: Tables):
    return t.entities.where(fingerprints.usable_structure(F.col("cid"), F.col("smiles"))).select("id", "smiles")


@query(
    "C02_available_analogs",
    cte("words", "labelled") + "SELECT id, count(*) AS n FROM words WHERE id IN (FROM labelled) GROUP BY id",
)
def available(t: Tables):
    return neighbors.available(t.word_lists, t.labelled).select("id", big(F.size("ds"), "n"))


@query(
    "C03_usable_fingerprints",
    cte("words", "entities")
    + "SELECT w.id, count(*) AS n FROM words w JOIN entities e ON e.id = w.id WHERE e.cid IS NOT NULL GROUP BY w.id HAVING count(*) >= 60",
)
def usable(t: Tables):
    stored = t.word_lists.join(t.entities.select("id", "cid"), "id").withColumn("fail", F.when(F.size("ds") < 60, "too short"))
    return stored.where(fingerprints.usable_fingerprint(F.col("ds"), F.col("cid"), F.col("fail"))).select("id", big(F.size("ds"), "n"))


@query(
    "C04_size_band_of_candidates",
    cte("words")
    + ", n AS (SELECT id, count(*) AS n FROM words GROUP BY id), h AS (SELECT n, count(*) AS sets FROM n GROUP BY n) "
    "SELECT a.n, sum(b.sets)::BIGINT AS candidates FROM h a JOIN h b ON b.n BETWEEN floor(0.8 * a.n) AND floor(a.n / 0.8) GROUP BY a.n",
)
def band(t: Tables):
    sizes = t.word_lists.groupBy(F.size("ds").alias("n")).agg(F.count(F.lit(1)).alias("sets"))
    within = F.sequence(F.floor(0.8 * F.col("n")).cast("int"), F.floor(F.col("n") / 0.8).cast("int"))
    wanted = sizes.select(big("n", "n"), F.explode(within).alias("m"))
    others = sizes.select(F.col("n").alias("m"), "sets")
    met = wanted.join(others, "m").where(similarity.size_band(F.col("n"), F.col("m"), 0.8))
    return met.groupBy("n").agg(F.sum("sets").alias("candidates"))


@query(
    "C05_endpoint_name_filter",
    cte("dose_obs")
    + "SELECT endpoint, count(*) AS n, regexp_matches(endpoint, '(?i)brand#1[0-4]$') AS by_pattern FROM dose_obs WHERE contains(lower(endpoint), 'promo') GROUP BY endpoint",
)
def named(t: Tables):
    kept = t.dose_obs.where(grid.endpoint_matches(F.col("endpoint"), "Promo"))
    return kept.groupBy("endpoint").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "by_pattern", grid.endpoint_matches(F.col("endpoint"), "brand#1[0-4]$", regex=True)
    )


@query(
    "C06_vendor_subset",
    "SELECT l_suppkey AS id, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE starts_with(replace(p_brand, '#', '_') || '_' || p_type, 'Brand_2_') GROUP BY l_suppkey",
)
def vendor(t: Tables):
    assays = t.part.select(F.col("p_partkey").alias("aeid"), F.concat_ws("_", F.replace("p_brand", F.lit("#"), F.lit("_")), "p_type").alias("name"))
    results = t.lineitem.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("aeid"))
    return (
        results.join(assays.where(fingerprints.of_vendor(F.col("name"), "Brand_2")), "aeid", "left_semi")
        .groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    )


CLASSES = "CASE WHEN p_size % 10 = 0 THEN 'Unknown ' || p_type WHEN p_size % 10 = 1 THEN 'uncertain' ELSE p_type END"


@query(
    "C07_certain_labels",
    f"SELECT bit, count(*) AS n FROM (SELECT {CLASSES} AS bit FROM part) WHERE NOT regexp_matches(lower(bit), 'unknown|uncertain') GROUP BY bit",
)
def certain(t: Tables):
    bits = t.part.select(F.expr(CLASSES).alias("bit"))
    return bits.where(fingerprints.certain_label(F.col("bit"))).groupBy("bit").agg(F.count(F.lit(1)).alias("n"))


@query(
    "C08_effect_selection",
    cte("effects")
    + "SELECT chem_id, effect_target, level, count(*) AS n FROM effects WHERE study_guideline_id IS NOT NULL AND study_type = '1-URGENT' AND effect_critical = 1 "
    "AND species = 'PROMO' GROUP BY ALL",
)
def selected(t: Tables):
    kept = effects.select_effects(t.effects, study_type="1-URGENT", critical=1, species="PROMO")
    return kept.groupBy("chem_id", "effect_target", "level").agg(F.count(F.lit(1)).alias("n"))


@query(
    "C09_include_list",
    cte("words", "labelled", members("words", 5, "labelled"))
    + "SELECT target, id, round(similarity, 6) AS similarity FROM members WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def checked(t: Tables):
    near = neighbors.nearest(t.word_lists, t.word_lists, [Part("ds")], 5, holders=t.labelled)
    kept = t.labels.where("quality = 1").select(F.col("doc_id").alias("id"))
    return predict.include_checked(near, kept).select("target", "id", r6("similarity", "similarity"))


@query(
    "C10_text_search_predicate",
    "SELECT p_partkey AS id, starts_with(lower(p_name), 'red b') AS by_prefix FROM part WHERE starts_with(lower(p_name), 'red b') OR contains(lower(p_type), 'red b') "
    "OR contains(lower(p_brand || ' red b'), 'brand#7 red b') OR p_type = 'Red B'",
)
def predicate(t: Tables):
    c = F.col
    hit = search.text_matches(F.lit("Red B"), c("p_name"), F.array("p_type"), c("p_type"))
    brand = search.text_matches(F.lit("brand#7 red b"), F.lit(""), F.array(F.concat("p_brand", F.lit(" Red b"))), F.lit(None).cast("string"))
    return t.part.where(hit | brand).select(
        c("p_partkey").alias("id"), search.text_matches(F.lit("red b"), c("p_name"), F.lit(None).cast("array<string>"), F.lit("")).alias("by_prefix")
    )


@query(
    "C10_prefix_listing",
    "SELECT DISTINCT p_partkey AS id, text FROM (SELECT p_partkey, p_name AS text FROM part UNION ALL SELECT p_partkey, p_type FROM part UNION ALL "
    "SELECT p_partkey, p_brand FROM part) WHERE starts_with(lower(text), 's')",
)
def listing(t: Tables):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_type", "p_brand").alias("synonyms"))
    return search.prefix_listing(rows, "S")
