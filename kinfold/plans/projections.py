"""Queries of projections and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions import arrays, numbers
from kinfold.functions import text as tx
from kinfold.operators import ids
from kinfold.operators.fingerprints import set_fingerprints
from kinfold.plans.registry import query, text
from kinfold.plans.tables import DOSE_COLUMNS, Tables, cte
from kinfold.sources import readers

PROMOTED = "coalesce(nullif(cid, ''), nullif(sid, ''), nullif(casrn, ''), nullif(smiles, ''), nullif(name, ''))"
KIND = (
    "CASE WHEN upper(text[1:6]) = 'DTXCID' THEN 'cid' WHEN upper(text[1:6]) = 'DTXSID' THEN 'sid' "
    "WHEN regexp_matches(text, '^\\d{2,7}-\\d{2}-\\d\\b') THEN 'casrn' ELSE 'name' END"
)
# ids of all sorts, some in lower case, some unknown
ASKED = [
    "CASE WHEN id % 5 = 0 THEN lower(cid) WHEN id % 5 = 1 THEN sid WHEN id % 5 = 2 THEN casrn WHEN id % 5 = 3 THEN smiles "
    "WHEN id % 4 = 0 THEN name ELSE 'nobody ' || id END AS text"
]


@query("B01_promoted_id", cte("entities") + f"SELECT id, {PROMOTED} AS chem_id FROM entities")
def promoted(t: Tables):
    return ids.with_promoted_id(t.entities).select("id", "chem_id")


@query(
    "B02_id_kind",
    cte("entities", f"asked AS (SELECT {ASKED[0]} FROM entities)")
    + f"SELECT kind, count(*) AS n FROM (SELECT {KIND} AS kind FROM asked WHERE text IS NOT NULL) GROUP BY kind",
)
def kinds(t: Tables):
    asked = t.entities.selectExpr(*ASKED).where("text IS NOT NULL")
    return asked.groupBy(tx.id_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


RESOLVE = (
    f"keyed AS (SELECT DISTINCT text, {KIND} AS kind FROM asked), "
    f"master AS (SELECT *, {PROMOTED} AS chem_id FROM entities), "
    "index AS (SELECT 'cid' AS kind, cid AS key, 0 AS field, chem_id FROM master UNION ALL SELECT 'sid', sid, 1, chem_id FROM master "
    "UNION ALL SELECT 'casrn', casrn, 2, chem_id FROM master UNION ALL SELECT 'name', smiles, 3, chem_id FROM master "
    "UNION ALL SELECT 'name', name, 4, chem_id FROM master), "
    "best AS (SELECT kind, key, chem_id FROM index WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY field, chem_id) = 1), "
    "resolved AS (SELECT k.text, k.kind, b.chem_id FROM keyed k LEFT JOIN best b ON b.kind = k.kind "
    "AND b.key = CASE WHEN k.kind IN ('cid', 'sid') THEN upper(k.text) ELSE k.text END)"
)


@query(
    "B03_resolve_any_id",
    cte("entities", f"asked AS (SELECT {ASKED[0]} FROM entities)", RESOLVE) + "SELECT * FROM resolved WHERE text IS NOT NULL",
)
def resolve(t: Tables):
    return ids.resolve(t.entities.selectExpr(*ASKED).where("text IS NOT NULL"), t.entities)


LISTS = (
    "o_orderkey AS list_id, ' DTXSID' || o_custkey || ', Customer#' || lpad(o_custkey::VARCHAR, 9, '0') || ' ,dtxcid' || (o_custkey + 1) "
    "|| ',nobody, DTXSID' || o_custkey || ',Customer#' || lpad((o_custkey + 2)::VARCHAR, 9, '0') AS ids"
)


@query(
    "B04_clean_id_list",
    cte(
        "entities", f"lists AS (SELECT {LISTS} FROM orders)",
        "split AS (SELECT list_id, trim(unnest(string_split(ids, ','))) AS text, unnest(range(6)) AS pos FROM lists)",
        "asked AS (SELECT text FROM split)", RESOLVE,
        "promoted AS (SELECT text, coalesce(chem_id, CASE WHEN kind IN ('cid', 'sid') THEN upper(text) WHEN kind = 'casrn' THEN text END) AS chem_id FROM resolved)",
        "kept AS (SELECT list_id, p.chem_id, min(pos) AS pos FROM split JOIN promoted p USING (text) "
        "WHERE upper(p.chem_id[1:6]) IN ('DTXCID', 'DTXSID') OR regexp_matches(p.chem_id, '^\\d{2,7}-\\d{2}-\\d\\b') GROUP BY list_id, p.chem_id)",
    )
    + "SELECT list_id, string_agg(chem_id, ',' ORDER BY pos, chem_id) AS ids FROM kept GROUP BY list_id",
)
def clean(t: Tables):
    return ids.clean_lists(t.orders.selectExpr(*_split(LISTS)), t.entities)


def _split(columns: str) -> list[str]:
    head, tail = columns.split(" AS list_id, ")
    return [head + " AS list_id", tail.replace("::VARCHAR", "")]


@query(
    "B05_nested_path",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, NULL::VARCHAR AS absent FROM events",
)
def path(t: Tables):
    inner = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("deep", T.StructType([T.StructField("x", T.StringType())]))])
    return t.events.withColumn("props", F.from_json("props", inner)).select(
        "event_id", F.col("props.k").alias("k"), F.col("props.deep.x").alias("absent")
    )


FACTOR = "CASE unit WHEN 'mg/kg/day' THEN 1.0::DOUBLE WHEN 'mg/kg/wk' THEN 1.0::DOUBLE / 7 END"


@query(
    "B06_dose_unit_normalisation",
    cte("effects") + f"SELECT unit, count(*) AS n, count(f) AS usable, round(sum(dose * f), 4) AS total FROM (SELECT *, {FACTOR} AS f FROM effects) GROUP BY unit",
)
def dose(t: Tables):
    norm = numbers.normalised_dose(F.col("dose"), F.col("unit"))
    return t.effects.withColumn("norm", norm).groupBy("unit").agg(
        F.count(F.lit(1)).alias("n"), F.count("norm").alias("usable"), F.round(F.sum("norm"), 4).alias("total")
    )


@query(
    "B07_log_molar_dose",
    f"SELECT *, round(power(10, log_molar) * weight, 6) AS back FROM (SELECT l_orderkey, l_linenumber, l_partkey, p_retailprice AS weight, l_quantity AS dose, "
    "round(log10(l_quantity / p_retailprice), 9) AS log_molar FROM lineitem JOIN part ON p_partkey = l_partkey)",
)
def molar(t: Tables):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("p_retailprice").alias("weight"), F.col("l_quantity").alias("dose")
    )
    log = F.round(numbers.log_molar(F.col("dose"), F.col("weight")), 9)
    return rows.withColumn("log_molar", log).withColumn(
        "back", F.round(numbers.from_log_molar(F.col("log_molar"), F.col("weight")), 6)
    )


@query(
    "B08_null_hygiene",
    "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_tax > 0 THEN l_tax END AS tax, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN l_returnflag END AS flag, "
    "(CASE WHEN l_tax <> 0 THEN 1 ELSE 0 END + CASE WHEN l_discount <> 0 THEN 1 ELSE 0 END) AS entries FROM lineitem",
)
def hygiene(t: Tables):
    tax = F.when(F.col("l_tax") > 0, F.col("l_tax")).otherwise(F.lit(float("nan")))
    flag = F.when(F.col("l_returnflag") == "A", "None").when(F.col("l_returnflag") == "N", "NULL").otherwise(F.col("l_returnflag"))
    both = F.create_map(F.lit("tax"), F.col("l_tax"), F.lit("discount"), F.col("l_discount"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_quantity", numbers.nan_to_null(tax).alias("tax"), numbers.text_to_null(flag).alias("flag"),
        F.size(numbers.drop_falsy_entries(both)).alias("entries"),
    )


@query(
    "B09_flatten_nested",
    "SELECT l_orderkey AS key_order, l_linenumber AS key_line, l_quantity AS props_quantity, l_tax AS props_rates_first FROM lineitem",
)
def flatten(t: Tables):
    nested = t.lineitem.select(
        F.struct(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line")).alias("key"),
        F.struct(F.col("l_quantity").alias("quantity"), F.struct(F.array("l_tax", "l_discount").alias("first")).alias("rates")).alias("props"),
    )
    flat = readers.flattened(nested)
    return flat.toDF(*(c.replace(".", "_") for c in flat.columns))


@query(
    "B10_feature_names",
    cte("effects")
    + "SELECT study_type || ':' || effect_target || ':' || coalesce(effect_desc, 'None') AS fp1, study_type || ':' || effect_target AS fp2, "
    "'mc_' || regexp_replace(trim(coalesce(effect_desc, 'None') || '  x '), '\\s+', '_', 'g') AS class, count(*) AS n FROM effects GROUP BY ALL",
)
def names(t: Tables):
    c = F.col
    padded = F.concat(F.coalesce(c("effect_desc"), F.lit("None")), F.lit("  x "))
    return t.effects.groupBy(
        tx.feature_name(c("study_type"), c("effect_target"), c("effect_desc")).alias("fp1"),
        tx.feature_name(c("study_type"), c("effect_target")).alias("fp2"),
        tx.class_label("mc_", padded).alias("class"),
    ).agg(F.count(F.lit(1)).alias("n"))


BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query(
    "B11_bit_strings",
    "WITH v AS (SELECT 'Brand#' || i AS bit, i FROM range(1, 26) r(i)), b AS (SELECT DISTINCT l_suppkey AS id, p_brand AS bit FROM lineitem JOIN part ON p_partkey = l_partkey), "
    "s AS (SELECT DISTINCT id FROM b) SELECT s.id, string_agg(CASE WHEN b.bit IS NULL THEN '0' ELSE '1' END, '' ORDER BY v.i) AS bits, "
    "string_agg(b.bit, ' ' ORDER BY v.i) AS features FROM s CROSS JOIN v LEFT JOIN b ON b.id = s.id AND b.bit = v.bit GROUP BY s.id",
)
def bits(t: Tables):
    sold = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    sets = set_fingerprints(sold.select(F.col("l_suppkey").alias("id"), F.col("p_brand").alias("bit")))
    vocabulary = F.array(*(F.lit(b) for b in BRANDS))
    coded = sets.select("id", arrays.bits_of_features(F.col("ds"), vocabulary).alias("bits"))
    return coded.select("id", "bits", text(arrays.features_of_bits(F.col("bits"), vocabulary), "features"))


def score_sql(value: str, wanted: str) -> str:
    shared = f"(SELECT max(i) FROM range(1, least(length({value}), length({wanted})) + 1) r(i) WHERE left(lower({value}), i::BIGINT) = left({wanted}, i::BIGINT))"
    return (
        f"CASE WHEN lower({value}) = {wanted} THEN 0 WHEN left(lower({value}), 2) = left({wanted}, 2) THEN 1 WHEN contains(lower({value}), {wanted}) THEN 2 ELSE 3 END AS grade, "
        f"CASE WHEN lower({value}) <> {wanted} AND left(lower({value}), 2) = left({wanted}, 2) THEN length({wanted}) - {shared} ELSE 0 END::INTEGER AS unmatched"
    )


@query("B12_name_match_score", f"SELECT p_partkey, p_name, {score_sql('p_name', chr(39) + 'red bolt' + chr(39))} FROM part")
def score(t: Tables):
    return t.part.select("p_partkey", "p_name", tx.match_score(F.col("p_name"), F.lit("red bolt")).alias("s")).select(
        "p_partkey", "p_name", "s.grade", "s.unmatched"
    )


@query(
    "B13_label_split",
    f"SELECT split_part(endpoint, ':', 1) AS study, lower(split_part(endpoint, ':', 2)) AS organ, count(*) AS n FROM (SELECT {DOSE_COLUMNS[1]} "
    "FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY ALL",
)
def labels(t: Tables):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).selectExpr(DOSE_COLUMNS[1])
    study, organ = tx.label_parts(F.col("endpoint"))
    return rows.groupBy(study.alias("study"), organ.alias("organ")).agg(F.count(F.lit(1)).alias("n"))


@query("B14_placeholder_names", cte("entities") + "SELECT id, coalesce(nullif(trim(name), ''), 'Unnamed chemical') AS name FROM entities")
def unnamed(t: Tables):
    return t.entities.select("id", tx.placeholder_name(F.col("name")).alias("name"))


@query(
    "B15_property_text",
    "SELECT l_orderkey, l_linenumber, l_partkey, v, CASE WHEN v <> 0 AND abs(round_even(v, 2)) <= 0.1 THEN format('{:.3g}', v) ELSE format('{:.2f}', v) END AS txt "
    "FROM (SELECT *, sqrt(l_tax * l_discount + 0.0000123::DOUBLE * l_linenumber) / l_quantity + CASE WHEN l_linenumber > 4 THEN l_quantity / 7 ELSE 0 END AS v FROM lineitem)",
)
def shown(t: Tables):
    v = F.sqrt(F.col("l_tax") * F.col("l_discount") + F.lit(0.0000123) * F.col("l_linenumber")) / F.col("l_quantity") + F.when(F.col("l_linenumber") > 4, F.col("l_quantity") / 7).otherwise(0.0)
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", v.alias("v"))
    return rows.withColumn("txt", numbers.property_text(F.col("v"), 2))


@query(
    "B16_observation_text",
    cte("dose_obs")
    + "SELECT txt, CASE WHEN txt IN ('no_data', 'no_effect') THEN txt ELSE 'pos_effect' END AS class, count(*) AS n FROM (SELECT CASE WHEN obs IS NULL THEN 'no_data' "
    "WHEN obs = 0 THEN 'no_effect' WHEN dose IS NOT NULL THEN dose || ' ' || unit ELSE 'hit' END AS txt FROM dose_obs) GROUP BY ALL",
)
def observed(t: Tables):
    txt = tx.observation_text(F.col("obs"), F.col("dose"), F.col("unit"))
    return t.dose_obs.withColumn("txt", txt).groupBy("txt", tx.observation_class(F.col("txt")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
