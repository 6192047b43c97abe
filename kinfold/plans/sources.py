"""Queries of sources, sinks and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.operators import neighbors
from kinfold.operators.block_search import Part
from kinfold.operators.fingerprints import numeric_fingerprints
from kinfold.operators.grid import read_across_grid
from kinfold.operators.properties import population_scaled, property_values
from kinfold.plans.registry import big, query, r6, text
from kinfold.plans.tables import Tables, cte, knn, members
from kinfold.sources import readers, writers

BITS = [Part("ds")]


@query(
    "A01_scan_filter_project",
    "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'",
)
def scan(t: Tables):
    where = (F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")
    return readers.scan(t.spark, f"{t.folder}/lineitem.parquet", where, ["l_orderkey", "l_partkey", "l_quantity"])


NATION_ORDERS = """
    SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name
"""


@query("A02_relational_source", NATION_ORDERS)
def relational(t: Tables):
    return readers.relational(t.spark, NATION_ORDERS, {"orders": t.orders, "customer": t.customer, "nation": t.nation})


@query(
    "A03_union_of_lists",
    cte("entities") + "SELECT sid AS id, name, NULL::DOUBLE AS size FROM entities WHERE sid IS NOT NULL "
    "UNION ALL SELECT 'P' || p_partkey, p_name, p_size::DOUBLE FROM part WHERE p_type <> 'PROMO'",
)
def lists(t: Tables):
    parts = t.part.selectExpr("CASE WHEN p_type <> 'PROMO' THEN 'P' || p_partkey END AS id", "p_name AS name", "CAST(p_size AS DOUBLE) AS size")
    return readers.union_lists([t.entities.select(F.col("sid").alias("id"), "name"), parts], "id").select("id", "name", "size")


@query(
    "A04_nested_json_to_flat",
    "SELECT event_id, user_id AS user_key, event_type AS kind, CAST(json_extract(props, '$.k') AS INTEGER) AS props_k FROM events",
)
def nested(t: Tables):
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    parsed = t.events.withColumn("props", F.from_json("props", schema))
    return readers.reshape(parsed, {"event_id": "event_id", "user_key": "user_id", "kind": "event_type", "props_k": "props.k"})


@query(
    "A05_project_and_rename",
    "SELECT c_custkey AS id, c_name AS preferred_name, c_acctbal AS mol_weight, c_mktsegment AS segment FROM customer",
)
def rename(t: Tables):
    return writers.renamed(
        t.customer, {"id": "c_custkey", "preferred_name": "c_name", "mol_weight": "c_acctbal", "segment": "c_mktsegment"}
    )


@query(
    "A06_replace_rows_of_ids",
    "SELECT doc_id AS id, n_chars AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) "
    "UNION ALL SELECT doc_id, (quality * 10 + toxic)::BIGINT FROM labels",
)
def replace(t: Tables):
    base = t.documents.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n"))
    new = t.labels.select(F.col("doc_id").alias("id"), big(F.col("quality") * 10 + F.col("toxic"), "n"))
    return writers.replace_rows(base, new)


@query(
    "A07_filtered_export",
    "SELECT 'labels' AS tbl, '{\"doc_id\":' || doc_id || ',\"quality\":' || quality || ',\"toxic\":' || toxic || '}' AS value FROM labels WHERE toxic = 1 "
    "UNION ALL SELECT 'nation', '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' FROM nation WHERE n_regionkey > 1",
)
def export(t: Tables):
    tables = {"labels": (t.labels, F.col("toxic") == 1), "nation": (t.nation, F.col("n_regionkey") > 1)}
    out = [writers.json_lines(df, where).select(F.lit(name).alias("tbl"), "value") for name, (df, where) in tables.items()]
    return out[0].unionByName(out[1])


def wide_sql() -> str:
    columns = ", ".join(
        f"max(CASE WHEN rank = {r} THEN value END) AS v{r}, max(CASE WHEN rank = {r} THEN dose END) AS d{r}" for r in range(1, 5)
    )
    return (
        cte("baskets", "returners", members("baskets", 4, "returners"), "dose_obs")
        + ", cells AS (SELECT id, endpoint, max(obs) AS obs, min(CASE WHEN obs = 1 AND dose > 0 THEN dose END) AS dose FROM dose_obs GROUP BY id, endpoint), "
        "seen AS (SELECT DISTINCT target, endpoint FROM members JOIN cells USING (id)), "
        "long AS (SELECT m.target, '1 header' AS section, h.name, rank, CASE h.name WHEN 'role' THEN CASE WHEN m.id = m.target THEN 'target' ELSE 'analog' END "
        "WHEN 'id' THEN m.id::VARCHAR ELSE printf('%.4f', similarity) END AS value, NULL::VARCHAR AS dose "
        "FROM members m, (VALUES ('role'), ('id'), ('similarity')) h(name) "
        "UNION ALL SELECT m.target, '2 property', 'balance', rank, c_acctbal::VARCHAR, NULL FROM members m JOIN customer ON c_custkey = m.id "
        "UNION ALL SELECT s.target, '3 endpoint', s.endpoint, rank, CASE WHEN obs IS NULL THEN 'no_data' WHEN obs = 0 THEN 'no_effect' ELSE 'pos_effect' END, dose::VARCHAR "
        "FROM seen s JOIN members m USING (target) LEFT JOIN cells c ON c.id = m.id AND c.endpoint = s.endpoint) "
        f"SELECT target, section, name, {columns} FROM long GROUP BY ALL"
    )


@query("A08_wide_grid_export", wide_sql())
def wide(t: Tables):
    near = neighbors.nearest(t.basket_sets, t.basket_sets, BITS, 4, holders=t.returners)
    grid = read_across_grid(near, t.dose_obs)
    properties = t.customer.select(F.col("c_custkey").alias("id"), F.lit("balance").alias("name"), F.col("c_acctbal").cast("string").alias("text"))
    of_members = near.select("target", "id").join(properties, "id")
    out = writers.wide_grid(grid, near, 4, {"value": [F.col("value")], "dose": [F.col("dose")]}, of_members)
    return out.withColumnsRenamed({f"{r}_{n}": f"{n[0]}{r}" for r in range(1, 5) for n in ("value", "dose")})


@query(
    "A09_neighbour_export_with_bits",
    cte("baskets", "returners", members("baskets", 3, "returners"))
    + ", vocab AS (SELECT DISTINCT bit FROM baskets), "
    "flags AS (SELECT ids.id, v.bit, CASE WHEN b.bit IS NULL THEN '0' ELSE '1' END AS flag FROM (SELECT DISTINCT id FROM members) ids, vocab v "
    "LEFT JOIN baskets b ON b.id = ids.id AND b.bit = v.bit), "
    "texts AS (SELECT id, string_agg(flag, '' ORDER BY bit) AS bits, string_agg(CASE WHEN flag = '1' THEN bit END, ' ' ORDER BY bit) AS ds FROM flags GROUP BY id) "
    "SELECT target, rank, id, ds, bits, substr(bits, 1, 1)::INTEGER AS first_bit FROM members JOIN texts USING (id)",
)
def neighbour_bits(t: Tables):
    sets = t.basket_sets
    near = neighbors.nearest(sets, sets, BITS, 3, holders=t.returners)
    rows = writers.neighbour_bits(near, sets, t.baskets.select("bit").distinct())
    return writers.bit_columns(rows, ["first_bit"]).select("target", big("rank", "rank"), "id", text("ds", "ds"), "bits", "first_bit")


NUMERIC = (
    "WITH raw AS (SELECT p_partkey AS id, p_retailprice AS price, p_size::DOUBLE AS size FROM part), "
    "span AS (SELECT min(price) AS pl, max(price) AS ph, min(size) AS sl, max(size) AS sh FROM raw), "
    "v AS (SELECT id, [(price - pl) / (ph - pl), (size - sl) / (sh - sl)] AS v FROM raw, span), "
    "near AS (SELECT a.id, b.id AS nn_id, 1 - list_distance(a.v, b.v) / sqrt(2) AS similarity FROM v a JOIN v b ON a.id <> b.id "
    "QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY similarity DESC, nn_id) <= 2) "
)


@query(
    "A09_neighbour_export_of_values",
    NUMERIC + "SELECT n.id AS target, count(*) + 1 AS n, round(sum(similarity) + 1, 6) AS total, max(CASE WHEN n.nn_id = r.id THEN 1 ELSE 0 END) AS found "
    "FROM near n JOIN raw r ON r.id = n.nn_id GROUP BY n.id",
)
def neighbour_values(t: Tables):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    numeric = numeric_fingerprints(property_values([(rows, ["price", "size"])]), ["price", "size"])
    vectors = population_scaled(numeric, ["price", "size"]).select("id", F.array("price", "size").alias("v")).persist()
    near = neighbors.nearest(vectors, vectors, [Part("v", "euclid")], 3)
    values = writers.neighbour_values(near, numeric).join(near.select("target", "id", "similarity"), ["target", "id"])
    return values.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("similarity"), "total"), F.max(F.col("price").isNotNull().cast("int")).alias("found")
    )


@query(
    "A10_export_metadata",
    "SELECT * FROM (VALUES ('parameter', 'k0', '10', 'Neighbours'), ('parameter', 's0', '0.1', 'Threshold'), "
    "('column', 'a_s', NULL, 'Similarity-weighted activity')) v(kind, name, value, description) "
    "UNION ALL SELECT 'parameter', 'rows', count(*)::VARCHAR, 'Exported entities' FROM labels",
)
def metadata(t: Tables):
    return writers.export_metadata(
        t.labels, {"k0": ("10", "Neighbours"), "s0": ("0.1", "Threshold")}, {"a_s": "Similarity-weighted activity"}
    )


@query(
    "A11_neighbourhood_closed_sample",
    cte("baskets", "ranges", "returners", knn("baskets", 3, name="b"), knn("ranges", 3, name="r"))
    + ", kept AS (SELECT id FROM returners UNION SELECT nn_id FROM b WHERE id IN (FROM returners) UNION SELECT nn_id FROM r WHERE id IN (FROM returners)), "
    "every AS (SELECT 'customers' AS name, c_custkey AS id FROM customer UNION ALL SELECT 'orders', o_custkey FROM orders UNION ALL SELECT 'baskets', id FROM baskets UNION ALL SELECT 'ranges', id FROM ranges "
    "UNION ALL SELECT 'neighbours', id FROM b UNION ALL SELECT 'neighbours', id FROM r) SELECT name, id, count(*) AS n FROM every WHERE id IN (FROM kept) GROUP BY ALL",
)
def closed(t: Tables):
    tables = neighbors.neighbor_table(t.basket_sets, BITS, "basket", "no_filter", k=3).unionByName(
        neighbors.neighbor_table(t.range_sets, BITS, "range", "no_filter", k=3)
    )
    sample = writers.closed_sample(t.returners, tables)
    every = {
        "customers": t.customer.select(F.col("c_custkey").alias("id")), "orders": t.orders.select(F.col("o_custkey").alias("id")),
        "baskets": t.baskets, "ranges": t.ranges, "neighbours": tables,
    }
    counts = [df.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "id", "n") for name, df in writers.sampled_tables(sample, every).items()]
    return reduce(lambda a, b: a.unionAll(b), counts)


@query(
    "A12_result_records",
    "SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_discount > 0 THEN round(l_extendedprice / l_discount, 6) END AS per_discount FROM lineitem",
)
def records(t: Tables):
    ratio = F.when(F.col("l_discount") > 0, F.try_divide("l_extendedprice", "l_discount")).otherwise(F.lit(float("nan")))
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), ratio.alias("per_discount"))
    return writers.records(rows).select("id", "line", r6("per_discount", "per_discount"))
