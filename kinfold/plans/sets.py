"""Queries of set operations and table comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.operators import compare, grid, neighbors
from kinfold.operators.block_search import Part
from kinfold.operators.fingerprints import set_fingerprints
from kinfold.plans.registry import big, query
from kinfold.plans.tables import Tables, cte, knn

# Two versions of the word fingerprints: without one source and its longest words, without one language.
VERSIONS = (
    "old AS (SELECT w.id, bit FROM words w JOIN documents ON doc_id = w.id WHERE source <> 'src3'), "
    "new AS (SELECT w.id, bit FROM words w JOIN documents ON doc_id = w.id WHERE lang <> 'es' AND (length(bit) < 9 OR source = 'src5'))"
)


def versions(t: Tables):
    words = t.words.join(t.documents.select(F.col("doc_id").alias("id"), "source", "lang"), "id")
    old = words.where("source <> 'src3'").select("id", "bit")
    new = words.where("lang <> 'es' AND (length(bit) < 9 OR source = 'src5')").select("id", "bit")
    return set_fingerprints(old), set_fingerprints(new)


@query(
    "G01_id_diff",
    cte("words", VERSIONS)
    + "SELECT id, CASE WHEN NOT bool_or(side = 1) THEN 'added' WHEN NOT bool_or(side = 2) THEN 'removed' ELSE 'common' END AS status "
    "FROM (SELECT id, 1 AS side FROM old UNION SELECT id, 2 FROM new) GROUP BY id",
)
def id_diff(t: Tables):
    return compare.id_diff(*versions(t))


DIFF = (
    "merged AS (SELECT id, bit, bool_or(side = 1) AS o, bool_or(side = 2) AS n FROM (SELECT id, bit, 1 AS side FROM old UNION ALL SELECT id, bit, 2 FROM new) GROUP BY ALL), "
    "has AS (SELECT id, bool_or(o) AS ho, bool_or(n) AS hn FROM merged GROUP BY id), "
    "diff AS (SELECT id, CASE WHEN NOT ho THEN 'old' WHEN NOT hn THEN 'new' END AS missing, count(*) FILTER (ho AND hn AND NOT o) AS added, count(*) FILTER (ho AND hn AND NOT n) AS removed, "
    "min(CASE WHEN ho AND hn AND NOT n THEN bit END) AS first_removed FROM merged JOIN has USING (id) GROUP BY id, ho, hn)"
)


@query(
    "G02_feature_diff_per_entity",
    cte("words", VERSIONS, DIFF) + "SELECT id, missing, CASE WHEN missing IS NULL THEN added ELSE -1 END AS added, CASE WHEN missing IS NULL THEN removed ELSE -1 END AS removed, first_removed FROM diff",
)
def feature_diff(t: Tables):
    diff = compare.feature_diff(*versions(t))
    n = lambda c: big(F.coalesce(F.size(c), F.lit(-1)), c)
    return diff.select("id", "missing", n("added"), n("removed"), F.get("removed", F.lit(0)).alias("first_removed"))


@query(
    "G03_diff_summary",
    cte("words", VERSIONS, DIFF) + "SELECT count(*) FILTER (added > 0) AS with_additions, count(*) FILTER (removed > 0) AS with_removals, count(missing) AS without_fingerprint, count(*) AS entities FROM diff",
)
def summary(t: Tables):
    return compare.diff_summary(compare.feature_diff(*versions(t)))


@query(
    "G04_required_field_audit",
    cte("entities")
    + ", n AS (SELECT count(*) - count(cid) AS cid, count(*) - count(sid) AS sid, count(*) - count(casrn) AS casrn, count(*) - count(smiles) AS smiles, count(*) AS inchi_key FROM entities) "
    "SELECT unnest(['cid', 'sid', 'casrn', 'smiles', 'inchi_key']) AS field, unnest([cid, sid, casrn, smiles, inchi_key]) AS null_count, unnest([false, false, false, false, true]) AS absent_column FROM n",
)
def audit(t: Tables):
    return compare.field_audit(t.entities, ["cid", "sid", "casrn", "smiles", "inchi_key"])


@query(
    "G04_rows_lacking_a_field",
    cte("entities") + "SELECT id, 'cid' AS field FROM entities WHERE cid IS NULL UNION ALL SELECT id, 'sid' FROM entities WHERE sid IS NULL UNION ALL SELECT id, 'casrn' FROM entities WHERE casrn IS NULL",
)
def lacking(t: Tables):
    return compare.rows_lacking(t.entities, ["cid", "sid", "casrn"])


@query(
    "G05_value_set_sizes",
    "WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_totalprice > 200000) "
    "SELECT 'a' AS \"set\", count(*) AS n FROM a UNION ALL SELECT 'b', count(*) FROM b UNION ALL SELECT 'union', count(*) FROM (FROM a UNION FROM b) UNION ALL SELECT 'both', count(*) FROM (FROM a INTERSECT FROM b) "
    "UNION ALL SELECT 'a_only', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'b_only', count(*) FROM (FROM b EXCEPT FROM a)",
)
def value_sets(t: Tables):
    return compare.value_set_sizes(t.orders.where("o_orderstatus = 'F'").select("o_custkey"), t.orders.where("o_totalprice > 200000").select("o_custkey"))


@query(
    "G05_id_presence",
    cte("entities")
    + "SELECT count(*) FILTER (cid IS NOT NULL AND sid IS NOT NULL) AS both, count(*) FILTER (cid IS NOT NULL AND sid IS NULL) AS only_cid, "
    "count(*) FILTER (cid IS NULL AND sid IS NOT NULL) AS only_sid, count(*) FILTER (cid IS NULL AND sid IS NULL) AS neither FROM entities",
)
def presence(t: Tables):
    return compare.id_presence(t.entities, "cid", "sid")


@query(
    "G06_row_count_reconciliation",
    "SELECT 'documents' AS \"table\", count(*) AS old_rows, count(*) FILTER (lang <> 'es') AS new_rows, count(*) = count(*) FILTER (lang <> 'es') AS same FROM documents "
    "UNION ALL SELECT 'labels', count(*), count(*), true FROM labels",
)
def row_counts(t: Tables):
    return compare.row_count_report({"documents": t.documents, "labels": t.labels}, {"documents": t.documents.where("lang <> 'es'"), "labels": t.labels})


@query(
    "G06_record_differences",
    "WITH a AS (SELECT doc_id AS id, quality, toxic FROM labels), b AS (SELECT doc_id AS id, quality, CASE WHEN quality = 0 THEN 1 - toxic ELSE toxic END AS toxic FROM labels) "
    "SELECT *, 'old' AS only_in FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'new' FROM (FROM b EXCEPT ALL FROM a)",
)
def differences(t: Tables):
    old = t.labels.withColumnRenamed("doc_id", "id")
    new = old.withColumn("toxic", F.when(F.col("quality") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    return compare.record_differences(old, new, t.labelled)


@query(
    "G07_endpoint_sides",
    cte("dose_obs")
    + ", s AS (SELECT CASE WHEN endpoint LIKE 'PROMO%' THEN obs * 0 WHEN endpoint LIKE 'LARGE%' THEN 1 ELSE obs END AS obs, endpoint FROM dose_obs) "
    "SELECT endpoint, CASE WHEN min(obs) = 1 THEN 'only_positive' WHEN max(obs) = 0 THEN 'only_negative' ELSE 'both' END AS side FROM s GROUP BY endpoint",
)
def sides(t: Tables):
    shifted = F.when(F.col("endpoint").startswith("PROMO"), 0).when(F.col("endpoint").startswith("LARGE"), 1).otherwise(F.col("obs"))
    return grid.endpoint_sides(t.dose_obs.withColumn("obs", shifted))


@query(
    "G07_negative_overrides",
    cte("dose_obs")
    + "SELECT id, endpoint, min(obs)::DOUBLE AS obs FROM dose_obs GROUP BY id, endpoint "
    "UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT id FROM dose_obs)",
)
def overrides(t: Tables):
    out = grid.negative_first_cells(t.dose_obs, t.customer.select(F.col("c_custkey").alias("id")))
    return out.withColumn("obs", F.col("obs").cast("double"))


@query(
    "G08_filter_renaming",
    cte("baskets", "returners", knn("baskets", 3, "returners")) + "SELECT 'tox_any' AS sel_by, id, count(*) AS n FROM knn GROUP BY id",
)
def renaming(t: Tables):
    table = neighbors.neighbor_table(t.basket_sets, [Part("ds")], "basket", "returners", t.returners, k=3)
    return compare.rename_filters(table, {"returners": "tox_any"}).groupBy("sel_by", "id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "G09_freshness",
    "WITH u AS (SELECT p_brand AS fp_id, max(o_orderdate) AS up, min(o_orderdate) AS lo, max(CASE WHEN l_returnflag = 'R' THEN o_orderdate END) AS gen FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY p_brand), "
    "c AS (SELECT p_brand AS fp_id, p_type AS sel_by, max(o_orderdate) AS calc FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE p_type <> 'PROMO' GROUP BY ALL) "
    "SELECT u.fp_id, f.sel_by, CASE WHEN gen >= up THEN 'OK' ELSE 'OUTDATED' END AS fp_status, CASE WHEN coalesce(calc, DATE '1970-01-01') >= up THEN 'OK' ELSE 'OUTDATED' END AS nn_status "
    "FROM u CROSS JOIN (VALUES ('ECONOMY'), ('SMALL'), ('PROMO')) f(sel_by) LEFT JOIN c ON c.fp_id = u.fp_id AND c.sel_by = f.sel_by",
)
def freshness(t: Tables):
    day = lambda c: F.date_format(c, "yyyyMMdd").alias("date")
    s = t.sales.withColumnRenamed("p_brand", "fp_id")
    upstream = s.groupBy("fp_id").agg(day(F.max("o_orderdate")))
    made = s.where("l_returnflag = 'R'").groupBy("fp_id").agg(day(F.max("o_orderdate")))
    calculated = s.where("p_type <> 'PROMO'").groupBy("fp_id", F.col("p_type").alias("sel_by")).agg(day(F.max("o_orderdate")))
    return compare.freshness(upstream, made, calculated, ["ECONOMY", "SMALL", "PROMO"], "19700101")
