"""Roles of the given tables: entities, fingerprints, outcomes, effects, properties.

Column expressions that Spark and the SQL checks share are written once.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.fingerprints import hashed_positions, set_fingerprints
from kinfold.session import ship

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

WORD_BREAK = r"[^\p{L}]+"

ENTITY_COLUMNS = [
    "c_custkey AS id",
    "CASE WHEN c_custkey % 3 <> 0 THEN 'DTXCID' || c_custkey END AS cid",
    "CASE WHEN c_custkey % 5 <> 0 THEN 'DTXSID' || c_custkey END AS sid",
    "CASE WHEN c_custkey % 7 <> 0 THEN (10000 + c_custkey % 9000000) || '-' || (10 + c_custkey % 90) || '-' || (c_custkey % 10) END AS casrn",
    "CASE WHEN c_custkey % 11 <> 0 THEN 'C' || c_nationkey || CASE WHEN c_custkey % 13 = 0 THEN '|R' ELSE '' END || '(' || c_custkey || ')' END AS smiles",
    "CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE c_name END AS name",
    "c_acctbal AS mol_weight",
]

EFFECT_COLUMNS = [
    "l_suppkey AS chem_id",
    "o_custkey % 10 AS study_id",
    "o_orderpriority AS study_type",
    "p_type AS species",
    "l_linenumber - 1 AS level",
    "l_quantity AS dose",
    "CASE l_returnflag WHEN 'A' THEN 'mg/kg/wk' WHEN 'N' THEN 'mg/kg/day' ELSE 'mg/animal/day' END AS unit",
    "CASE WHEN l_tax >= 0.05 THEN 1 ELSE 0 END AS effect_trt_related",
    "CASE WHEN l_tax >= 0.05 AND l_discount >= 0.05 THEN 1 ELSE 0 END AS effect_critical",
    "CASE WHEN p_size > 3 THEN p_size % 12 END AS study_guideline_id",
    "p_brand AS effect_target",
    "CASE WHEN p_size % 9 <> 0 THEN p_name END AS effect_desc",
]

DOSE_COLUMNS = [
    "o_custkey AS id",
    "p_type || ':' || p_brand AS endpoint",
    "CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS obs",
    "CASE WHEN l_returnflag <> 'R' AND l_linenumber > 1 THEN l_quantity END AS dose",
    "CASE l_returnflag WHEN 'A' THEN 'mg/kg/wk' ELSE 'mg/kg/day' END AS unit",
]

SALES = "lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey"

CTE = {
    "words": (
        "words AS (SELECT DISTINCT doc_id AS id, bit FROM (SELECT doc_id, "
        "unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS bit FROM documents) WHERE bit <> '')"
    ),
    "baskets": f"baskets AS (SELECT DISTINCT o_custkey AS id, p_brand || ':' || p_type AS bit FROM {SALES})",
    "ranges": f"ranges AS (SELECT DISTINCT o_custkey AS id, p_brand || ':' || p_size AS bit FROM {SALES})",
    "entities": f"entities AS (SELECT {', '.join(ENTITY_COLUMNS)} FROM customer)",
    "effects": f"effects AS (SELECT {', '.join(EFFECT_COLUMNS)} FROM {SALES})",
    "dose_obs": f"dose_obs AS (SELECT {', '.join(DOSE_COLUMNS)} FROM {SALES})",
    "label_obs": (
        "label_obs AS (SELECT doc_id AS id, 'quality' AS endpoint, quality AS obs FROM labels "
        "UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)"
    ),
    "returners": "returners AS (SELECT DISTINCT o_custkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_quantity > 45)",
    "labelled": "labelled AS (SELECT DISTINCT doc_id AS id FROM labels)",
}


def cte(*names: str) -> str:
    return "WITH " + ", ".join(CTE.get(n, n) for n in names) + " "


def knn(bits: str, k: int, holders: str | None = None, name: str = "knn", floor: float = 0.0, order: str = "nn_id") -> str:
    """SQL of the k nearest other entities by Jaccard: (id, rank, nn_id, similarity)."""
    only = f"AND b.id IN (SELECT id FROM {holders})" if holders else ""
    return (
        f"{name}_n AS (SELECT id, count(*) AS n FROM {bits} GROUP BY id), "
        f"{name}_o AS (SELECT a.id, b.id AS nn_id, count(*) AS o FROM {bits} a JOIN {bits} b ON a.bit = b.bit AND a.id <> b.id {only} GROUP BY a.id, b.id), "
        f"{name}_s AS (SELECT s.id, s.nn_id, o::DOUBLE / (x.n + y.n - o) AS similarity FROM {name}_o s JOIN {name}_n x ON x.id = s.id JOIN {name}_n y ON y.id = s.nn_id), "
        f"{name} AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, {order}) AS rank, nn_id, similarity "
        f"FROM {name}_s WHERE similarity >= {floor} QUALIFY rank <= {k})"
    )


def members(bits: str, k0: int, holders: str | None = None, name: str = "members", floor: float = 0.0, order: str = "nn_id") -> str:
    """SQL of ``nearest``: (target, rank, id, similarity) with the target at rank 1."""
    return (
        knn(bits, k0 - 1, holders, f"{name}_knn", floor, order)
        + f", {name} AS (SELECT DISTINCT id AS target, 1::BIGINT AS rank, id, 1.0::DOUBLE AS similarity FROM {bits} "
        f"UNION ALL SELECT id, rank + 1, nn_id, similarity FROM {name}_knn)"
    )


def pairs(bits: str, members: str = "members", name: str = "pairs") -> str:
    """SQL of the Jaccard similarities between the members of each neighbourhood: (target, a, b, similarity)."""
    n = "" if name == "pairs" else f"{name}_"
    return (
        f"{n}wn AS (SELECT id, count(*) AS n FROM {bits} GROUP BY id), {n}pr AS (SELECT a.target, a.id AS a, b.id AS b FROM {members} a JOIN {members} b ON a.target = b.target AND a.id <> b.id), "
        f"{n}po AS (SELECT a, b, count(*) AS o FROM (SELECT DISTINCT a, b FROM {n}pr) JOIN {bits} x ON x.id = a JOIN {bits} y ON y.id = b AND y.bit = x.bit GROUP BY a, b), "
        f"{name} AS (SELECT pr.target, pr.a, pr.b, coalesce(o::DOUBLE / (x.n + y.n - o), 0) AS similarity FROM {n}pr pr JOIN {n}wn x ON x.id = pr.a JOIN {n}wn y ON y.id = pr.b LEFT JOIN {n}po po ON po.a = pr.a AND po.b = pr.b)"
    )


def chance(rows: str, score: str, label: str, rounds: int, name: str = "chance") -> str:
    """SQL of the permutation test of (target, endpoint, id): (target, endpoint, p_val)."""
    cell = "target, endpoint"
    mix = lambda h, by, f: f"(xor({h}, {h} >> {by}) * {f}::UBIGINT) & 4294967295::UBIGINT"
    return (
        f"{name}_c AS (SELECT {cell}, sum({label}) AS n_pos, count(*) AS n FROM {rows} GROUP BY ALL), "
        f"{name}_r AS (SELECT {cell}, id, {label} AS y, rank() OVER (PARTITION BY {cell} ORDER BY {score}) + (count(*) OVER (PARTITION BY {cell}, {score}) - 1) / 2.0::DOUBLE AS place, "
        f"('0x' || substr(md5('1:' || target || ':' || endpoint || ':' || id), 1, 8))::UBIGINT AS draw FROM {rows}), "
        f"{name}_0 AS (SELECT {cell}, id, place, n_pos, i, (draw + 2654435761::UBIGINT * i) & 4294967295::UBIGINT AS h FROM {name}_r JOIN {name}_c USING ({cell}) "
        f"CROSS JOIN (SELECT unnest(range(1, {rounds} + 1))::UBIGINT AS i) WHERE n_pos > 0 AND n_pos < n), "
        f"{name}_1 AS (SELECT * REPLACE ({mix('h', 16, 2246822507)} AS h) FROM {name}_0), {name}_2 AS (SELECT * REPLACE ({mix('h', 13, 3266489909)} AS h) FROM {name}_1), "
        f"{name}_3 AS (SELECT {cell}, i, place FROM {name}_2 QUALIFY row_number() OVER (PARTITION BY {cell}, i ORDER BY xor(h, h >> 16), id) <= n_pos), "
        f"{name}_s AS (SELECT {cell}, i, sum(place) AS drawn FROM {name}_3 GROUP BY ALL), {name}_w AS (SELECT {cell}, sum(y * place) AS seen FROM {name}_r GROUP BY ALL), "
        f"{name}_p AS (SELECT {cell}, count(*) FILTER (drawn > seen) / {rounds}::DOUBLE AS p_val FROM {name}_s JOIN {name}_w USING ({cell}) GROUP BY ALL), "
        f"{name} AS (SELECT {cell}, coalesce(p_val, 1.0) AS p_val FROM {name}_c LEFT JOIN {name}_p USING ({cell}))"
    )


def engine(members: str, obs: str, similarity: str, k0: str, s0: float, fp: str, rounds: int = 200, name: str = "engine") -> str:
    """SQL of ``read_across`` with one neighbour of a class at least. ``similarity`` has (target, a, b, similarity); an empty name means that all are 1."""
    cell, e = "target, endpoint", name
    scores = (
        f"SELECT s.target, s.endpoint, s.id, any_value(s.obs) AS y, round(coalesce(sum(o.obs * p.similarity) / nullif(sum(p.similarity), 0), 0), 9) AS score FROM {e}_seen s "
        f"LEFT JOIN ({similarity} p JOIN {e}_seen o ON o.target = p.target AND o.id = p.b) ON p.target = s.target AND p.a = s.id AND o.endpoint = s.endpoint GROUP BY ALL"
        if similarity else
        f"SELECT s.target, s.endpoint, s.id, any_value(s.obs) AS y, round(coalesce(avg(o.obs), 0), 9) AS score FROM {e}_seen s LEFT JOIN {e}_seen o ON o.target = s.target AND o.endpoint = s.endpoint AND o.id <> s.id GROUP BY ALL"
    )
    won = f"SELECT a.target, a.endpoint, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS auc FROM {e}_loo a JOIN {e}_loo b ON a.target = b.target AND a.endpoint = b.endpoint AND a.y = 1 AND b.y = 0 GROUP BY ALL"
    balanced = "0.5 * ((1 - cn::DOUBLE / n_neg) + cp::DOUBLE / n_pos)"
    called = "CASE WHEN a_t = 1 THEN CASE WHEN a_p = 1 THEN 'TP' ELSE 'FN' END WHEN a_t = 0 THEN CASE WHEN a_p = 1 THEN 'FP' ELSE 'TN' END WHEN a_p = 1 THEN 'Pos' ELSE 'Neg' END"
    return (
        f"{e}_act AS (SELECT id, endpoint, max(obs) AS obs, max((obs = 1)::INTEGER) AS pos, max((obs = 0)::INTEGER) AS neg FROM {obs} GROUP BY ALL), "
        f"{e}_seen AS (SELECT target, endpoint, m.id, m.similarity, obs, pos, neg FROM {members} m JOIN {e}_act USING (id)), {e}_loo AS ({scores}), "
        f"{e}_sizes AS (SELECT {cell}, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg FROM {e}_loo GROUP BY ALL), {e}_auc AS ({won}), "
        f"{e}_at AS (SELECT {cell}, score, sum(y) AS p, sum(1 - y) AS n FROM {e}_loo GROUP BY ALL), "
        f"{e}_cum AS (SELECT {cell}, score, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM {e}_at WINDOW w AS (PARTITION BY {cell} ORDER BY score DESC)), "
        f"{e}_best AS (SELECT {cell}, score AS t0 FROM {e}_cum JOIN {e}_sizes USING ({cell}) WHERE n_pos > 0 AND n_neg > 0 AND score <= 1 QUALIFY row_number() OVER (PARTITION BY {cell} ORDER BY {balanced} DESC, score DESC) = 1), "
        + chance(f"{e}_loo", "score", "y", rounds, f"{e}_chance")
        + f", {e}_share AS (SELECT {cell}, round(sum(CASE WHEN id <> target THEN obs * similarity END) / nullif(sum(CASE WHEN id <> target THEN similarity END), 0), 9) AS share, "
        f"count(*) FILTER (id <> target AND pos = 1) AS posnb, count(*) FILTER (id <> target AND neg = 1) AS negnb, max(CASE WHEN id = target THEN obs END) AS a_t FROM {e}_seen GROUP BY ALL), "
        f"{e}_all AS (SELECT *, (share >= CASE WHEN p_val > 0.2 THEN 0.5 ELSE coalesce(t0, 0.5) END)::INTEGER AS a_p FROM {e}_share JOIN {e}_sizes USING ({cell}) JOIN {e}_chance USING ({cell}) "
        f"LEFT JOIN {e}_auc USING ({cell}) LEFT JOIN {e}_best USING ({cell}) WHERE share IS NOT NULL), {e}_called AS (SELECT *, {called} AS pred FROM {e}_all), "
        f"{e} AS (SELECT target, endpoint AS out, '{fp}' AS fp, {k0} AS k0, {s0}::DOUBLE AS s0, n_pos, n_neg, a_t::DOUBLE AS a_t, round_even(share, 3) AS a_s, a_p, round(coalesce(auc, 0), 6) AS auc, p_val, round(coalesce(t0, 0.5), 6) AS t0, pred "
        f"FROM {e}_called WHERE CASE WHEN pred IN ('Neg', 'TN', 'FN') THEN negnb >= 1 ELSE posnb >= 1 END)"
    )


class Tables:
    """The given tables and the roles derived from them, lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        ship(spark)
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """Rows over all cores where the files alone give fewer tasks, as one small file does."""
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

    @cached_property
    def sales(self) -> DataFrame:
        return (
            self.lineitem.join(self.orders, F.col("o_orderkey") == F.col("l_orderkey"))
            .join(self.part, F.col("p_partkey") == F.col("l_partkey"))
        )

    # Fingerprints are read several times by one search, so they are stored
    # once. The filter comes after that: before, it would be pushed under the
    # repartitioning and tokenise the whole table in the tasks of the scan.

    @cached_property
    def texts(self) -> DataFrame:
        return self.spread(self.documents.select(F.col("doc_id").alias("id"), "text"))

    @cached_property
    def word_lists(self) -> DataFrame:
        """(id, ds): distinct lower-case words of each document."""
        found = F.array_distinct(F.split(F.lower("text"), WORD_BREAK))
        return self.texts.select("id", F.sort_array(F.array_remove(found, "")).alias("ds")).persist().where(F.size("ds") > 0)

    @property
    def words(self) -> DataFrame:
        return self.word_lists.select("id", F.explode("ds").alias("bit"))

    @cached_property
    def word_bits(self) -> DataFrame:
        """(id, ds): words hashed into 2,048 positions."""
        tokens = F.array_remove(F.split(F.lower("text"), WORD_BREAK), "")
        return self.texts.select("id", hashed_positions(tokens).alias("ds")).persist().where(F.size("ds") > 0)

    @property
    def baskets(self) -> DataFrame:
        return self.sales.selectExpr("o_custkey AS id", "p_brand || ':' || p_type AS bit").distinct()

    @property
    def ranges(self) -> DataFrame:
        return self.sales.selectExpr("o_custkey AS id", "p_brand || ':' || p_size AS bit").distinct()

    @cached_property
    def basket_sets(self) -> DataFrame:
        return set_fingerprints(self.baskets).persist()

    @cached_property
    def range_sets(self) -> DataFrame:
        return set_fingerprints(self.ranges).persist()

    @property
    def entities(self) -> DataFrame:
        return self.customer.selectExpr(*ENTITY_COLUMNS)

    @property
    def effects(self) -> DataFrame:
        return self.sales.selectExpr(*EFFECT_COLUMNS)

    @property
    def dose_obs(self) -> DataFrame:
        return self.sales.selectExpr(*DOSE_COLUMNS)

    @property
    def label_obs(self) -> DataFrame:
        return self.labels.select(F.col("doc_id").alias("id"), "quality", "toxic").unpivot(
            ["id"], ["quality", "toxic"], "endpoint", "obs"
        )

    @property
    def labelled(self) -> DataFrame:
        return self.labels.select(F.col("doc_id").alias("id")).distinct()

    @property
    def returners(self) -> DataFrame:
        """Customers who returned a large line: the availability filter of baskets."""
        return (
            self.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
            .join(self.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("id")).distinct()
        )
