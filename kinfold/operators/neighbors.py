"""Neighbour search, stored neighbour tables and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.text import placeholder_name
from kinfold.operators.block_search import Part, by_sets, pack, top_matches
from kinfold.session import cut_lineage

STORED = 100
#: Metadata of a stored table's rank column: the k it was built with.
DEPTH = "depth"


def parse_blend(spec: str) -> list[tuple[str, float]]:
    """``a_W2_and_b_W1`` as [(a, 2), (b, 1)]; parts of weight 0 are dropped."""
    found = []
    for piece in spec.split("_and_"):
        name, mark, weight = piece.rpartition("_W")
        found.append((name, float(weight)) if mark else (piece, 1.0))
    return [(name, weight) for name, weight in found if weight > 0]


def effective_threshold(s0: float, cutoffs: list[float | None]) -> float:
    """A single fingerprint may lower the threshold, never raise it."""
    return min(s0, cutoffs[0]) if len(cutoffs) == 1 and cutoffs[0] is not None else s0


def available(fingerprints: DataFrame, holders: DataFrame) -> DataFrame:
    """Fingerprints of the entities that occur in ``holders(id)``."""
    return fingerprints.join(holders.select("id").distinct(), "id", "left_semi")


def tie_keys(fingerprints: DataFrame, quality: DataFrame | None, names: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """Columns that order equal similarities: more outcomes first, then name."""
    order = []
    if quality is not None:
        counts = quality.select("id", F.col("n").cast("long").alias("_n"))
        fingerprints = fingerprints.join(counts, "id", "left").withColumn("tie_data", -F.coalesce("_n", F.lit(0))).drop("_n")
        order.append("tie_data")
    if names is not None:
        fingerprints = fingerprints.join(names.select("id", "name"), "id", "left").withColumn(
            "tie_name", placeholder_name(F.col("name"))
        ).drop("name")
        order.append("tie_name")
    return fingerprints, order


def _packed(fingerprints: DataFrame, parts: list[Part]) -> tuple[DataFrame, dict | None]:
    """Fingerprints with packed sets, so that joins before a search move little."""
    known = fingerprints.select("id", *(p.column for p in parts))
    if not by_sets(parts):
        return known, None
    (known,), words = pack([known], parts)
    # both sides of a search read them, some parts of it twice; packed they are small
    return known.persist(), words


def nearest(
    targets: DataFrame,
    fingerprints: DataFrame,
    parts: list[Part],
    k0: int,
    s0: float = 0.0,
    holders: DataFrame | None = None,
    quality: DataFrame | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """(target, rank, id, similarity): each target itself at rank 1, then its k0 - 1 nearest.

    ``targets`` has (id); ``fingerprints`` id and the columns of the parts.
    """
    known, words = _packed(fingerprints, parts)
    # a join of a table with itself would move it for nothing
    wanted = known.where("id IS NOT NULL") if targets is fingerprints else known.join(targets.select("id").distinct(), "id", "left_semi")
    pool = known if holders is None else available(known, holders)
    pool, order = tie_keys(pool, quality, names)
    found = top_matches(wanted, pool, parts, k0 - 1, order=order, floor=s0, words=words)
    others = found.select(
        F.col("id").alias("target"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("nn_id").alias("id"), "similarity"
    )
    itself = wanted.select(F.col("id").alias("target"), F.lit(1).alias("rank"), "id", F.lit(1.0).alias("similarity"))
    return itself.unionByName(others)


def neighbor_table(
    fingerprints: DataFrame,
    parts: list[Part],
    fp_id: str,
    sel_by: str,
    holders: DataFrame | None = None,
    quality: DataFrame | None = None,
    k: int = STORED,
) -> DataFrame:
    """The stored table: (fp_id, sel_by, id, rank, nn_id, similarity), self left out."""
    known, words = _packed(fingerprints, parts)
    pool = known if holders is None else available(known, holders)
    pool, order = tie_keys(pool, quality, None)
    return top_matches(known, pool, parts, k, order=order, words=words).select(
        F.lit(fp_id).alias("fp_id"), F.lit(sel_by).alias("sel_by"), "id", F.col("rank").cast("int").alias("rank", metadata={DEPTH: k}),
        "nn_id", F.round("similarity", 10).alias("similarity"),
    )


def table_depth(table: DataFrame, depth: int | None = None) -> int:
    """The k that a stored table was built with: as given, or as its rank column says, also after it was written to Parquet and read."""
    depth = depth or table.schema["rank"].metadata.get(DEPTH)
    if not depth:
        raise ValueError("the table does not say how many neighbours it was built with; give its depth")
    return depth


def neighbor_stats(table: DataFrame) -> DataFrame:
    """(id, fp_id, sel_by, n, max_s0): neighbours with a positive similarity and the best of them."""
    return table.groupBy("id", "fp_id", "sel_by").agg(
        F.count_if(F.col("similarity") > 0).alias("n"), F.max("similarity").alias("max_s0")
    )


def stored_lookup(
    targets: DataFrame, table: DataFrame, k0: int, s0: float, depth: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(hits, missing): stored neighbours, and the targets that must be computed instead.

    ``depth`` is the k that the table was built with; a table from ``neighbor_table`` knows it. A list
    that is shorter is complete; a full list is no answer to a larger k0.
    """
    depth = table_depth(table, depth)
    stored = table.join(targets.select("id").distinct(), "id", "left_semi")
    if k0 > depth:
        complete = stored.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < depth).select("id")
        stored = stored.join(complete, "id", "left_semi")
    hits = stored.where((F.col("rank") <= k0) & (F.col("similarity") > 0) & (F.col("similarity") >= s0))
    return hits, targets.join(stored.select("id").distinct(), "id", "left_anti")


def lookup_or_compute(
    targets: DataFrame, table: DataFrame, fingerprints: DataFrame, parts: list[Part], k0: int, s0: float, depth: int | None = None
) -> DataFrame:
    """(id, rank, nn_id, similarity): stored neighbours where they suffice, computed ones for the other targets."""
    hits, missing = stored_lookup(targets, table, k0, s0, depth)
    wanted = fingerprints.join(missing.select("id").distinct(), "id", "left_semi")
    computed = nearest(wanted, fingerprints, parts, k0 + 1, s0).where(F.col("rank") > 1)
    return hits.select("id", F.col("rank").cast("int").alias("rank"), "nn_id", "similarity").unionByName(
        computed.select(F.col("target").alias("id"), (F.col("rank") - 1).cast("int").alias("rank"), F.col("id").alias("nn_id"), "similarity")
    )


def fallback_filter(targets: DataFrame, stats: DataFrame, fp_id: str, sel_by: str, s0: float) -> DataFrame:
    """(id, effective_sel_by, switched): no_filter where only it has a neighbour at s0."""
    usable = (
        stats.where((F.col("fp_id") == fp_id) & F.col("sel_by").isin(sel_by, "no_filter"))
        .where((F.col("n") > 0) & (F.col("max_s0") >= s0))
        .groupBy("id")
        .agg(F.bool_or(F.col("sel_by") == sel_by).alias("chosen"), F.bool_or(F.col("sel_by") == "no_filter").alias("open"))
    )
    switched = ~F.coalesce("chosen", F.lit(False)) & F.coalesce("open", F.lit(False))
    return targets.join(usable, "id", "left").select(
        "id", F.when(switched, "no_filter").otherwise(sel_by).alias("effective_sel_by"), switched.alias("switched")
    )


def blend_lists(lists: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(id, nn_id, similarity): weighted mean over fp_id; a list without the neighbour counts 0."""
    pairs = [x for fp, w in weights.items() for x in (F.lit(fp), F.lit(float(w)))]
    weight = F.try_element_at(F.create_map(*pairs), F.col("fp_id"))
    total = sum(weights.values())
    return (
        lists.where(F.col("fp_id").isin(*weights))
        .groupBy("id", "nn_id")
        .agg((F.sum(weight * F.col("similarity")) / total).alias("similarity"))
    )


def coverage(table: DataFrame, filters: list[str]) -> DataFrame:
    """Entities present and populated per fingerprint, one pair of columns per filter."""
    return (
        neighbor_stats(table).groupBy("fp_id").pivot("sel_by", filters)
        .agg(F.count(F.lit(1)).alias("present"), F.count_if(F.col("n") > 0).alias("populated"))
        .fillna(0)
    )


def mean_similarity(table: DataFrame, first: int = 15) -> DataFrame:
    return table.where(F.col("rank") <= first).groupBy("fp_id").agg(F.avg("similarity").alias("mean_similarity"))


def expand_graph(
    targets: DataFrame, table: DataFrame, steps: int, k0: int, s0: float, out_only: bool = False, depth: int | None = None
) -> DataFrame:
    """Edges (target, fp_id, step, src, dst, similarity) within ``steps`` levels of each target.

    A node follows its first k0 stored neighbours, k0 + 1 unless it is the
    target. An edge is used once in either direction; with ``out_only`` each
    node keeps its first incoming edge. ``table`` holds one filter. First means
    lowest source id, then rank. ``depth`` is the k that the table was built with, if the table does not know it;
    a table too shallow for k0 + 1 would cut the graph unseen and is refused.
    """
    depth = table_depth(table, depth)
    if k0 + 1 > depth:
        raise ValueError(f"the table holds {depth} neighbours, {k0 + 1} are needed")
    near = table.where((F.col("rank") <= k0 + 1) & (F.col("similarity") >= s0)).select(
        "fp_id", F.col("id").alias("src"), F.col("rank"), F.col("nn_id").alias("dst"), "similarity"
    )
    frontier = targets.select(F.col("id").alias("target"), F.col("id").alias("src")).distinct()
    edge, entry = ["target", "fp_id", "low", "high"], ["target", "fp_id", "dst"]
    earliest = lambda keys: F.row_number().over(W.partitionBy(*keys).orderBy("src", "rank"))
    edges = None
    for step in range(1, steps + 1):
        on = ["src"] if step == 1 else ["fp_id", "src"]
        found = frontier.join(near, on).where((F.col("rank") <= k0) | (F.col("src") != F.col("target")))
        found = found.withColumn("low", F.least("src", "dst")).withColumn("high", F.greatest("src", "dst"))
        if edges is not None:
            found = found.join(edges.select(*edge), edge, "left_anti")
        found = found.withColumn("_r", earliest(edge)).where("_r = 1").withColumn("used", F.lit(True))
        if out_only:
            found = found.withColumn("used", earliest(entry) == 1)
            if edges is not None:
                entered = edges.where("used").select(*entry).distinct().withColumn("_in", F.lit(True))
                found = found.join(entered, entry, "left").withColumn("used", F.col("used") & F.col("_in").isNull())
        found = found.withColumn("step", F.lit(step)).select(*edge, "step", "src", "dst", "similarity", "used")
        found = cut_lineage(found)
        edges = found if edges is None else edges.unionByName(found)
        frontier = found.where("used").select("target", "fp_id", F.col("dst").alias("src")).distinct()
    return edges.where("used").select(
        "target", "fp_id", "step", "src", "dst", F.bround("similarity", 3).alias("similarity")
    )


def graph_nodes(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(target, id, name, expanded, is_target): nodes followed further, and the leaves."""
    ends = edges.select("target", F.col("src").alias("id"), F.lit(True).alias("expanded")).unionByName(
        edges.select("target", F.col("dst").alias("id"), F.lit(False).alias("expanded"))
    )
    return (
        ends.groupBy("target", "id").agg(F.bool_or("expanded").alias("expanded"))
        .join(entities.select("id", "name"), "id", "left")
        .select("target", "id", "name", "expanded", (F.col("id") == F.col("target")).alias("is_target"))
    )


def neighbourhood_facts(members: DataFrame, fingerprints: DataFrame, metadata: DataFrame) -> DataFrame:
    """Members with each of their features that the metadata (feature, background) knows and does not call background.

    Feature names meet whatever their case.
    """
    known = metadata.where(~F.col("background")).select(F.lower("feature").alias("_key")).distinct()
    facts = members.join(fingerprints.select("id", F.explode("ds").alias("bit")), "id")
    return facts.join(known, F.lower("bit") == F.col("_key")).drop("_key")
