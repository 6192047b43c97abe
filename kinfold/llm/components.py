"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import cut_lineage, release


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in the links (a, b): the least id that links lead to.

    Alternating large and small stars: each id hands its least neighbour to its
    larger, then to its smaller neighbours, until nothing changes; rounds grow with the
    logarithm of a component's size. Ids and links stay in tables; an empty table gives no rows.
    """
    links = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda x: tuple(x.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2**31)))).first())
    before = state(links)
    while before[0]:
        least = _both(links).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _both(links).join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        links = cut_lineage(small)
        del large, least, small
        after = state(release(links))
        if after == before:
            break
        before = after
    found = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.unionAll(found.select(F.col("component").alias("id"), "component").distinct())
