"""Ranked name search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.text import any_of, id_key, id_kind, match_score

MAX_HITS = 100
SHORTEST = 3


def text_matches(text: Column, name: Column, synonyms: Column, smiles: Column) -> Column:
    """Name starts with the text or a synonym contains it, whatever the case, or the structure equals it."""
    low = F.lower(text)
    return (
        F.startswith(F.lower(name), low)
        | F.coalesce(F.exists(synonyms, lambda s: F.contains(F.lower(s), low)), F.lit(False))
        | F.coalesce(smiles == text, F.lit(False))
    )


def prefix_listing(entities: DataFrame, prefix: str) -> DataFrame:
    """(id, text): names and synonyms that start with the prefix."""
    texts = F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    return (
        entities.select("id", F.explode(F.array_distinct(texts)).alias("text"))
        .where(F.startswith(F.lower("text"), F.lit(prefix.lower())))
    )


def ranked_search(entities: DataFrame, texts: list[str], hits: int = MAX_HITS) -> DataFrame:
    """(query, rank, id, sid, name, grade, unmatched) for each text of at least 3 characters.

    Names are matched by text; an id or registry number must equal the
    entity's cid, sid or casrn. Score is the best over name and synonyms; of the
    first ``hits`` duplicates are dropped and records with a sid come first.
    """
    asked = [t for t in texts if len(t) >= SHORTEST]
    names = F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    # one pass over the entities whatever the number of texts
    queries = F.array(*(F.lit(t) for t in asked)) if asked else F.array().cast("array<string>")
    id_fields = [c for c in ("cid", "sid", "casrn") if c in entities.columns]

    def matches(q: Column) -> Column:
        kind = id_kind(q)
        same_id = [(kind == c) & F.coalesce(F.col(c) == id_key(q), F.lit(False)) for c in id_fields]
        return F.when(kind == "name", text_matches(q, F.col("name"), F.col("synonyms"), F.col("smiles"))).otherwise(any_of([F.lit(False), *same_id]))

    matching = F.filter(queries, matches)
    found = entities.select("id", "sid", "name", names.alias("names"), F.explode(matching).alias("query"))
    scored = found.withColumn(
        "score", F.array_min(F.transform("names", lambda n: match_score(n, F.lower("query"))))
    ).select("query", "id", "sid", "name", "score")
    best = W.partitionBy("query").orderBy("score", "id")
    kept = scored.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= hits)
    kept = kept.dropDuplicates(["query", "id", "sid", "name"])
    final = W.partitionBy("query").orderBy(F.col("sid").isNull(), "_r")
    return kept.select(
        "query", F.row_number().over(final).alias("rank"), "id", "sid", "name",
        F.col("score.grade").alias("grade"), F.col("score.unmatched").alias("unmatched"),
    )
