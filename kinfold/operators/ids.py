"""Identifier resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import id_key, id_kind, promoted_id

ID_FIELDS = ["cid", "sid", "casrn", "smiles", "name"]


def with_promoted_id(entities: DataFrame) -> DataFrame:
    return entities.withColumn("chem_id", promoted_id(*(F.col(c) for c in ID_FIELDS)))


def id_index(entities: DataFrame) -> DataFrame:
    """(kind, key, field, chem_id): one row per id an entity can be asked for by.

    A text that is a name may also be a stored structure.
    """
    kinds = {"cid": "cid", "sid": "sid", "casrn": "casrn", "name": "name", "smiles": "name"}
    entries = F.array(
        *(
            F.struct(F.lit(kind).alias("kind"), F.col(field).alias("key"), F.lit(place).alias("field"))
            for place, (field, kind) in enumerate(kinds.items())
        )
    )
    return (
        with_promoted_id(entities).select("chem_id", F.explode(entries).alias("e"))
        .select("chem_id", "e.kind", "e.key", "e.field").where(F.coalesce("key", F.lit("")) != "")
    )


def resolve(texts: DataFrame, entities: DataFrame, text: str = "text") -> DataFrame:
    """(text, kind, chem_id): distinct texts with their master record, null where unknown."""
    asked = texts.select(text).distinct().withColumn("kind", id_kind(F.col(text))).withColumn("key", id_key(F.col(text)))
    best = (
        id_index(entities).groupBy("kind", "key").agg(F.min(F.struct("field", "chem_id")).alias("best"))
        .select("kind", "key", F.col("best.chem_id").alias("chem_id"))
    )
    return asked.join(best, ["kind", "key"], "left").select(text, "kind", "chem_id")


def clean_lists(lists: DataFrame, entities: DataFrame) -> DataFrame:
    """(list_id, ids): trimmed, promoted, unknown names and duplicates dropped, order kept.

    Lists are comma texts typed by a user, so one list stays small.
    """
    pieces = lists.select("list_id", F.posexplode(F.split("ids", ",")).alias("pos", "text")).withColumn("text", F.trim("text"))
    known = resolve(pieces, entities).withColumn(
        "chem_id", F.coalesce("chem_id", F.when(F.col("kind") != "name", id_key(F.col("text"))))
    )
    return (
        pieces.join(known.where(F.col("chem_id").isNotNull() & (id_kind(F.col("chem_id")) != "name")), "text")
        .groupBy("list_id", "chem_id").agg(F.min("pos").alias("pos"))
        .groupBy("list_id")
        .agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("pos", "chem_id"))), lambda e: e["chem_id"])).alias("ids"))
    )


def refresh_metadata(table: DataFrame, entities: DataFrame, fields: list[str]) -> DataFrame:
    """Copy master fields into a table with sid and cid, by sid first, then by cid.

    Rows that no master record matches keep their values.
    """
    out = table
    for key in ("sid", "cid"):
        other = "cid" if key == "sid" else "sid"
        copied = [*fields, other]
        master = entities.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*copied)).alias("m"))
        out = out.join(master, key, "left").withColumns({c: F.coalesce(F.col(f"m.{c}"), F.col(c)) for c in copied}).drop("m")
    return out.select(*table.columns)


def unify_ids(table: DataFrame, entities: DataFrame) -> DataFrame:
    """Fill a missing cid from the sid and the reverse; refresh names by pair, then sid, then cid."""
    def lookup(keys: list[str], value: str, name: str) -> DataFrame:
        known = entities
        for k in keys:
            known = known.where(F.col(k).isNotNull())
        return known.groupBy(*keys).agg(F.min(value).alias(name))

    out = table.join(lookup(["sid"], "cid", "_cid"), "sid", "left").withColumn("cid", F.coalesce("cid", "_cid")).drop("_cid")
    out = out.join(lookup(["cid"], "sid", "_sid"), "cid", "left").withColumn("sid", F.coalesce("sid", "_sid")).drop("_sid")
    for i, keys in enumerate((["sid", "cid"], ["sid"], ["cid"])):
        out = out.join(lookup(keys, "name", f"_name{i}"), keys, "left")
    return out.withColumn("name", F.coalesce("_name0", "_name1", "_name2", "name")).select(*table.columns)
