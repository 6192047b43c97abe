"""Property lookups and scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions.numbers import property_text


@dataclass(frozen=True)
class Property:
    prop_id: str
    name: str
    units: str = ""
    places: int = 2


def property_values(tables: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Tall (id, prop_id, value) of several tables; the first table that has a value wins."""
    tall = None
    for place, (table, columns) in enumerate(tables):
        entries = F.array(*(F.struct(F.lit(c).alias("prop_id"), F.col(c).cast("double").alias("value")) for c in columns))
        rows = table.select("id", F.explode(entries).alias("e")).select("id", "e.*", F.lit(place).alias("place"))
        tall = rows if tall is None else tall.unionByName(rows)
    return (
        tall.where(F.col("value").isNotNull()).groupBy("id", "prop_id")
        .agg(F.min(F.struct("place", "value"))["value"].alias("value"))
    )


def population_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 by the extremes of the whole table; a constant one becomes 0."""
    extremes = df.agg(*(f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.min, "lo"), (F.max, "hi"))))
    # one row
    return df.join(F.broadcast(extremes), F.lit(True)).withColumns(
        {
            c: F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_lo"), F.col(f"{c}_hi") - F.col(f"{c}_lo")), F.lit(0.0))
            for c in columns
        }
    ).select(*df.columns)


def scaled_within(df: DataFrame, keys: list[str], value: str, constant: float | None) -> Column:
    """Value scaled to 0..1 within its group."""
    w = W.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    scaled = F.try_divide(F.col(value) - lo, hi - lo)
    return scaled if constant is None else F.coalesce(scaled, F.when(F.col(value).isNotNull(), F.lit(constant)))


def neighbourhood_scaled(members: DataFrame, values: DataFrame) -> DataFrame:
    """(target, id, prop_id, value, scaled): each property within a neighbourhood, 0.5 where constant."""
    rows = members.select("target", "id").join(values, "id")
    return rows.withColumn("scaled", scaled_within(rows, ["target", "prop_id"], "value", 0.5)).select(
        "target", "id", "prop_id", "value", "scaled"
    )


def heat_scaled(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(target, id, fp_id, n, scaled): fingerprint sizes within a neighbourhood, 0 where constant, 4 places."""
    rows = members.select("target", "id").join(sizes, "id")
    return rows.withColumn("scaled", F.bround(scaled_within(rows, ["target", "fp_id"], "n", 0.0), 4)).select(
        "target", "id", "fp_id", "n", "scaled"
    )


def property_table(members: DataFrame, values: DataFrame, catalogue: list[Property]) -> DataFrame:
    """(target, id, place, prop_id, label, text): catalogue order, N/A where absent, units in the label.

    Properties that no member of the neighbourhood has are left out.
    """
    listed = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(i).alias("place"), F.lit(p.prop_id).alias("prop_id"),
                    F.lit(f"{p.name} ({p.units})" if p.units else p.name).alias("label"),
                )
                for i, p in enumerate(catalogue)
            )
        )
    )
    text = None
    for p in catalogue:
        shown = property_text(F.col("value"), p.places)
        text = F.when(F.col("prop_id") == p.prop_id, shown) if text is None else text.when(F.col("prop_id") == p.prop_id, shown)
    known = members.select("target", "id").join(values, "id")
    found = known.select("target", "prop_id").distinct()
    return (
        members.select("target", "id", listed.alias("p")).select("target", "id", "p.*")
        .join(found, ["target", "prop_id"], "left_semi")
        .join(known, ["target", "id", "prop_id"], "left")
        .select("target", "id", "place", "prop_id", "label", F.coalesce(text, F.lit("N/A")).alias("text"))
    )
