"""Running totals, medians and bounded lists that also hold for one huge group.

A window over a key runs in one task per key. Here rows are first reduced to
distinct values, then split by value range, so a key with a third of all rows
spreads over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.session import cut_lineage

#: Ranges of a key's distinct values, and the inverse of the error of their bounds.
RANGES, ACCURACY = 256, 10_000


def running_totals(
    df: DataFrame, keys: list[str], value: str, totals: list[str], descending: bool = False
) -> DataFrame:
    """One row per (keys, value) with the totals of it and, as ``cum_*``, up to it.

    Ranges hold about equally many of a key's distinct values wherever those lie.
    """
    rows = df.groupBy(*keys, value).agg(*(F.sum(c).alias(c) for c in totals))
    cuts = F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], ACCURACY)
    bounds = rows.groupBy(*keys).agg(F.array_distinct(cuts).alias("_cuts"))
    place = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    rows = rows.join(bounds, keys).withColumn("_range", F.greatest(F.coalesce(place, F.lit(0)), F.lit(0))).drop("_cuts")
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    before = W.partitionBy(*keys).orderBy(order("_range")).rowsBetween(W.unboundedPreceding, -1)
    # at most RANGES rows per key
    offsets = (
        rows.groupBy(*keys, "_range")
        .agg(*(F.sum(c).alias(f"_{c}") for c in totals))
        .select(*keys, "_range", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in totals))
    )
    within = W.partitionBy(*keys, "_range").orderBy(order(value)).rowsBetween(W.unboundedPreceding, 0)
    return rows.join(offsets, [*keys, "_range"]).select(
        *keys, value, *totals, *((F.col(f"_{c}") + F.sum(c).over(within)).alias(f"cum_{c}") for c in totals)
    )


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``position``: the row's place from 0 in the order of the columns, which should tell rows apart.

    Rows are dealt out by ranges of the order; a place is the one in its range after the sizes of the ranges
    before, so neither the driver nor one task sees all rows.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}))
    # one row for each range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))
    return dealt.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_place")).alias("position"))


def exact_median(df: DataFrame, keys: list[str], value: str, name: str, large: int = 1_000_000) -> DataFrame:
    """(keys, name): the built-in median for ordinary groups, running totals for those over ``large`` rows."""
    known = df.where(F.col(value).isNotNull()).select(*keys, value)
    big = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > large)
    small = known.join(big, keys, "left_anti").groupBy(*keys).agg(F.median(value).alias(name))
    counted = known.join(big.drop("_size"), keys, "left_semi").withColumn("_n", F.lit(1))
    at_or_above = lambda rank: F.min(F.when(F.col("cum__n") >= rank, F.col(value)))
    lower, upper = F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1
    split = (
        running_totals(counted, keys, value, ["_n"]).join(big, keys).groupBy(*keys)
        .agg(((at_or_above(lower) + at_or_above(upper)) / 2).alias(name))
    )
    return small.unionByName(split)


def bounded_lists(
    df: DataFrame, keys: list[str], record: list[str], name: str, limit: int = 10_000
) -> DataFrame:
    """Records of each key as sorted lists of about ``limit``, all kept, numbered by ``part``.

    A key with more records than that has several parts, dealt to tasks of their own. Equal records
    are counted before they are sent, and come back as often as they were, in several parts if they fill more than one.
    """
    counted = df.groupBy(*keys, *record).agg(F.count(F.lit(1)).alias("_n"))
    sizes = counted.groupBy(*keys).agg(F.ceil(F.sum("_n") / limit).alias("_parts"))
    split = (
        counted.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / limit) - 1)))
        .withColumn("_n", F.least(F.lit(limit).cast("long"), F.col("_n") - F.col("_copy") * limit))
    )
    dealt = split.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64(*record, "_copy"), F.col("_parts")))
    # the join leaves a key in one place, so its parts are dealt out anew
    lists = dealt.repartition(*keys, "part").groupBy(*keys, "part").agg(
        F.sort_array(F.collect_list(F.struct(F.struct(*record).alias("r"), F.col("_n").cast("int").alias("n")))).alias(name)
    )
    return lists.withColumn(name, F.flatten(F.transform(name, lambda x: F.array_repeat(x["r"], x["n"]))))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))
