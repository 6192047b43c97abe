"""Comparison and audit of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def census(df: DataFrame, statuses: dict[str, Column]) -> DataFrame:
    """(status, n): rows per named predicate, rows no predicate accounts for, and all, in one pass."""
    flags = {n: F.coalesce(c, F.lit(False)) for n, c in statuses.items()}
    unaccounted = ~reduce(lambda a, b: a | b, flags.values())
    counted = df.agg(
        *(F.count_if(c).alias(n) for n, c in flags.items()), F.count_if(unaccounted).alias("unaccounted"), F.count(F.lit(1)).alias("total")
    )
    return counted.unpivot([], [*flags, "unaccounted", "total"], "status", "n")


def failing_rows(df: DataFrame, statuses: dict[str, Column]) -> DataFrame:
    return df.where(~reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in statuses.values())))


def sample_ids(old: DataFrame, new: DataFrame, n: int = 1000, seed: int = 1) -> DataFrame:
    """n ids found in both tables, the same ones for the same seed."""
    common = old.select("id").distinct().join(new, "id", "left_semi")
    return common.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(n)


def id_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, status) with status added, removed or common."""
    a = old.select("id").distinct().withColumn("in_old", F.lit(True))
    b = new.select("id").distinct().withColumn("in_new", F.lit(True))
    return a.join(b, "id", "full").select(
        "id", F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("common").alias("status")
    )


def feature_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, missing, added, removed) for entities of either table; missing names the side without a fingerprint."""
    a, b = old.select("id", F.col("ds").alias("a")), new.select("id", F.col("ds").alias("b"))
    return a.join(b, "id", "full").select(
        "id",
        F.when(F.col("a").isNull(), "old").when(F.col("b").isNull(), "new").alias("missing"),
        F.sort_array(F.array_except("b", "a")).alias("added"), F.sort_array(F.array_except("a", "b")).alias("removed"),
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.agg(
        F.count_if(F.size("added") > 0).alias("with_additions"), F.count_if(F.size("removed") > 0).alias("with_removals"),
        F.count_if(F.col("missing").isNotNull()).alias("without_fingerprint"), F.count(F.lit(1)).alias("entities"),
    )


def field_audit(df: DataFrame, required: list[str]) -> DataFrame:
    """(field, null_count, absent_column) per required field."""
    present = [c for c in required if c in df.columns]
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in present), F.count(F.lit(1)).alias("_all"))
    for c in required:
        if c not in present:
            counts = counts.withColumn(c, F.col("_all"))
    absent = F.col("field").isin(*(c for c in required if c not in present)) if len(present) < len(required) else F.lit(False)
    return counts.unpivot([], required, "field", "null_count").withColumn("absent_column", absent)


def rows_lacking(df: DataFrame, required: list[str]) -> DataFrame:
    """(field, id): the rows a field is null in."""
    lacking = F.array(*(F.when(F.col(c).isNull(), c) for c in required))
    return df.select("id", F.explode(F.array_compact(lacking)).alias("field"))


def value_set_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(set, n): sizes of two one-column value sets, their union, intersection and differences."""
    marks = a.toDF("v").withColumn("in_a", F.lit(1)).withColumn("in_b", F.lit(0)).unionByName(
        b.toDF("v").withColumn("in_a", F.lit(0)).withColumn("in_b", F.lit(1))
    )
    per_value = marks.where(F.col("v").isNotNull()).groupBy("v").agg(F.max("in_a").alias("a"), F.max("in_b").alias("b"))
    sizes = per_value.agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.count(F.lit(1)).alias("union"), F.sum(F.col("a") * F.col("b")).alias("both"),
        F.sum(F.col("a") * (1 - F.col("b"))).alias("a_only"), F.sum((1 - F.col("a")) * F.col("b")).alias("b_only"),
    )
    return sizes.unpivot([], ["a", "b", "union", "both", "a_only", "b_only"], "set", "n")


def id_presence(df: DataFrame, first: str, second: str) -> DataFrame:
    a, b = F.col(first).isNotNull(), F.col(second).isNotNull()
    return df.agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias(f"only_{first}"), F.count_if(~a & b).alias(f"only_{second}"),
        F.count_if(~a & ~b).alias("neither"),
    )


def row_count_report(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """(table, old_rows, new_rows, same) of same-named tables."""
    rows = None
    for side, tables in (("old_rows", old), ("new_rows", new)):
        for name, df in tables.items():
            one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), F.lit(side).alias("side"), "n")
            rows = one if rows is None else rows.unionByName(one)
    wide = rows.groupBy("table").pivot("side", ["old_rows", "new_rows"]).agg(F.max("n"))
    return wide.withColumn("same", F.col("old_rows").eqNullSafe(F.col("new_rows")))


def record_differences(old: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    """Records of the given ids that only one side has, with multiplicity."""
    a, b = old.join(ids, "id", "left_semi"), new.join(ids, "id", "left_semi").select(*old.columns)
    return a.exceptAll(b).withColumn("only_in", F.lit("old")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("new")))


def rename_filters(table: DataFrame, names: dict[str, str]) -> DataFrame:
    return table.replace(names, subset=["sel_by"])


def freshness(upstream: DataFrame, generated: DataFrame, calculated: DataFrame, filters: list[str], default: str) -> DataFrame:
    """(fp_id, sel_by, fp_status, nn_status) from yyyyMMdd dates.

    ``upstream`` and ``generated`` have (fp_id, date), ``calculated`` (fp_id,
    sel_by, date). A pair without a neighbour calculation gets the default date.
    """
    when = lambda df, name: df.select("fp_id", F.to_date("date", "yyyyMMdd").alias(name))
    pairs = when(upstream, "up").join(when(generated, "gen"), "fp_id").withColumn(
        "sel_by", F.explode(F.array(*(F.lit(f) for f in filters)))
    )
    calc = calculated.select("fp_id", "sel_by", F.to_date("date", "yyyyMMdd").alias("calc"))
    rows = pairs.join(calc, ["fp_id", "sel_by"], "left").withColumn(
        "calc", F.coalesce("calc", F.to_date(F.lit(default), "yyyyMMdd"))
    )
    status = lambda made: F.when(F.col(made) >= F.col("up"), "OK").otherwise("OUTDATED")
    return rows.select("fp_id", "sel_by", status("gen").alias("fp_status"), status("calc").alias("nn_status"))
