"""Sinks and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.distribution import numbered


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Projection with new names; ``names`` maps each new name to its source."""
    return df.select(*(F.col(old).alias(new) for new, old in names.items()))


def project_and_write(df: DataFrame, names: dict[str, str], path: str) -> None:
    """Whole table with renamed columns, replacing the output."""
    renamed(df, names).write.mode("overwrite").parquet(path)


def replace_rows(base: DataFrame, new: DataFrame, key: str = "id", everything: bool = False) -> DataFrame:
    """Rows of the ids in ``new`` replaced, or all of them."""
    if everything:
        return new
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def write_neighbors(table: DataFrame, path: str) -> None:
    """Neighbour table, replacing only the (fp_id, sel_by) partitions it contains."""
    (
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("fp_id", "sel_by").parquet(path)
    )


def json_lines(df: DataFrame, where: Column) -> DataFrame:
    """(value): a table's filtered rows as JSON texts."""
    return df.where(where).select(F.to_json(F.struct("*")).alias("value"))


def export_tables(tables: dict[str, tuple[DataFrame, Column]], folder: str) -> None:
    """Each table's filtered rows as compressed JSON lines."""
    for name, (df, where) in tables.items():
        json_lines(df, where).write.mode("overwrite").option("compression", "gzip").text(f"{folder}/{name}")


def wide_grid(
    grid: DataFrame, members: DataFrame, size: int, exports: dict[str, list[Column]], properties: DataFrame | None = None
) -> DataFrame:
    """(target, section, name, one column per rank and export): the grid of each target.

    Columns are ``<rank>_<export>``, the first non-null source of an export is
    shown. Header rows with role, id and similarity come first, then properties
    (target, id, name, text), then endpoints. ``size`` is at most a stored
    neighbourhood.
    """
    role = F.when(F.col("id") == F.col("target"), "target").otherwise("analog")
    head = F.array(
        F.struct(F.lit("role").alias("name"), role.alias("text")),
        F.struct(F.lit("id").alias("name"), F.col("id").cast("string").alias("text")),
        F.struct(F.lit("similarity").alias("name"), F.format_string("%.4f", F.bround("similarity", 4)).alias("text")),
    )
    main = next(iter(exports))
    rank = members.select("target", "id", "rank")
    rows = members.select("target", "rank", F.explode(head).alias("h")).select(
        "target", "rank", F.lit("1 header").alias("section"), F.col("h.name").alias("name"), F.col("h.text").alias(main)
    )
    if properties is not None:
        shown = properties.join(rank, ["target", "id"])
        rows = rows.unionByName(
            shown.select("target", "rank", F.lit("2 property").alias("section"), "name", F.col("text").alias(main)), allowMissingColumns=True
        )
    cells = grid.join(rank, ["target", "id"]).select(
        "target", "rank", F.lit("3 endpoint").alias("section"), F.col("endpoint").alias("name"),
        *(F.coalesce(*(s.cast("string") for s in sources)).alias(n) for n, sources in exports.items()),
    )
    rows = rows.unionByName(cells, allowMissingColumns=True)
    # one row per rank of a neighbourhood
    by_rank = F.map_from_entries(F.collect_list(F.struct("rank", F.struct(*exports))))
    return rows.groupBy("target", "section", "name").agg(by_rank.alias("m")).select(
        "target", "section", "name",
        *(F.try_element_at("m", F.lit(r))[n].alias(f"{r}_{n}") for r in range(1, size + 1) for n in exports),
    )


def neighbour_bits(members: DataFrame, fingerprints: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(target, rank, id, ds, bits): neighbours with their features and 0/1 text over a vocabulary (bit) of any size.

    Each feature's place in the text comes from a table of places; an entity's text is written from its own places.
    """
    names = numbered(vocabulary.select("bit").distinct(), ["bit"])
    size = names.count()
    shown = fingerprints.join(members.select("id").distinct(), "id", "left_semi").select("id", "ds")
    placed = shown.select("id", F.explode(F.array_distinct("ds")).alias("bit")).join(names, "bit")
    places = placed.groupBy("id").agg(F.sort_array(F.collect_list(F.col("position").cast("int"))).alias("at"))
    before = F.concat(F.array(F.lit(-1)), F.slice("at", 1, F.size("at") - 1))
    gaps = F.zip_with(before, "at", lambda a, b: F.concat(F.repeat(F.lit("0"), b - a - 1), F.lit("1")))
    text = F.concat(F.array_join(gaps, ""), F.repeat(F.lit("0"), size - 1 - F.element_at("at", -1)))
    texts = shown.join(places, "id", "left").select("id", "ds", F.coalesce(text, F.repeat(F.lit("0"), F.lit(size))).alias("bits"))
    return members.join(texts, "id").select("target", "rank", "id", "ds", "bits")


def neighbour_values(members: DataFrame, numeric: DataFrame) -> DataFrame:
    """Neighbours with the values of a numeric fingerprint, one column each."""
    return members.join(numeric, "id").select("target", "rank", *numeric.columns)


def bit_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """One 0/1 column per bit beside the bit text."""
    return rows.select("*", *(F.substring("bits", i + 1, 1).cast("int").alias(n) for i, n in enumerate(names)))


def export_metadata(members: DataFrame, parameters: dict[str, tuple[str, str]], columns: dict[str, str]) -> DataFrame:
    """(kind, name, value, description): request parameters, exported columns, and the size of the export."""
    spark = members.sparkSession
    rows = [("parameter", n, v, d) for n, (v, d) in parameters.items()]
    rows += [("column", n, None, d) for n, d in columns.items()]
    fixed = spark.createDataFrame(rows, "kind string, name string, value string, description string")
    size = members.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        F.lit("parameter").alias("kind"), F.lit("rows").alias("name"), "value", F.lit("Exported entities").alias("description")
    )
    return fixed.unionByName(size)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def closed_sample(targets: DataFrame, table: DataFrame) -> DataFrame:
    """(id): chosen targets and all their neighbours over every fingerprint of the table."""
    chosen = targets.select("id").distinct()
    near = table.join(chosen, "id", "left_semi").select(F.col("nn_id").alias("id"))
    return chosen.unionByName(near).distinct()


def sampled_tables(sample: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: df.join(sample, "id", "left_semi") for name, df in tables.items()}


def records(grid: DataFrame) -> DataFrame:
    """Tall grid with NaN as null, ready for a JSON sink."""
    doubles = [f.name for f in grid.schema.fields if f.dataType.typeName() in ("double", "float")]
    return grid.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})
