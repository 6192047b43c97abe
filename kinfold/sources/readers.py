"""Sources (A1-A4, B5, B9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet table with a pushed-down filter and pruned columns."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def relational(spark: SparkSession, query: str, tables: dict[str, DataFrame] | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """Rows of a SQL text, over registered tables or a JDBC source."""
    if jdbc is not None:
        return spark.read.format("jdbc").options(query=query, **jdbc).load()
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)


def union_lists(lists: list[DataFrame], id_column: str) -> DataFrame:
    """Union of lists by column name, rows without an id left out."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists).where(F.col(id_column).isNotNull())


def id_list_files(spark: SparkSession, paths: list[str], id_column: str) -> DataFrame:
    """``union_lists`` of CSV files with a header."""
    return union_lists([spark.read.option("header", True).csv(p) for p in paths], id_column)


def api_records(spark: SparkSession, path: str, schema: T.StructType, names: dict[str, str]) -> DataFrame:
    """JSON records with sub-objects as flat rows: ``names`` maps each column to its path."""
    return reshape(spark.read.schema(schema).json(path), names)


def reshape(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(path).alias(name) for name, path in names.items()))


def flattened(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names; the first element of lists."""

    def leaves(struct: T.StructType, path: list[str]) -> list[Column]:
        out = []
        for field in struct.fields:
            here = [*path, field.name]
            if isinstance(field.dataType, T.StructType):
                out += leaves(field.dataType, here)
                continue
            value = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(field.dataType, T.ArrayType):
                value = F.get(value, F.lit(0))
            out.append(value.alias(".".join(here)))
        return out

    return df.select(*leaves(df.schema, []))
