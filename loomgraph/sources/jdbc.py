"""Schemas of relational databases as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def foreign_keys(constraints: DataFrame, columns: DataFrame, targets: DataFrame) -> DataFrame:
    """``(name, src, dst, columns)`` from information-schema tables: constraints ``(name, table)``, key columns ``(name, place, column)``, targets ``(name, target)``."""
    cols = columns.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "column"))), lambda c: c["column"]), ",").alias("columns"))
    return constraints.join(targets, "name").join(cols, "name").select("name", F.col("table").alias("src"), F.col("target").alias("dst"), "columns")


def introspect(spark: SparkSession, url: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """Table nodes and foreign-key edges of a database with an information schema."""
    read = lambda q: spark.read.format("jdbc").options(url=url, query=q, **options).load()
    tables = read("select table_schema, table_name from information_schema.tables where table_schema not in ('pg_catalog', 'information_schema')")
    nodes = tables.select(F.concat_ws(".", "table_schema", "table_name").alias("id"), F.col("table_name").alias("label"), F.lit("code").alias("file_type"))
    keys = read("select constraint_name as name, table_name as \"table\" from information_schema.table_constraints where constraint_type = 'FOREIGN KEY'")
    columns = read('select constraint_name as name, ordinal_position as place, column_name as "column" from information_schema.key_column_usage')
    targets = read("select distinct constraint_name as name, table_name as target from information_schema.constraint_column_usage")
    return nodes, foreign_keys(keys, columns, targets).select("src", "dst", F.lit("references").alias("relation"), "columns")
