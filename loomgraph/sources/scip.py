"""Code-intelligence indexes in JSON: symbols become nodes, relationships edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import base_name
from loomgraph.operators.resolve import scip_relations

SCHEMA = """documents array<struct<relative_path string, language string, symbols array<struct<symbol string, kind string, display_name string,
relationships array<struct<symbol string, is_implementation boolean, is_type_definition boolean, is_definition boolean>>>>>>"""


def read_scip(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, label, source_file)`` and edges ``(src, dst, relation)``; targets outside of the index become stubs."""
    docs = spark.read.schema(SCHEMA).json(path, multiLine=True).select(F.explode("documents").alias("d")).where("d.relative_path IS NOT NULL")
    held = docs.select(F.col("d.relative_path").alias("document"), F.explode("d.symbols").alias("s")).where("s.symbol IS NOT NULL")
    own = F.concat_ws("#", "document", "s.symbol")
    nodes = held.select(own.alias("id"), F.coalesce("s.display_name", base_name(F.col("s.symbol"))).alias("label"), F.col("document").alias("source_file")).dropDuplicates(["id"])
    rel = held.select(own.alias("src"), "document", F.explode("s.relationships").alias("r")).select("src", "document", F.col("r.symbol").alias("symbol"), F.when(F.col("r.is_implementation"), "scip_impl").when(F.col("r.is_type_definition"), "scip_typed").when(F.col("r.is_definition"), "scip_def").otherwise("scip_ref").alias("relation"))
    found = scip_relations(rel.select(F.concat_ws("|", "src", "symbol", "relation").alias("src"), "document", "symbol"), held.select(own.alias("id"), "document", F.col("s.symbol").alias("symbol")))
    edges = rel.withColumn("key", F.concat_ws("|", "src", "symbol", "relation")).join(found.select(F.col("src").alias("key"), F.col("target").alias("dst")).distinct(), "key").select("src", "dst", "relation").distinct()
    stubs = edges.where("dst LIKE 'stub:%'").select(F.col("dst").alias("id"), F.expr("substring(dst, 6)").alias("label"), F.lit(None).cast("string").alias("source_file")).distinct()
    return nodes.union(stubs), edges
