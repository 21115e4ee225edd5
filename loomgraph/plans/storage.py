"""Intermediate results on storage that every executor sees.

Lineage is cut by writing Parquet below the folder named in ``spark.checkpoint.dir``, else below the warehouse.
A lost executor then costs one task, never the chain of stages before it. What a caller doesn't discard is deleted
when the driver ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: as configured, else in the warehouse, which all executors see; a temporary folder only on one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        configured = tempfile.mkdtemp(prefix="loomgraph-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own, deleted with all below it when the driver ends."""
    path = f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"
    fs, p = _file_system(spark, path)
    fs.mkdirs(p)  # only what exists can be marked
    fs.deleteOnExit(p)
    fs.delete(p, True)
    return path


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it is done, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, *more: DataFrame) -> tuple[DataFrame, str]:
    """Writes ``df`` below the shared folder and returns it as read back, with its path. Rows of ``more`` follow, one at a time: their shuffles never lie on disk together."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    with swept(spark):
        for part in (df, *more):
            part.toDF(*df.columns).write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, name: str, *keys: str, distinct: bool = False) -> DataFrame:
    """Writes ``df`` in buckets by ``keys``: joins and aggregations on these read it without a shuffle, however often. ``distinct`` rows, by the same shuffle."""
    spark = df.sparkSession
    path, n = fresh_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"loomgraph_{uuid.uuid4().hex}"
    dealt = df.repartition(n, *keys)
    with swept(spark):
        (dealt.distinct() if distinct else dealt).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes intermediate results that no later plan reads."""
    for path in paths:
        fs, p = _file_system(spark, path)
        fs.delete(p, True)
