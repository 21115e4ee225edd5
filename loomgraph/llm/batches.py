"""Bounded memory for whole texts in Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that cross to Python at once. Texts may be long, and each batch is held several times over (JVM, Arrow, strings).
ROWS = 1000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches have at most ``ROWS`` rows; a smaller setting stays."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_KEY, "10000")) <= ROWS:
        conf.set(_KEY, str(ROWS))
    return df
