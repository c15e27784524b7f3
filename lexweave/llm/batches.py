"""Size of the Arrow batches in which Spark hands whole texts to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROWS = 1024
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = ROWS) -> None:
    """At most ``rows`` texts per batch from now on in this session; Spark's default of 10,000 suits short rows."""
    if not 0 < int(spark.conf.get(_SETTING)) <= rows:
        spark.conf.set(_SETTING, str(rows))
