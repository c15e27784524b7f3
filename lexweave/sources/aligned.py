"""Token tables laid out by their key, so that tables of one corpus meet without another shuffle.

A table is bucketed by ``(doc_id, pos)``: the rows of one token lie in the bucket of the same number in every table
with that number of buckets, and one long document is spread over all of them.  Joins on the key and groupings that
include it then read bucket beside bucket.  The shuffle is paid once, at the write.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from lexweave.session import SHUFFLE_CLEANUP, scratch_path, setting

KEY = ("doc_id", "pos")
BUCKETS = 200


def write_aligned(tokens: DataFrame, name: str | None = None, buckets: int = BUCKETS, path: str | None = None,
                  key: tuple[str, ...] = KEY) -> DataFrame:
    """Write ``tokens`` bucketed and sorted by ``key`` and return the table.

    ``name`` is the table's name in the session catalog, a new one if not given; an existing table is an error.
    ``path`` defaults to a folder below the shared scratch folder.  ``buckets`` must be equal for tables that are to
    meet without a shuffle; choose it so that a bucket fits a task (about 100 to 500 MB).  Each bucket is one file.
    Rows with a null in the key are kept; an empty table stays empty.
    """
    spark = tokens.sparkSession
    name = name or f"aligned_{uuid.uuid4().hex}"
    with setting(spark, SHUFFLE_CLEANUP, "true", "false"):      # the table stands for the shuffle it came from
        (tokens.repartition(buckets, *key).write.bucketBy(buckets, *key).sortBy(*key).format("parquet").option("compression", "zstd")
         .option("path", path or scratch_path(spark, "aligned")).saveAsTable(name))
    return spark.table(name)


def read_aligned(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def bucket_count(spark: SparkSession, name: str) -> int | None:
    """Buckets of a table, ``None`` if it is not bucketed."""
    rows = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Num Buckets'").collect()
    found = re.search(r"\d+", rows[0]["data_type"]) if rows else None
    return int(found.group()) if found else None


def align(tokens: DataFrame, like: str, name: str | None = None, key: tuple[str, ...] = KEY) -> DataFrame:
    """Write ``tokens`` with as many buckets as the table ``like`` has."""
    buckets = bucket_count(tokens.sparkSession, like)
    if buckets is None:
        raise ValueError(f"table is not bucketed: {like}")
    return write_aligned(tokens, name, buckets, key=key)
