"""Joins against a lookup table and dense numbering, written for hot keys and large sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexweave.session import materialised

DEFAULT_SALTS = 16


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, the figure Spark itself compares with its broadcast limit."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    return df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def lookup_join(left: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner",
                spread_by: list[str] | None = None, salts: int = DEFAULT_SALTS) -> DataFrame:
    """Join many rows to a table that has at most one row per key.

    A lookup whose estimated size is below Spark's broadcast limit is joined plainly and Spark
    broadcasts it.  A larger one is copied ``salts`` times and the left rows of one key are
    spread over the copies, so a word that makes up a third of the corpus is shared by
    ``salts`` tasks.  Every left row meets exactly one copy, so the result is the plain join's.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join cannot keep unmatched lookup rows: {how}")
    if estimated_bytes(lookup) <= broadcast_limit(lookup):
        return left.join(lookup, on, how)
    spread = [F.col(c) for c in (spread_by or left.columns)]
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


def dense_index(df: DataFrame, order_by: list, out_col: str) -> DataFrame:
    """Number the rows 0, 1, 2, ... in the given order without a one-task window.

    The rows are range-partitioned, sorted and written once, together with their partition and
    their place in it; only one row count per partition is gathered to form the offsets.
    """
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    row = F.monotonically_increasing_id()
    tagged = materialised(
        ordered.withColumn("__part", F.spark_partition_id())
               .withColumn("__row", row.bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    sizes = {r["__part"]: r["n"] for r in tagged.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    starts, seen = [], 0
    for part in range(max(sizes, default=0) + 1):
        starts.append(seen)
        seen += sizes.get(part, 0)
    # a literal, one number per partition, leaves the size estimate of the result that of its file
    offset = F.get(F.lit(starts).cast("array<bigint>"), F.col("__part"))
    return tagged.withColumn(out_col, offset + F.col("__row")).drop("__part", "__row")
