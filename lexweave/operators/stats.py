"""Descriptions of a metric: five numbers, histograms, group means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexweave.session import materialised


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def quantiles(values: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of ``(keys, __v, __n)``, a column each, without a group in one task.

    The values are range-partitioned and written once with their partition.  Counts by group and partition give
    the rank at which a partition's values begin; the two values around a quantile are those whose ranks hold it.
    """
    ordered = materialised(values.filter(F.col("__v").isNotNull()).repartitionByRange(*keys, "__v")
                           .withColumn("__part", F.spark_partition_id()), "values")
    sizes = ordered.groupBy(*keys, "__part").agg(F.sum("__n").alias("__size"))      # a row per group and partition
    before = Window.partitionBy(*keys).orderBy("__part")
    starts = sizes.select(*keys, "__part", (F.sum("__size").over(before) - F.col("__size")).alias("__start"),
                          F.sum("__size").over(Window.partitionBy(*keys)).alias("__total"))
    inside = Window.partitionBy("__part", *keys).orderBy("__v")
    ranked = ordered.withColumn("__upto", F.sum("__n").over(inside)).join(starts, [*keys, "__part"])
    first, behind = F.col("__start") + F.col("__upto") - F.col("__n"), F.col("__start") + F.col("__upto")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < behind), F.col("__v")))

    ends = []
    for name, p in probabilities.items():
        place = (F.col("__total") - 1) * F.lit(p)
        ends += [at(F.floor(place)).alias(f"__a_{name}"), at(F.ceil(place)).alias(f"__b_{name}"),
                 F.max(place - F.floor(place)).alias(f"__f_{name}")]
    return ranked.groupBy(*keys).agg(*ends).select(*keys, *[
        (F.col(f"__a_{n}") * (1 - F.col(f"__f_{n}")) + F.col(f"__b_{n}") * F.col(f"__f_{n}")).alias(n) for n in probabilities])


def describe(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles (interpolated, exact) and maximum.

    Equal values are counted first.  Null values are left out; a group of nothing else has no row.
    """
    keys = by or []
    values = df.filter(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("__v")).agg(F.count("*").alias("__n"))
    values = materialised(values, "distinct-values")
    v, n = F.col("__v"), F.col("__n")
    total = F.sum(n)
    mean = F.sum(v * n) / total
    rows = values.groupBy(*keys).agg(
        total.alias("count"), mean.alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    # second pass around the mean keeps the deviation stable
    spread = (values.join(rows.select(*keys, F.col("mean").alias("__m")), keys) if keys
              else values.crossJoin(F.broadcast(rows.select(F.col("mean").alias("__m")))))  # one row
    m = F.col("__m")
    dev = spread.groupBy(*keys).agg(
        F.sqrt(F.sum(n * (v - m) * (v - m)) / F.nullif(total - 1, F.lit(0))).alias("std"))
    parts = [dev, quantiles(values, keys, QUARTILES)]
    for part in parts:
        rows = rows.join(part, keys) if keys else rows.crossJoin(F.broadcast(part))  # one row
    return rows.select(*keys, "count", "mean", "std", "min", *QUARTILES, "max")


def histogram(df: DataFrame, col: str, bins: int = 20, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins over the value range, last bin closed; count and share per bin."""
    keys = by or []
    counts = df.groupBy(*keys, F.col(col).alias("__v")).agg(F.count("*").alias("__n"))
    ends = counts.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"),
                                     F.sum("__n").alias("__total"))
    rows = counts.join(ends, keys) if keys else counts.crossJoin(F.broadcast(ends))  # one row
    v, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
    nth = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))).cast("bigint")
    return rows.groupBy(*keys, nth.alias("bin"), "__lo", "__hi", "__total").agg(
        F.sum("__n").alias("count")).select(
        *keys, "bin", (lo + (hi - lo) * F.col("bin") / bins).alias("bin_start"), "count",
        (F.col("count") / F.col("__total")).alias("probability"))


def mean_by(df: DataFrame, metrics: list[str], by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def quartiles_by(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    return describe(df, col, by).select(*by, "q25", "median", "q75")


def mean_bands(df: DataFrame, cols: list[str], by: list[str] | None = None, width: float = 2.0) -> DataFrame:
    """Mean and mean plus or minus ``width`` standard deviations."""
    aggs = []
    for c in cols:
        mean, dev = F.avg(c), F.stddev(c)
        aggs += [mean.alias(f"{c}_mean"), (mean - width * dev).alias(f"{c}_low"),
                 (mean + width * dev).alias(f"{c}_high")]
    return df.groupBy(*(by or [])).agg(*aggs)


def pair_grid(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """How many rows have each combination of two values."""
    return df.groupBy(*(by or []), a, b).agg(F.count("*").alias("topics"))


def extremes(df: DataFrame, order_by: list, n: int) -> DataFrame:
    """The first ``n`` rows in an order: a top-k, not a sort."""
    return df.orderBy(*order_by).limit(n)
