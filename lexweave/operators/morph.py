"""Morphological metrics per topic.

Everything starts from ``topic_cells``, the counts per (topic, term, lemma, slot): the token
table is shuffled once, partially aggregated, and all metrics read the far smaller cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

KINDS = ("lemma", "slot", "pos")


def topic_cells(assigned: DataFrame, by: list[str] | None = None) -> DataFrame:
    keys = [*(by or []), "topic", "term", "lemma", "slot", "pos_tag"]
    return assigned.groupBy(*keys).agg(F.count("*").alias("n"))


def topic_totals(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    return cells.groupBy(*(by or []), "topic").agg(F.sum("n").alias("topic_marginal_count"))


def entropy(counts: str | Column, total: Column | None = None) -> Column:
    """Aggregate: base-2 entropy of a group's counts, never a negative zero."""
    n = F.col(counts) if isinstance(counts, str) else counts
    whole = F.sum(n)
    return F.log2(whole) - F.sum(n * F.log2(n)) / whole + F.lit(0.0)


def joint_counts(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(kind, topic, value, joint_count, conditional_probability_given_topic)`` in long form."""
    keys = [*(by or []), "topic"]
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(col).alias("value"))
        for kind, col in zip(KINDS, ("lemma", "slot", "pos_tag"))])
    joint = (cells.select(*keys, "n", F.inline(kinds)).groupBy("kind", *keys, "value")
                  .agg(F.sum("n").alias("joint_count")))
    totals = topic_totals(cells, by)  # one row per topic: bounded by the model
    return joint.join(F.broadcast(totals), keys).select(
        "kind", *keys, "value", "joint_count",
        (F.col("joint_count") / F.col("topic_marginal_count"))
        .alias("conditional_probability_given_topic"))


def entropy_metrics(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``lemma_entropy, slot_entropy, pos_entropy`` per topic from one long aggregation."""
    keys = [*(by or []), "topic"]
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(col).alias("value"))
        for kind, col in zip(KINDS, ("lemma", "slot", "pos_tag"))])
    joint = (cells.select(*keys, "n", F.inline(kinds)).groupBy("kind", *keys, "value")
                  .agg(F.sum("n").alias("n")))
    per_kind = joint.groupBy("kind", *keys).agg(entropy("n").alias("entropy"))
    return per_kind.groupBy(*keys).pivot("kind", list(KINDS)).agg(F.first("entropy")).select(
        *keys, *[F.col(k).alias(f"{k}_entropy") for k in KINDS])


def top_n(cells: DataFrame, value_col: str, n: int = 20, by: list[str] | None = None,
          count_col: str = "n", out_col: str = "count") -> DataFrame:
    """The ``n`` most frequent values per topic; ties go to the smaller value.

    The rank filter lets Spark drop rows before the shuffle (window group limit), so a large
    topic sends ``n`` rows per task, not its whole vocabulary.
    """
    keys = [*(by or []), "topic"]
    counts = cells.groupBy(*keys, value_col).agg(F.sum(count_col).alias(out_col))
    order = Window.partitionBy(*keys).orderBy(F.desc(out_col), F.asc(value_col))
    return (counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n))


def _sorted_set(col: str) -> Column:
    return F.array_sort(F.collect_set(col))


def top_n_metrics(cells: DataFrame, n: int = 20, by: list[str] | None = None) -> DataFrame:
    """Set and ratio metrics of the top ``n`` terms and lemmas of each topic.

    Ratios divide by ``n`` even where a topic has fewer terms.  Sets are sorted, blank-joined text.
    """
    keys = [*(by or []), "topic"]
    terms = top_n(cells, "term", n, by)
    lemmas = top_n(cells, "lemma", n, by)
    # the cells of the top terms; n rows per topic on the small side
    covered = cells.join(F.broadcast(terms.select(*keys, "term")), [*keys, "term"])
    values = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(col).alias("value"))
        for kind, col in [*zip(KINDS, ("lemma", "slot", "pos_tag")), ("term", "term")]])
    distinct = covered.select(*keys, F.inline(values)).distinct()

    def of(kind: str) -> Column:
        return F.when(F.col("kind") == kind, F.col("value"))

    in_terms = distinct.groupBy(*keys).agg(
        *[(F.count(of(k)) / F.lit(n)).alias(f"{name}_to_top_{n}_surface_forms")
          for k, name in zip(KINDS, ("lemmas", "slots", "pos"))],
        F.array_sort(F.collect_list(of("term"))).alias("__terms"),
        F.array_sort(F.collect_list(of("lemma"))).alias("__covered"))
    top_lemmas = lemmas.groupBy(*keys).agg(_sorted_set("lemma").alias("__lemmas"))
    minus = F.array_except("__lemmas", "__covered")
    reverse = F.array_except("__covered", "__lemmas")
    return in_terms.join(top_lemmas, keys).select(
        *keys,
        *[f"{name}_to_top_{n}_surface_forms" for name in ("lemmas", "slots", "pos")],
        F.array_join("__terms", " ").alias(f"top_{n}_term_set"),
        F.array_join("__lemmas", " ").alias(f"top_{n}_lemma_set"),
        F.array_join("__covered", " ").alias(f"lemmas_in_top_{n}_terms"),
        F.array_join(minus, " ").alias("top_lemmas_minus_top_term_lemmas"),
        F.array_join(reverse, " ").alias("top_term_lemmas_minus_top_lemmas"),
        F.size("__covered").cast("bigint").alias(f"num_lemmas_in_top_{n}_terms"),
        F.size(minus).cast("bigint").alias("num_top_lemmas_excluded_by_top_terms"),
        F.size(reverse).cast("bigint").alias("num_top_term_lemmas_excluded_by_top_lemmas"))
