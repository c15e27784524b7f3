"""Topic assignments per token ("state") joined with gold analyses and with each other.

All token tables carry ``(doc_id, pos)``; what files align by line number is an equi-join here.
The key is unique per token, so these joins have no hot keys.  They carry a merge hint: Spark's size
estimate ignores how far ``explode`` multiplies rows, and would broadcast a whole token table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexweave.functions.text import pos_tag
from lexweave.operators.vocab import first_seen_index
from lexweave.operators.keyed import lookup_join

KEY = ["doc_id", "pos"]


def assigned_tokens(state: DataFrame, oracle: DataFrame) -> DataFrame:
    """``topic, term, lemma, slot, pos_tag`` per token: state joined with gold analyses."""
    gold = oracle.select(*KEY, "lemma", "slot", pos_tag(F.col("slot")).alias("pos_tag"))
    return state.join(gold.hint("merge"), KEY)


def misaligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """Token positions that one table has and the other lacks."""
    a = left.select(*KEY, F.lit(True).alias("in_left"))
    b = right.select(*KEY, F.lit(True).alias("in_right"))
    both = a.join(b, KEY, "full_outer")
    return both.filter(F.col("in_left").isNull() | F.col("in_right").isNull()).select(
        *KEY, F.coalesce("in_left", F.lit(False)).alias("in_left"),
        F.coalesce("in_right", F.lit(False)).alias("in_right"))


def unmap(raw: DataFrame, treated: DataFrame) -> DataFrame:
    """Terms and term ids of ``raw`` with the topics of ``treated``."""
    topics = treated.select(*KEY, "topic")
    return raw.drop("topic").join(topics.hint("merge"), KEY)


def restate(state: DataFrame, term: Column, spread_by: list[str] | None = None) -> DataFrame:
    """Replace the terms of a state, numbering the new terms as they first appear.

    ``term`` is the new term per row.  An empty one falls back to the old term.
    """
    new = F.lower(F.coalesce(F.nullif(term, F.lit("")), F.col("term")))
    out = state.withColumn("term", new).drop("term_id")
    index = first_seen_index(out, "term", KEY)
    return lookup_join(out, index, ["term"], "inner", spread_by or KEY)


def topic_term_counts(state: DataFrame, term_col: str = "term") -> DataFrame:
    return state.groupBy("topic", term_col).agg(F.count("*").alias("count"))


def analysis_counts(oracle: DataFrame) -> DataFrame:
    """Counts of every surface form, lemma, slot and part of speech, as ``(kind, value, count)``."""
    joint = oracle.groupBy("surface", "lemma", "slot").agg(F.count("*").alias("__n"))
    kinds = F.array(*[
        F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in [
            ("surface", F.col("surface")), ("lemma", F.col("lemma")),
            ("slot", F.col("slot")), ("pos", pos_tag(F.col("slot")))]])
    return (joint.select("__n", F.inline(kinds)).groupBy("kind", "value")
                 .agg(F.sum("__n").alias("count")))
