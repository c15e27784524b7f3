"""All metrics of one or many topic assignments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lexweave.operators import morph, topics
from lexweave.operators.state import assigned_tokens
from lexweave.session import WHOLE_JOIN_KEYS, materialised, setting


def assigned_cells(state: DataFrame, oracle: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``morph.topic_cells`` of the joined tables, written once; tables that lie together by document are joined where they lie."""
    with setting(state.sparkSession, WHOLE_JOIN_KEYS, "false", "true"):
        return materialised(morph.topic_cells(assigned_tokens(state, oracle), by), "morphology-cells")


def topic_diagnostics(state: DataFrame, n: int = 20, by: list[str] | None = None, cells: DataFrame | None = None) -> DataFrame:
    """One row per topic (and run): size, entropies, distances, exclusivity, coherence, length."""
    keys = [*(by or []), "topic"]
    # counts per topic and term, read by five metrics: far smaller than the state, written once
    cells = materialised(topics.term_cells(state, by), "term-cells") if cells is None else cells
    parts = [
        cells.groupBy(*keys).agg(F.sum("n").alias("tokens")),
        topics.document_entropy(state, by),
        topics.distances(cells, by),
        topics.exclusivity(cells, n, by),
        topics.coherence(state, cells, n, by),
        topics.word_length(cells, n, by),
    ]
    return reduce(lambda a, b: a.join(b, keys), parts).withColumn(
        "negative_coherence", -F.col("coherence"))


def topic_morphology(state: DataFrame, oracle: DataFrame, n: int = 20,
                     by: list[str] | None = None) -> DataFrame:
    """Entropies and top-n metrics of each topic from one shuffle of the tokens."""
    keys = [*(by or []), "topic"]
    cells = assigned_cells(state, oracle, by)
    return morph.entropy_metrics(cells, by).join(morph.top_n_metrics(cells, n, by), keys)


def topic_summary(state: DataFrame, oracle: DataFrame, author_col: str, n: int = 20) -> DataFrame:
    """Top terms, author metrics, diagnostics and morphology of every topic side by side."""
    # the state is read once for what authors and terms need, and written as counts
    joint = materialised(topics.author_cells(state, author_col), "topic-author-terms")
    cells = materialised(joint.groupBy("topic", "term").agg(F.sum("n").alias("n")), "term-cells")
    authors = joint.groupBy("topic", "author").agg(F.sum("n").alias("n"))
    parts = [
        topics.topic_keys(cells, n),
        authors.groupBy("topic").agg(morph.entropy("n").alias("author_entropy")),
        topics.author_cell_divergence(joint),
        topic_diagnostics(state, n, cells=cells),
        morph.entropy_metrics(assigned_cells(state, oracle)),
    ]
    return reduce(lambda a, b: a.join(b, "topic"), parts)
