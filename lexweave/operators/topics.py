"""Diagnostics of a topic assignment.

Definitions: natural logarithms for divergences and coherence, base 2 for entropies.  Probabilities
are plain count shares of the assignment, without smoothing, so any state under any vocabulary
(raw, unmapped or post-lemmatised) gives its metrics without retraining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexweave.operators.keyed import lookup_join
from lexweave.operators.morph import entropy, top_n
from lexweave.session import materialised

MASK_BITS = 62  # top terms in one BIGINT of a mask


def _keys(by: list[str] | None) -> list[str]:
    return [*(by or []), "topic"]


def term_cells(state: DataFrame, by: list[str] | None = None, term_col: str = "term") -> DataFrame:
    return state.groupBy(*_keys(by), F.col(term_col).alias("term")).agg(F.count("*").alias("n"))


def topic_tokens(state: DataFrame, by: list[str] | None = None) -> DataFrame:
    return state.groupBy(*_keys(by)).agg(F.count("*").alias("tokens"))


def group_entropy(state: DataFrame, group_col: str, out_col: str, by: list[str] | None = None) -> DataFrame:
    """Entropy of a topic over documents, authors or any other grouping."""
    counts = state.groupBy(*_keys(by), group_col).agg(F.count("*").alias("n"))
    return counts.groupBy(*_keys(by)).agg(entropy("n").alias(out_col))


def document_entropy(state: DataFrame, by: list[str] | None = None) -> DataFrame:
    return group_entropy(state, "doc_id", "document_entropy", by)


def author_entropy(state: DataFrame, author_col: str, by: list[str] | None = None) -> DataFrame:
    return group_entropy(state, author_col, "author_entropy", by)


def distances(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Kullback-Leibler distance of each topic from the uniform and from the corpus distribution.

    The uniform distribution spreads over the corpus vocabulary.
    """
    run = by or []
    terms = cells.groupBy(*run, "term").agg(F.sum("n").alias("__corpus_n"))
    totals = terms.groupBy(*run).agg(
        F.sum("__corpus_n").alias("__corpus"), F.count("*").alias("__vocab"))
    marked = cells.join(terms, [*run, "term"])
    # totals has one row per run
    marked = (marked.join(F.broadcast(totals), run) if run
              else marked.crossJoin(F.broadcast(totals)))
    n, whole = F.col("n"), F.sum("n")
    # sum p ln(p/q) with p = n/N, expanded so one aggregation suffices
    uniform = F.sum(n * F.ln(n)) / whole - F.ln(whole) + F.ln(F.first("__vocab"))
    corpus = (F.sum(n * F.ln(n / F.col("__corpus_n"))) / whole - F.ln(whole)
              + F.ln(F.first("__corpus")))
    return marked.groupBy(*_keys(by)).agg(
        (uniform + 0.0).alias("uniform_dist"), (corpus + 0.0).alias("corpus_dist"))


def exclusivity(cells: DataFrame, n: int = 20, by: list[str] | None = None) -> DataFrame:
    """Mean over the top terms of p(w|k) / sum over topics of p(w|k')."""
    keys = _keys(by)
    run = by or []
    totals = cells.groupBy(*keys).agg(F.sum("n").alias("__total"))  # one row per topic
    shares = cells.join(F.broadcast(totals), keys).withColumn("__p", F.col("n") / F.col("__total"))
    tops = top_n(cells, "term", n, by).select(*keys, "term", F.col("count").alias("n"))
    wanted = tops.select(*run, "term").distinct()  # at most n rows per topic
    sums = (shares.join(F.broadcast(wanted), [*run, "term"], "left_semi")
                  .groupBy(*run, "term").agg(F.sum("__p").alias("__all")))
    return (tops.join(totals, keys).join(sums, [*run, "term"])
                .groupBy(*keys).agg(F.avg(F.col("n") / F.col("__total") / F.col("__all"))
                                    .alias("exclusivity")))


def word_length(cells: DataFrame, n: int = 20, by: list[str] | None = None) -> DataFrame:
    return top_n(cells, "term", n, by).groupBy(*_keys(by)).agg(
        F.avg(F.length("term")).alias("word_length"))


def coherence(state: DataFrame, cells: DataFrame, n: int = 20, by: list[str] | None = None) -> DataFrame:
    """Sum over pairs of top terms a (higher ranked), b of ln((D(a,b) + 1) / D(a)).

    ``D`` counts documents of the corpus.  Per topic and document, the top terms present are a bit mask of as
    many numbers as ``n`` needs, built map-side; documents with equal masks are then counted together, so the
    pairs are formed on distinct masks, at most ``n (n - 1) / 2`` for each.
    """
    keys = _keys(by)
    run = by or []
    tops = top_n(cells, "term", n, by).select(*keys, "term", "rank")  # n rows per topic
    place = F.col("rank") - 1
    bits = F.array(*[F.bit_or(F.when(F.floor(place / MASK_BITS) == word, F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), (place % MASK_BITS).cast("int"))).otherwise(F.lit(0).cast("bigint")))
        for word in range(-(-n // MASK_BITS))])
    masks = (state.select(*run, "doc_id", "term")
             .join(F.broadcast(tops), [*run, "term"])
             .groupBy(*keys, "doc_id").agg(bits.alias("mask"))
             .groupBy(*keys, "mask").agg(F.count("*").alias("docs")))
    ranks = F.filter(F.sequence(F.lit(1), F.lit(n)),
                     lambda r: F.getbit(F.get("mask", F.floor((r - 1) / MASK_BITS).cast("int")), (r - 1) % MASK_BITS) == 1)
    seen = (masks.select(*keys, "docs", ranks.alias("ranks"))
            .select(*keys, "docs", "ranks", F.explode("ranks").alias("a"))
            .select(*keys, "docs", "a", F.explode(F.filter("ranks", lambda b: b >= F.col("a"))).alias("b"))
            .groupBy(*keys, "a", "b").agg(F.sum("docs").alias("docs")))
    seen = materialised(seen, "coherence-pairs")  # at most n (n + 1) / 2 rows per topic
    single = seen.filter("a = b").select(*keys, "a", F.col("docs").alias("docs_a"))
    last = single.groupBy(*keys).agg(F.max("a").alias("__last"))
    # pairs that never meet still count with D(a,b) = 0
    every = (single.join(last, keys)
             .withColumn("b", F.explode(F.sequence(F.col("a"), F.col("__last"))))
             .filter("b > a"))
    joined = every.join(seen.select(*keys, "a", "b", "docs"), [*keys, "a", "b"], "left")
    score = F.sum(F.ln((F.coalesce("docs", F.lit(0)) + 1) / F.col("docs_a")))
    return last.select(*keys).join(
        joined.groupBy(*keys).agg(score.alias("coherence")), keys, "left").select(
        *keys, F.coalesce("coherence", F.lit(0.0)).alias("coherence"))


def _js(p: Column, q: Column) -> Column:
    """One term of the Jensen-Shannon divergence, natural logarithm."""
    m = (p + q) / 2
    half = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    return (half(p) + half(q)) / 2


def author_divergence(state: DataFrame, author_col: str, by: list[str] | None = None) -> DataFrame:
    """How a topic changes when authors are reweighted (Jensen-Shannon from the original).

    ``minus_major_author``: the author with most tokens in the topic is left out (ties: smallest
    name); ``balanced_authors``: every author of the topic weighs the same.  A topic with one
    author has no distribution left for the first, given as null.
    """
    return author_cell_divergence(materialised(author_cells(state, author_col, by), "topic-author-terms"), by)


def author_cells(state: DataFrame, author_col: str, by: list[str] | None = None) -> DataFrame:
    return state.groupBy(*_keys(by), F.col(author_col).alias("author"), "term").agg(F.count("*").alias("n"))


def author_cell_divergence(joint: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``author_divergence`` from the counts of ``author_cells``, which are read several times."""
    keys = _keys(by)
    authors = joint.groupBy(*keys, "author").agg(F.sum("n").alias("__author_n"))
    topics = authors.groupBy(*keys).agg(
        F.sum("__author_n").alias("__n"), F.count("*").alias("__authors"),
        F.min(F.struct((-F.col("__author_n")).alias("n"), "author")).alias("__major"))
    topics = topics.select(
        *keys, "__n", "__authors", F.col("__major.author").alias("__major"),
        (-F.col("__major.n")).alias("__major_n"))
    cells = lookup_join(joint, authors, [*keys, "author"], "inner", ["term"])
    cells = cells.join(F.broadcast(topics), keys)  # one row per topic
    terms = cells.groupBy(*keys, "term").agg(
        F.first("__n").alias("__n"), F.first("__major_n").alias("__major_n"),
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("author") != F.col("__major"), F.col("n")).otherwise(0)).alias("__rest"),
        F.sum(F.col("n") / F.col("__author_n") / F.col("__authors")).alias("__balanced"))
    p = F.col("n") / F.col("__n")
    rest = F.col("__n") - F.col("__major_n")
    without = F.when(rest > 0, F.col("__rest") / rest)
    return terms.groupBy(*keys).agg(
        F.sum(F.when(rest > 0, _js(p, without))).alias("minus_major_author"),
        F.sum(_js(p, F.col("__balanced"))).alias("balanced_authors"))


def topic_keys(cells: DataFrame, n: int = 20, by: list[str] | None = None) -> DataFrame:
    """Top terms of each topic in rank order, as text."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return (top_n(cells, "term", n, by).groupBy(*_keys(by)).agg(ranked.alias("__r"))
            .select(*_keys(by), F.array_join(F.col("__r.term"), " ").alias("top_terms")))


def document_topics(state: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of each topic in each document."""
    run = by or []
    cells = state.groupBy(*run, "doc_id", "topic").agg(F.count("*").alias("n"))
    totals = cells.groupBy(*run, "doc_id").agg(F.sum("n").alias("__n"))
    return cells.join(totals, [*run, "doc_id"]).select(
        *run, "doc_id", "topic", "n", (F.col("n") / F.col("__n")).alias("proportion"))


def top_documents(doc_topics: DataFrame, n: int = 100, by: list[str] | None = None) -> DataFrame:
    """Documents with the largest share of each topic; ties go to the smaller id."""
    order = Window.partitionBy(*_keys(by)).orderBy(F.desc("proportion"), F.asc("doc_id"))
    return doc_topics.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
