"""Vocabulary statistics, pruning, and comparison of vocabularies before and after a treatment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from lexweave.operators.keyed import dense_index, lookup_join


def term_frequencies(tokens: DataFrame, term_col: str = "term", id_col: str = "doc_id",
                     by: list[str] | None = None) -> DataFrame:
    """``term, term_freq, doc_freq``.

    Two counting steps instead of a distinct count: a term found in every document still
    reaches the shuffle as one row per document at most.
    """
    keys = [*(by or []), term_col]
    per_doc = tokens.groupBy(*keys, id_col).agg(F.count("*").alias("__n"))
    return per_doc.groupBy(*keys).agg(F.sum("__n").alias("term_freq"), F.count("*").alias("doc_freq"))


def prune(vocab: DataFrame, documents: Column | int, max_doc_share: float = 0.25, min_count: int = 5,
          count_col: str = "term_freq") -> DataFrame:
    """Terms in at most ``max_doc_share`` of the documents and counted at least ``min_count`` times.

    ``count_col='doc_freq'`` gives the other reading, a minimum number of documents.
    """
    total = F.lit(documents) if isinstance(documents, int) else documents
    return vocab.filter((F.col("doc_freq") <= max_doc_share * total) & (F.col(count_col) >= min_count))


def pruned_vocabulary(tokens: DataFrame, term_col: str = "term", id_col: str = "doc_id",
                      max_doc_share: float = 0.25, min_count: int = 5,
                      count_col: str = "term_freq", documents: DataFrame | None = None) -> DataFrame:
    """``prune`` with the number of documents counted from ``documents`` (default: the tokens')."""
    source = documents if documents is not None else tokens
    total = source.select(id_col).distinct().agg(F.count("*").alias("__docs"))
    vocab = term_frequencies(tokens, term_col, id_col).crossJoin(F.broadcast(total))  # one row
    return prune(vocab, F.col("__docs"), max_doc_share, min_count, count_col).drop("__docs")


def character_token_ratio(vocab: DataFrame, token_col: str, freq_col: str) -> DataFrame:
    return vocab.agg((F.sum(F.length(token_col) * F.col(freq_col)) / F.sum(freq_col))
                     .alias("char_to_token_ratio"))


def treatment_statistics(long_tokens: DataFrame, term_col: str = "term",
                         count_col: str | None = None) -> DataFrame:
    """Tokens, types, type-token and character-token ratio per treatment.

    With ``count_col`` the rows are word counts rather than running tokens.
    """
    n = F.lit(1) if count_col is None else F.col(count_col)
    types = (long_tokens.groupBy("treatment", F.lower(term_col).alias("__type"))
             .agg(F.sum(n).alias("__n"), F.sum(F.length(term_col) * n).alias("__chars")))
    return types.groupBy("treatment").agg(
        F.sum("__n").alias("token_count"),
        F.count("*").alias("word_type_count"),
        (F.count("*") / F.sum("__n")).alias("type_to_token_ratio"),
        (F.sum("__chars") / F.sum("__n")).alias("char_to_token_ratio"))


def zipf_ranks(vocab: DataFrame, freq_col: str = "doc_freq") -> DataFrame:
    """Rank of every term by descending frequency, ties sharing the smallest rank.

    The running total is taken over distinct frequencies.  N tokens have at most about
    ``sqrt(2 N)`` of those, so the one ordered window stays small while the terms stay spread.
    """
    steps = vocab.groupBy(freq_col).agg(F.count("*").alias("__terms"))
    above = Window.orderBy(F.desc(freq_col)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = steps.select(
        freq_col, (F.coalesce(F.sum("__terms").over(above), F.lit(0)) + 1).alias("rank"))
    return lookup_join(vocab, ranks, [freq_col], "inner")


def first_seen_index(tokens: DataFrame, term_col: str, order_by: list[str],
                     index_col: str = "term_id") -> DataFrame:
    """``term -> dense id`` in order of first appearance; empty terms get none.

    Two integer columns are packed into one decimal, whose minimum Spark keeps in a hash table;
    the minimum of a struct would sort all tokens.
    """
    place = _packed(tokens, order_by)
    first = (tokens.filter(F.col(term_col) != "")
             .groupBy(term_col).agg(F.min(place).alias("__first")))
    return dense_index(first, [F.col("__first")], index_col).drop("__first")


def _packed(df: DataFrame, order_by: list[str]) -> Column:
    types = dict(df.dtypes)
    if [types[c] for c in order_by] in (["bigint", "int"], ["int", "int"]):
        high, low = (F.col(c).cast("decimal(19,0)") for c in order_by)
        return high * F.lit(1 << 32).cast("decimal(10,0)") + low
    return F.struct(*order_by)


def pruned_words(vocab: DataFrame, pruned: DataFrame, on: str) -> DataFrame:
    """Words of ``vocab`` that pruning removed."""
    return vocab.join(pruned.select(on), on, "left_anti")


def tokens_dropped(stop: DataFrame, vocab: DataFrame, word_col: str = "word") -> DataFrame:
    """How many tokens the listed words stand for."""
    return vocab.join(stop, word_col).agg(F.sum("term_freq").alias("tokens_dropped"))


def pair_counts(author_pairs: DataFrame) -> DataFrame:
    """Sum the author out of ``(author, token, normalized, count)``."""
    return author_pairs.groupBy("token", "normalized").agg(F.sum("count").alias("pair_count"))


def types_per_lemma(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("normalized").agg(F.count("*").alias("num_word_types"))


def stopped_pairs(pairs: DataFrame, stopped_lemmas: DataFrame) -> DataFrame:
    """Every stopped lemma with its ``(token, lemma)`` pairs, also when it has none."""
    met = lookup_join(pairs, stopped_lemmas, ["normalized"], "inner")
    alone = stopped_lemmas.join(pairs.select("normalized").distinct(), "normalized", "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


def newly_stopped(pairs: DataFrame, stopped_lemmas: DataFrame, pruned_tokens: DataFrame) -> DataFrame:
    """Tokens that survived pruning themselves but whose lemma did not."""
    left = stopped_pairs(pairs, stopped_lemmas).withColumnsRenamed(
        {"term_freq": "term_freq_normalized"})
    right = pruned_tokens.select("token", F.col("term_freq").alias("term_freq_original_token"))
    return left.join(right, "token")


def rescued(pairs: DataFrame, pruned_lemmas: DataFrame, stopped_tokens: DataFrame) -> DataFrame:
    """Tokens that pruning removed but whose lemma is kept."""
    left = pruned_lemmas.withColumnsRenamed({"term_freq": "term_freq_normalized"})
    right = stopped_tokens.select("token", F.col("term_freq").alias("term_freq_original_token"))
    return lookup_join(pairs, left, ["normalized"], "inner").join(right, "token")


def vocabulary_overlap(pairs: DataFrame, pruned_lemmas: DataFrame, pruned_tokens: DataFrame) -> DataFrame:
    """One row: how far the two pruned vocabularies meet, in counts and shares.

    Works on counts per lemma and per token, never on running tokens.
    """
    kept = lookup_join(pairs, pruned_lemmas.select("normalized"), ["normalized"], "left_semi")
    marked = kept.join(
        pruned_tokens.select("token", F.col("term_freq").alias("__tf")), "token", "left")
    met = F.col("__tf").isNotNull()
    body = marked.agg(
        F.countDistinct(F.when(met, F.col("normalized"))).alias("num_lemmas"),
        F.countDistinct(F.when(met, F.col("token"))).alias("num_original_tokens"),
        F.count("*").alias("num_pairs"),
        F.sum("pair_count").alias("pair_tokens"),
        F.sum(F.when(met, F.col("pair_count"))).alias("pair_tokens_in_both"),
        F.sum("__tf").alias("original_tokens_in_both"))
    lemmas = pruned_lemmas.agg(F.count("*").alias("lemma_vocab"))
    tokens = pruned_tokens.agg(F.count("*").alias("token_vocab"), F.sum("term_freq").alias("token_total"))
    whole = body.crossJoin(F.broadcast(lemmas)).crossJoin(F.broadcast(tokens))  # one row each
    return whole.select(
        "num_lemmas",
        (F.col("num_lemmas") / F.col("lemma_vocab")).alias("lemma_share"),
        "num_original_tokens",
        (F.col("num_original_tokens") / F.col("token_vocab")).alias("token_share"),
        (F.col("num_original_tokens") / F.col("num_pairs")).alias("token_share_of_pairs"),
        "pair_tokens_in_both",
        (F.col("pair_tokens_in_both") / F.col("pair_tokens")).alias("pair_token_share"),
        "original_tokens_in_both",
        (F.col("original_tokens_in_both") / F.col("token_total")).alias("original_token_share"))
