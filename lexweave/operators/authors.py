"""Counts and statistics by author."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexweave.operators.keyed import dense_index, lookup_join
from lexweave.session import materialised

BLOCK_AUTHORS = 1024      # author numbers in a block of the sparse matrix


def author_statistics(docs: DataFrame, author_col: str, length_col: str) -> DataFrame:
    return docs.groupBy(author_col).agg(
        F.count("*").alias("doc_count"),
        F.sum(length_col).alias("token_count"),
        (F.sum(length_col) / F.count("*")).alias("normalized_doc_length"))


def author_token_counts(tokens: DataFrame, author_col: str, token_col: str = "token") -> DataFrame:
    return tokens.groupBy(F.col(author_col).alias("author"), F.col(token_col).alias("token")).agg(
        F.count("*").alias("count"))


def author_dictionary(counts: DataFrame) -> DataFrame:
    """``author, author_id``: the authors numbered from 0 in order of name."""
    return dense_index(counts.select("author").distinct(), [F.col("author")], "author_id")


def author_word_blocks(counts: DataFrame, dictionary: DataFrame, width: int = BLOCK_AUTHORS) -> DataFrame:
    """``token, block, entries``: the word's counts by author, sparse, ``width`` author numbers to a block.

    ``entries`` is an array of ``author_id, count`` by author.  A row holds at most ``width`` entries, so a word of
    very many authors is spread over rows, and any number of authors is taken.
    """
    coded = lookup_join(counts, dictionary, ["author"], "inner", ["token"])
    block = F.floor(F.col("author_id") / width).alias("block")
    entries = F.sort_array(F.collect_list(F.struct("author_id", "count")))
    return coded.groupBy("token", block).agg(entries.alias("entries"))


def author_word_matrix(counts: DataFrame, authors: list[str] | None = None) -> DataFrame:
    """One row per word, one column per author, zero where an author lacks the word.

    The wide form is for sinks that want columns.  Without a list the author names are looked up; for more authors
    than a table can have columns, ``author_word_blocks`` holds the same counts.
    """
    if authors is None:
        authors = sorted(r["author"] for r in counts.select("author").distinct().toLocalIterator())
    return counts.groupBy("token").pivot("author", authors).agg(F.sum("count")).fillna(0, authors)


def author_pair_counts(pairs: DataFrame, author_col: str = "author", token_col: str = "token",
                       normalized_col: str = "normalized") -> DataFrame:
    return pairs.groupBy(
        F.col(author_col).alias("author"), F.lower(token_col).alias("token"),
        F.lower(normalized_col).alias("normalized")).agg(F.count("*").alias("count"))


def document_token_counts(tokens: DataFrame, author_col: str, id_col: str, token_col: str = "token") -> DataFrame:
    return tokens.groupBy(F.col(author_col).alias("author"), id_col, F.col(token_col).alias("token")).agg(
        F.count("*").alias("n"))


def author_counts_max(doc_counts: DataFrame) -> DataFrame:
    """Union of the per-document counters: the largest count in any one document."""
    return doc_counts.groupBy("author", "token").agg(F.max("n").alias("count"))


def author_counts_sum(doc_counts: DataFrame) -> DataFrame:
    return doc_counts.groupBy("author", "token").agg(F.sum("n").alias("count"))


def vocabulary_rollup(doc_counts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Files, vocabulary size and tokens per file, per author and overall.

    Each level is counted from the one below, so nothing is expanded once per level.  The two
    lower tables are written out because two levels read them.
    """
    per_doc = materialised(doc_counts.groupBy("author", id_col).agg(
        F.count("*").alias("vocab_size"), F.sum("n").alias("token_count")), "per-document")
    author_words = materialised(
        doc_counts.groupBy("author", "token").agg(F.sum("n").alias("n")), "author-words")
    author_files = per_doc.groupBy("author").agg(F.count("*").alias("files"))
    per_author = (author_words.groupBy("author")
                  .agg(F.count("*").alias("vocab_size"), F.sum("n").alias("token_count"))
                  .join(author_files, "author"))
    overall = (author_words.groupBy("token").agg(F.sum("n").alias("n"))
               .agg(F.count("*").alias("vocab_size"), F.sum("n").alias("token_count"))
               .crossJoin(F.broadcast(author_files.agg(F.sum("files").alias("files")))))  # one row
    id_type = dict(doc_counts.dtypes)[id_col]
    cols = ["level", "author", id_col, "files", "vocab_size", "token_count"]
    return (per_doc.withColumns({"level": F.lit("file"), "files": F.lit(1).cast("bigint")}).select(cols)
            .unionByName(per_author.withColumns(
                {"level": F.lit("author"), id_col: F.lit(None).cast(id_type)}).select(cols))
            .unionByName(overall.withColumns(
                {"level": F.lit("all"), "author": F.lit(None).cast("string"),
                 id_col: F.lit(None).cast(id_type)}).select(cols)))


def corpus_lengths(docs: DataFrame, total_col: str, kept_col: str) -> DataFrame:
    """Documents, tokens and mean length before and after tokens were dropped."""
    return docs.agg(
        F.count("*").alias("documents"),
        F.sum(total_col).alias("tokens_read"),
        F.avg(total_col).alias("mean_length_read"),
        F.sum(kept_col).alias("tokens_kept"),
        F.avg(kept_col).alias("mean_length_kept"),
        F.sum(F.col(total_col) - F.col(kept_col)).alias("tokens_removed"))
