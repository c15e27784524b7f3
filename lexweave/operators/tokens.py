"""Documents -> long token table, and token-level filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexweave.functions import text as T
from lexweave.functions.patterns import WORD
from lexweave.operators import lda, variational
from lexweave.operators.keyed import lookup_join

# Word lists come in two forms, and the form alone decides the plan.  A Python list travels inside the plan as a
# hash set and is tested within the row.  A DataFrame, of any size, is joined.

def token_table(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
                pattern: str = WORD) -> DataFrame:
    """One row per token: the kept columns, ``pos`` from 0, and ``token``.  No shuffle."""
    kept = keep if keep is not None else [c for c in docs.columns if c != text_col]
    return docs.select(*kept, F.posexplode(T.tokenise(F.col(text_col), pattern)).alias("pos", "token"))


def in_words(token: Column, words: list[str]) -> Column:
    return token.isin(words) if words else F.lit(False)


def stopped_text(text: Column, stop: list[str]) -> Column:
    """Text without its stop words, tokens joined by blanks; the test ignores case."""
    return F.array_join(F.filter(T.tokenise(text), lambda t: ~in_words(F.lower(t), stop)), " ")


def clean_text(text: Column, keep: list[str]) -> Column:
    """Tokens without punctuation, down-cased, restricted to the kept words."""
    plain = F.transform(T.tokenise(text), lambda t: F.lower(T.strip_punctuation(t)))
    return F.array_join(F.filter(plain, lambda t: in_words(t, keep)), " ")


def regroup(tokens: DataFrame, by: list[str], token_col: str = "token", pos_col: str = "pos",
            out_col: str = "text") -> DataFrame:
    """Tokens back to one text per document, in order.  A group is one document."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(pos_col), F.col(token_col))))
    return (tokens.groupBy(*by).agg(pairs.alias("__pairs"))
                  .select(*by, F.array_join(F.col(f"__pairs.{token_col}"), " ").alias(out_col)))


def text_key(text: Column) -> Column:
    """Digest that stands for a text where rows meet again: it survives recomputation and repeated ids."""
    return F.sha2(text.cast("binary"), 256)


def _filter_by_table(docs: DataFrame, text_col: str, out_col: str, words: DataFrame, word: Column, how: str) -> DataFrame:
    """Each distinct text is filtered once, in a block of texts that meets the words of the block that stay; documents then
    fetch the result by text."""
    keyed = docs.withColumn("__text", F.unhex(text_key(F.col(text_col))))
    texts = keyed.filter(F.col(text_col).isNotNull()).select("__text", text_col).dropDuplicates(["__text"])
    blocks = lda.token_blocks(texts.select(F.col("__text").alias("doc_id"), T.tokenise(F.col(text_col)).alias("words")))
    found = blocks.places.select("of_block", F.col("word").alias("number"), F.col("term").alias("token")).withColumn("__key", word)
    lookup = words.select(F.col("word").alias("__key")).distinct()
    kept = lookup_join(found, lookup, ["__key"], how, spread_by=["of_block"])
    kept = kept.select("of_block", F.col("number").alias("word"), F.col("__key" if how == "left_semi" else "token").alias("term"))
    joined = blocks.documents.select("block", "doc_id", "ids", "at", "pos").groupBy("block").cogroup(kept.groupBy("of_block")).applyInArrow(
        variational.joiner(), "__text binary, __out string")
    return (keyed.join(joined, "__text", "left")
                 .withColumn(out_col, F.coalesce(F.col("__out"), F.lit(""))).drop("__text", "__out"))


Words = DataFrame | list[str]


def remove_stopwords(docs: DataFrame, words: Words, text_col: str = "text",
                     out_col: str = "stopped_text") -> DataFrame:
    """Text without the words of a list or of a ``(word)`` table of any size; a null text becomes empty."""
    if isinstance(words, DataFrame):
        return _filter_by_table(docs, text_col, out_col, words, F.lower("token"), "left_anti")
    return docs.withColumn(out_col, F.coalesce(stopped_text(F.col(text_col), words), F.lit("")))


def keep_vocabulary(docs: DataFrame, words: Words, text_col: str = "text", out_col: str = "clean_text") -> DataFrame:
    """Clean text restricted to the words of a list or of a ``(word)`` table of any size; a null text becomes empty."""
    if isinstance(words, DataFrame):
        word = F.lower(T.strip_punctuation(F.col("token")))
        return _filter_by_table(docs, text_col, out_col, words, word, "left_semi")
    return docs.withColumn(out_col, F.coalesce(clean_text(F.col(text_col), words), F.lit("")))


StopLists = dict[str, list[str]]
StopWords = DataFrame | StopLists


def _is_stopped(token: Column, lang: Column, lists: dict[str, list[str]]) -> Column:
    stopped = F.lit(False)
    for code, words in lists.items():
        stopped = stopped | (lang.eqNullSafe(F.lit(code)) & in_words(F.lower(token), words))
    return stopped


def usable_words(text: Column, lang: Column, lists: StopLists, pattern: str = WORD) -> Column:
    """Usable tokens of a text as an array, with stop words as lists by language."""
    found = T.tokenise(text, pattern)
    if pattern != WORD:
        return F.filter(found, lambda t: ~_is_stopped(t, lang, lists) & T.is_word(t))
    return F.filter(found, lambda t: ~_is_stopped(t, lang, lists))  # WORD tokens have the shape


def usable_tokens(tokens: DataFrame, stop_words: StopWords, lang_col: str = "lang",
                  token_col: str = "token", spread_by: list[str] | None = None) -> DataFrame:
    """Tokens that are no stop word of their language and have the shape of a word throughout.

    Lists by language go into one expression, so that the token rows are not shuffled; a ``(lang, word)`` table of
    any size is joined.  A token without a language has no stop words.
    """
    shaped = tokens.filter(T.is_word(F.col(token_col)))
    if not isinstance(stop_words, DataFrame):
        return shaped.filter(~_is_stopped(F.col(token_col), F.col(lang_col), stop_words))
    lookup = stop_words.select(F.col("lang").alias(lang_col), F.col("word").alias("__key")).distinct()
    keyed = shaped.withColumn("__key", F.lower(token_col))
    return lookup_join(keyed, lookup, [lang_col, "__key"], "left_anti", spread_by).drop("__key")


def long_documents(tokens: DataFrame, min_tokens: int = 100, id_col: str = "doc_id") -> DataFrame:
    """Tokens of the documents that have at least ``min_tokens`` of them."""
    sizes = tokens.groupBy(id_col).agg(F.count("*").alias("__n"))
    return tokens.join(sizes.filter(F.col("__n") >= min_tokens).select(id_col), id_col, "left_semi")
