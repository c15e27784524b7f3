"""Treatments: interchangeable rewrites of a token, and the long table over several of them."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lexweave.functions import text as T
from lexweave.functions.snowball import STEMMERS
from lexweave.operators.keyed import lookup_join
from lexweave.operators.tokens import token_table

RAW = "raw"
ORACLE = "oracle"

# The treatments offered per language.
LANGUAGE_TREATMENTS = {
    "ru": ["pymystem3", "stanza", "snowball"],
    "de": ["snowball", "stanza", "spacy"],
}
# Those of them that come from a dictionary or a model, here a lexicon table of that name.
LEXICON_TREATMENTS = {"pymorphy2", "pymystem3", "stanza", "spacy"}
_LANGUAGE_NAMES = {"russian": "ru", "german": "de"}


def language_treatments(language: str) -> list[str]:
    code = _LANGUAGE_NAMES.get(language.lower(), language.lower())
    if code not in LANGUAGE_TREATMENTS:
        raise ValueError(f"no treatments for language {language}")
    return list(LANGUAGE_TREATMENTS[code])


def truncation(num_chars: int) -> Callable[[Column], Column]:
    return lambda token: T.truncate(token, num_chars)


def column_treatments(truncations=(5, 6)) -> dict[str, Callable[[Column], Column]]:
    """Treatments that need nothing but the token."""
    table: dict[str, Callable[[Column], Column]] = {RAW: lambda token: token}
    table.update({f"truncate{n}": truncation(n) for n in truncations})
    return table


def treated_columns(tokens: DataFrame, treatments: dict[str, Callable[[Column], Column]],
                    token_col: str = "token") -> DataFrame:
    """One column per treatment, empty results replaced by the token."""
    token = F.col(token_col)
    return tokens.select(
        "*", *[T.lemma_or_token(f(token), token).alias(name) for name, f in treatments.items()])


def long_treatments(tokens: DataFrame, treatments: dict[str, Callable[[Column], Column]],
                    token_col: str = "token") -> DataFrame:
    """One row per token and treatment, from one pass over the tokens."""
    token = F.col(token_col)
    rows = F.array(*[
        F.struct(F.lit(name).alias("treatment"), T.lemma_or_token(f(token), token).alias("term"))
        for name, f in treatments.items()])
    return tokens.select("*", F.inline(rows))


def snowball_words(words: DataFrame, language: str, word_col: str = "token",
                   out_col: str = "normalized") -> DataFrame:
    stem = STEMMERS.get(language.lower())
    if stem is None:
        raise ValueError(f"no Snowball rules for language {language}")
    return stem(words, word_col, out_col)


def stem_vocabulary(tokens: DataFrame, language: str, token_col: str = "token",
                    out_col: str = "normalized", spread_by: list[str] | None = None) -> DataFrame:
    """Stem each distinct word once and join the stems back to the tokens."""
    stems = snowball_words(tokens.select(token_col).distinct(), language, token_col, out_col)
    return lookup_join(tokens, stems, [token_col], "inner", spread_by)


def lexicon_lemmas(tokens: DataFrame, lexicon: DataFrame, on: list[str],
                   lemma_col: str = "lemma", token_col: str = "token", out_col: str = "normalized",
                   spread_by: list[str] | None = None) -> DataFrame:
    """Lemma from a ``(…on, lemma)`` lexicon, the token itself where there is none.

    The lexicon stands in for dictionary and model lemmatisers.  Several entries for one key
    are settled by the smallest lemma, so a token never multiplies.
    """
    unique = lexicon.groupBy(*on).agg(F.min(lemma_col).alias("__lemma"))
    joined = lookup_join(tokens, unique, on, "left", spread_by)
    return joined.withColumn(
        out_col, T.lemma_or_token(F.col("__lemma"), F.col(token_col))).drop("__lemma")


def apply_treatment(tokens: DataFrame, name: str, language: str, lexicons: dict[str, DataFrame] | None = None,
                    token_col: str = "token", out_col: str = "normalized",
                    spread_by: list[str] | None = None) -> DataFrame:
    """A treatment chosen by name: ``raw``, ``truncate<n>``, ``snowball`` or a lexicon's name.

    Lexicons are ``(token, lemma)`` tables by treatment name.  Empty results fall back to the token.
    """
    token = F.col(token_col)
    cut = re.fullmatch(r"truncate(\d*)", name)
    if name == RAW:
        return tokens.withColumn(out_col, token)
    if cut:
        return tokens.withColumn(out_col, T.truncate(token, int(cut[1] or 5)))
    if name == "snowball":
        stemmed = stem_vocabulary(tokens, language, token_col, out_col, spread_by)
        return stemmed.withColumn(out_col, T.lemma_or_token(F.col(out_col), token))
    if name in LEXICON_TREATMENTS and name in (lexicons or {}):
        return lexicon_lemmas(tokens, lexicons[name], [token_col], token_col=token_col,
                              out_col=out_col, spread_by=spread_by)
    raise ValueError(f"treatment {name} is undefined or lacks its lexicon")


def normalise_column(docs: DataFrame, text_col: str, author_col: str,
                     normalise: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rewrite one text column word by word.

    Returns the rewritten table, the ``(author, token, normalized, count)`` table of down-cased
    pairs, and the rejected rows (text or author missing, as in a line with too few fields).
    """
    good = F.col(text_col).isNotNull() & F.col(author_col).isNotNull()
    pairs = T.token_pairs(F.col(text_col), normalise)
    texts = docs.filter(good).select(*[
        F.array_join(pairs["normalized"], " ").alias(c) if c == text_col else F.col(c)
        for c in docs.columns])
    # unpacked straight from the expression: from a column, Spark would first test its size and so
    # tokenise every text twice
    counts = (docs.filter(good).select(F.col(author_col).alias("author"), F.inline(pairs))
                   .groupBy("author", F.lower("token").alias("token"),
                            F.lower("normalized").alias("normalized"))
                   .agg(F.count("*").alias("count")))
    return texts, counts, docs.filter(~good)


def snowball_column(docs: DataFrame, text_col: str, author_col: str, id_col: str,
                    language: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``normalise_column`` for Snowball: stems come from the vocabulary, empty stems drop out.

    Rows without text or author are rejected, as there.
    """
    good = F.col(text_col).isNotNull() & F.col(author_col).isNotNull()
    docs, rejected = docs.filter(good), docs.filter(~good)
    tokens = token_table(docs.select(id_col, author_col, text_col), text_col)
    stemmed = stem_vocabulary(tokens, language, spread_by=[id_col, "pos"])
    stemmed = stemmed.filter(F.trim("normalized") != "")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "normalized")))
    texts = (stemmed.groupBy(id_col).agg(ordered.alias("__pairs"))
                    .select(id_col, F.array_join(F.col("__pairs.normalized"), " ").alias("__text")))
    joined = (docs.join(texts, id_col, "left")
                  .withColumn(text_col, F.coalesce("__text", F.lit(""))).drop("__text"))
    words = (token_table(docs.select(F.col(author_col).alias("author"), text_col), text_col)
             .groupBy("author", "token").agg(F.count("*").alias("n")))
    counts = (snowball_words(words, language).filter(F.trim("normalized") != "")
              .groupBy("author", F.lower("token").alias("token"), F.lower("normalized").alias("normalized"))
              .agg(F.sum("n").alias("count")))
    return joined, counts, rejected


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
