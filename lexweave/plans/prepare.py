"""Corpus preparation end to end: annotated or plain tokens -> treated documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lexweave.functions import text as T
from lexweave.operators import tokens as tok
from lexweave.operators import treat


@dataclass
class PreparedCorpus:
    """``tokens`` has one column per treatment; ``sizes`` one row with the corpus figures."""

    tokens: DataFrame
    sizes: DataFrame


def prepare_corpus(tokens: DataFrame, stop_words: tok.StopWords, treatments: dict | None = None,
                   min_tokens: int = 100, has_oracle: bool = False, id_col: str = "doc_id",
                   token_col: str = "token", lang_col: str = "lang") -> PreparedCorpus:
    """Drop stop words and non-words, treat what is left, keep documents of ``min_tokens`` or more.

    The minimum counts kept tokens.  With ``has_oracle`` the gold ``lemma`` becomes a treatment.
    """
    treatments = treatments if treatments is not None else treat.column_treatments()
    usable = tok.usable_tokens(tokens, stop_words, lang_col, token_col)
    long_enough = tok.long_documents(usable, min_tokens, id_col)
    treated = treat.treated_columns(long_enough, treatments, token_col)
    if has_oracle:
        treated = treated.withColumn(
            treat.ORACLE, T.lemma_or_token(F.col("lemma"), F.col(token_col)))
    per_doc = tokens.groupBy(id_col).agg(F.count("*").alias("n_all")).join(
        usable.groupBy(id_col).agg(F.count("*").alias("n_kept")), id_col, "left")
    n_kept = F.coalesce("n_kept", F.lit(0))
    kept = n_kept >= min_tokens
    sizes = per_doc.agg(
        F.count("*").alias("documents_read"),
        F.sum(kept.cast("bigint")).alias("documents_written"),
        F.sum("n_all").alias("tokens_read"),
        F.sum(n_kept).alias("tokens_after_stopping"),
        F.sum(F.when(kept, n_kept).otherwise(0)).alias("tokens_written"))
    return PreparedCorpus(treated, sizes)


def prepare_documents(docs: DataFrame, stop_words: tok.StopWords, min_tokens: int = 100,
                      text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Plain-text documents with a ``words`` array of usable tokens, short documents left out.

    With stop lists, stop words, word shape and the minimum length are all settled inside the row, so nothing is
    shuffled.  A short document is an empty ``explode`` rather than a filter: Spark would move the filter down and
    tokenise every text a second time for it.  A stop table, of any size, is joined with the tokens of each distinct
    text and language.
    """
    kept = [F.col(c) for c in docs.columns if c != text_col]
    if isinstance(stop_words, DataFrame):
        found = _words_by_table(docs, stop_words, min_tokens, text_col, lang_col)
        keyed = docs.withColumn("__text", tok.text_key(F.col(text_col))).alias("d")
        same = (F.col("d.__text") == F.col("w.__text")) & F.col(f"d.{lang_col}").eqNullSafe(F.col("w.__lang"))
        return keyed.join(found.alias("w"), same).select(*[F.col(f"d.{c}") for c in docs.columns if c != text_col], "w.words")
    words = tok.usable_words(F.col(text_col), F.col(lang_col), stop_words)
    long_enough = F.filter(F.array(words), lambda found: F.size(found) >= min_tokens)
    return docs.select(*kept, F.explode(long_enough).alias("words"))


def _words_by_table(docs: DataFrame, stop_table: DataFrame, min_tokens: int, text_col: str, lang_col: str) -> DataFrame:
    """``__text, __lang, words`` of the distinct texts that keep at least ``min_tokens`` words."""
    texts = (docs.select(tok.text_key(F.col(text_col)).alias("__text"), F.col(lang_col).alias("__lang"), F.col(text_col).alias("__body"))
             .filter(F.col("__body").isNotNull()).dropDuplicates(["__text", "__lang"]))
    tokens = tok.token_table(texts, "__body", ["__text", "__lang"])
    usable = tok.usable_tokens(tokens, stop_table, "__lang", spread_by=["__text", "pos"])
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))
    grouped = usable.groupBy("__text", "__lang").agg(ordered.alias("__t")).filter(F.size("__t") >= min_tokens)
    return grouped.select("__text", "__lang", F.col("__t.token").alias("words"))


def document_texts(prepared: DataFrame, treatments: dict) -> DataFrame:
    """``(treatment, …, text)``: every treatment of a prepared document, still inside the row."""
    def treated(function):
        return F.transform("words", lambda t: T.lemma_or_token(function(t), t))

    rows = F.array(*[
        F.struct(F.lit(name).alias("treatment"), F.array_join(treated(f), " ").alias("text"))
        for name, f in treatments.items()])
    return prepared.select(*[c for c in prepared.columns if c != "words"], F.inline(rows))


def document_tokens(prepared: DataFrame) -> DataFrame:
    return prepared.select(*[c for c in prepared.columns if c != "words"],
                           F.posexplode("words").alias("pos", "token"))


def treatment_texts(prepared: DataFrame, treatments: list[str], id_col: str = "doc_id",
                    pos_col: str = "pos") -> DataFrame:
    """``(treatment, doc_id, text)``: the documents of every treatment from one grouping."""
    ordered = F.array_sort(F.collect_list(F.struct(pos_col, *treatments)))
    grouped = prepared.groupBy(id_col).agg(ordered.alias("__t"))
    rows = F.array(*[
        F.struct(F.lit(t).alias("treatment"), F.array_join(F.col(f"__t.{t}"), " ").alias("text"))
        for t in treatments])
    return grouped.select(id_col, F.inline(rows))


def length_violations(long_tokens: DataFrame, treatments: int, id_col: str = "doc_id") -> DataFrame:
    """Documents whose token count differs between treatments, or that a treatment lacks."""
    sizes = long_tokens.groupBy(id_col, "treatment").agg(F.count("*").alias("n"))
    return sizes.groupBy(id_col).agg(
        F.count("*").alias("treatments"), F.min("n").alias("shortest"), F.max("n").alias("longest")
    ).filter((F.col("treatments") != treatments) | (F.col("shortest") != F.col("longest")))
