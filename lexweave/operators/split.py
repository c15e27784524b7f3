"""Splitting documents into passages.  Each splitter works inside one row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexweave.functions import text as T
from lexweave.functions.patterns import BLANK, NON_SPACE

DEFAULT_WORD_COUNT = 500
DEFAULT_LINE_COUNT = 10


def _unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression used inside a lambda is otherwise computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count_passages(text: Column, word_count: int = DEFAULT_WORD_COUNT) -> Column:
    """Passages of exactly ``word_count`` words; the last may be shorter."""
    def cut(words: Column) -> Column:
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), F.lit(word_count))
                        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.array_join(F.slice(words, s, word_count), " "))

    return _bind(T.tokenise(text, NON_SPACE), cut)


def line_break_passages(text: Column) -> Column:
    """Passages between blank lines.

    Text that is empty or ends in a blank line yields a last passage without words.
    """
    clean = _unix_lines(text)
    pieces = F.transform(F.split(clean, rf"\n(?:{BLANK}*\n)+"), lambda p: T.retokenise(p, NON_SPACE))
    ends_blank = (clean == "") | clean.rlike(rf"(?:\A|\n)(?:{BLANK}+|{BLANK}*\n)\z")
    return F.concat(F.filter(pieces, lambda p: p != ""),
                    F.when(ends_blank, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))


def line_count_passages(text: Column, line_count: int = DEFAULT_LINE_COUNT,
                        min_word_count: int = DEFAULT_WORD_COUNT) -> Column:
    """Passages of at least ``line_count`` non-blank lines and ``min_word_count`` words.

    A fold over the lines keeps the start of each passage; a short tail is kept.
    """
    def step(state: Column, size: Column) -> Column:
        full = (state["lines"] >= line_count) & (state["words"] >= min_word_count)
        fresh = full | (state["row"] == 0)
        return F.struct(
            (state["row"] + 1).alias("row"),
            F.when(fresh, F.concat(state["starts"], F.array(state["row"] + 1)))
             .otherwise(state["starts"]).alias("starts"),
            F.when(fresh, F.lit(1)).otherwise(state["lines"] + 1).alias("lines"),
            F.when(fresh, size).otherwise(state["words"] + size).alias("words"))

    start = F.struct(F.lit(0).alias("row"), F.array().cast("array<int>").alias("starts"),
                     F.lit(0).alias("lines"), F.lit(0).alias("words"))
    def starts_of(lines: Column) -> Column:
        return F.aggregate(F.transform(lines, F.size), start, step, lambda s: s["starts"])

    def cut(bound: Column) -> Column:
        lines, starts = bound["lines"], bound["starts"]

        def passage(first: Column, nth: Column) -> Column:
            length = F.coalesce(F.get(starts, nth + 1), F.size(lines) + 1) - first
            return F.array_join(F.flatten(F.slice(lines, first, length)), " ")

        return F.transform(starts, passage)

    lines = F.transform(
        F.filter(F.split(_unix_lines(text), "\n"), lambda s: ~s.rlike(rf"\A{BLANK}*\z")),
        lambda s: T.tokenise(s, NON_SPACE))
    with_starts = _bind(lines, lambda ls: F.struct(ls.alias("lines"), starts_of(ls).alias("starts")))
    return _bind(with_starts, cut)


SPLITTERS = ("word_count", "line_break", "line_count")


def split_documents(docs: DataFrame, how: str = "line_count", word_count: int = DEFAULT_WORD_COUNT,
                    line_count: int = DEFAULT_LINE_COUNT, id_col: str = "doc_id",
                    label_col: str = "label", text_col: str = "text") -> DataFrame:
    """``(doc_id, label, text)`` per passage, with ids ``<document>_<0-based number>``."""
    text = F.col(text_col)
    if how == "word_count":
        passages = word_count_passages(text, word_count)
    elif how == "line_break":
        passages = line_break_passages(text)
    elif how == "line_count":
        passages = line_count_passages(text, line_count, word_count)
    else:
        raise ValueError(f"unsupported splitter: {how}")
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(label_col).alias("label"),
                       F.posexplode(passages).alias("__nth", "text"))
    return rows.select(F.concat_ws("_", "__doc", "__nth").alias("doc_id"), "label", "text")
