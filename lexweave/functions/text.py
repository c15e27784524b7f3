"""Column -> Column functions on text, tokens and morphology.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexweave.functions.patterns import PUNCTUATION, WORD

SLOT_SEP = ","
ANALYSIS_SEP = "|"


def tokenise(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def count_tokens(text: Column, pattern: str = WORD) -> Column:
    return F.size(tokenise(text, pattern)).cast("bigint")


def retokenise(text: Column, pattern: str = WORD) -> Column:
    return F.array_join(tokenise(text, pattern), " ")


def strip_punctuation(text: Column, marks: str = PUNCTUATION) -> Column:
    return F.translate(text, marks, "")


def downcase(col: Column) -> Column:
    return F.lower(col)


def truncate(token: Column, num_chars: int = 5) -> Column:
    return F.substring(token, 1, num_chars)


def is_word(token: Column, pattern: str = WORD) -> Column:
    """The whole token, not a part of it, has the shape of a word."""
    return token.rlike(rf"\A(?:{pattern})\z")


def lemma_or_token(lemma: Column, token: Column) -> Column:
    """Trimmed lemma; the token itself where the lemma is missing or empty."""
    return F.coalesce(F.nullif(F.trim(lemma), F.lit("")), token)


def lemma_unless_dashes(lemma: Column, surface: Column) -> Column:
    """Unknown or foreign words carry a lemma made of dashes only: keep the surface form."""
    return F.when(lemma.rlike(r"\A-+\z"), surface).otherwise(lemma)


def morph_string(pos: Column, morph: Column) -> Column:
    """``pos`` and dot-separated features as one comma-separated analysis."""
    return F.concat_ws(SLOT_SEP, pos, F.replace(morph, F.lit("."), F.lit(SLOT_SEP)))


def pos_tag(slot: Column) -> Column:
    """Part of speech: what precedes the first ``,`` or ``=`` (of the first analysis)."""
    return F.split(slot, "[,=]").getItem(0)


def drop_stress(surface: Column) -> Column:
    return F.replace(surface, F.lit("`"), F.lit(""))


def join_analyses(values: Column) -> Column:
    return F.array_join(values, ANALYSIS_SEP)


def token_pairs(text: Column, normalise, pattern: str = WORD) -> Column:
    """``array<struct<token,normalized>>`` with empty normal forms dropped."""
    pairs = F.transform(
        tokenise(text, pattern),
        lambda t: F.struct(t.alias("token"), normalise(t).alias("normalized")),
    )
    return F.filter(pairs, lambda p: F.trim(p["normalized"]) != "")
