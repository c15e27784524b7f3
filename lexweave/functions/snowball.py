"""German and Russian Snowball stemming as chains of built-in column expressions.

The rules are the published ones (snowballstem.org).  A word is kept as a string plus the
start of its regions, so each step is one anchored regular expression on the region's text.
Run it on a vocabulary rather than on every token where possible (``treat.stem_vocabulary``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Suffix classes of the published algorithms.
GERMAN_VOWELS = "aeiouyäöü"
GERMAN_STEP1 = "ern|em|er|en|es|e|s"
GERMAN_STEP2 = "est|en|er|st"
GERMAN_STEP3 = "isch|lich|heit|keit|end|ung|ig|ik"
GERMAN_S_BEFORE = "bdfghklmnrt"
GERMAN_ST_BEFORE = "bdfghklmnt"

RUSSIAN_VOWELS = "аеиоуыэюя"
RUSSIAN_GERUND = "[иы](?:вшись|вши|в)|([ая])(?:вшись|вши|в)"
RUSSIAN_REFLEXIVE = "ся|сь"
RUSSIAN_ADJECTIVE = (
    "ими|ыми|его|ого|ему|ому|ее|ие|ые|ое|ей|ий|ый|ой|ем|им|ым|ом|их|ых|ую|юю|ая|яя|ою|ею"
)
RUSSIAN_PARTICIPLE = "[иы]вш|ующ|([ая])(?:ем|нн|вш|ющ|щ)"
RUSSIAN_VERB_AFTER_A = "ете|йте|ешь|нно|ла|на|ли|ем|ло|но|ет|ют|ны|ть|й|л|н"
RUSSIAN_VERB = (
    "ейте|уйте|ила|ыла|ена|ите|или|ыли|ило|ыло|ено|ует|уют|ены|ить|ыть|ишь|"
    "ей|уй|ил|ыл|им|ым|ен|ят|ит|ыт|ую|ю"
)
RUSSIAN_NOUN = (
    "иями|ями|ами|ией|иям|ием|иях|ев|ов|ие|ье|еи|ии|ей|ой|ий|ям|ем|ам|ом|ах|ях|ию|ью|ия|ья|"
    "а|е|и|й|о|у|ы|ь|ю|я"
)

_TMP = ["__w", "__p1", "__p2", "__s", "__r"]


def _cut(word: Column, n: Column) -> Column:
    """``word`` without its last ``n`` characters."""
    return F.substring(word, F.lit(1), F.length(word) - n)


def _tail(word: Column, start: Column) -> Column:
    return F.substring(word, start + 1, F.length(word))


def _region_start(word: Column, vowels: str, times: int) -> Column:
    """Offset behind the ``times``-th vowel + non-vowel pair; the length where there is none."""
    hit = F.regexp_extract(word, "^" + f"(?:.*?[{vowels}][^{vowels}])" * times, 0)
    return F.when(hit == "", F.length(word)).otherwise(F.length(hit))


def _finish(df: DataFrame, out: DataFrame, stem: Column, out_col: str) -> DataFrame:
    """Emit the stem from a one-element ``explode``.

    A filter on the stem cannot move below it.  Through the plain projections it would, and its
    copy of the whole chain would run once more, before any vocabulary was formed.
    """
    return out.select(*df.columns, F.explode(F.array(stem)).alias(out_col))


def german(df: DataFrame, word_col: str, out_col: str) -> DataFrame:
    word, p1, p2, suffix, region = (F.col(c) for c in _TMP)
    v = GERMAN_VOWELS

    marked = F.replace(F.lower(F.col(word_col)), F.lit("ß"), F.lit("ss"))
    # u and y between vowels count as consonants, decided from left to right; the mark is a symbol
    # that no token holds
    marked = F.regexp_replace(marked, f"([{v}])([uy])(?=[{v}])", "$1¤$2")
    marked = F.replace(F.replace(marked, F.lit("¤u"), F.lit("U")), F.lit("¤y"), F.lit("Y"))
    out = df.withColumn("__w", marked)
    out = (out.withColumn("__p1", F.least(F.greatest(_region_start(word, v, 1), F.lit(3)),
                                          F.length(word)))
              .withColumn("__p2", _region_start(word, v, 2)))

    out = out.withColumn("__s", F.regexp_extract(_tail(word, p1), f"(?:{GERMAN_STEP1})$", 0))
    out = out.withColumn(
        "__w",
        F.when(suffix.isin("en", "es", "e") & word.rlike("niss(?:en|es|e)$"),
               _cut(word, F.length(suffix) + 1))
        .when((suffix == "s") & ~word.rlike(f"[{GERMAN_S_BEFORE}]s$"), word)
        .otherwise(_cut(word, F.length(suffix))))

    out = out.withColumn("__s", F.regexp_extract(_tail(word, p1), f"(?:{GERMAN_STEP2})$", 0))
    out = out.withColumn(
        "__w",
        F.when((suffix == "st") & ~word.rlike(f"^.{{3,}}[{GERMAN_ST_BEFORE}]st$"), word)
        .otherwise(_cut(word, F.length(suffix))))

    out = out.withColumn("__r", _tail(word, p2))
    out = out.withColumn("__s", F.regexp_extract(region, f"(?:{GERMAN_STEP3})$", 0))
    plain = _cut(word, F.length(suffix))
    out = out.withColumn(
        "__w",
        F.when(suffix.isin("end", "ung") & region.rlike("(?:^|[^e])ig(?:end|ung)$"),
               _cut(word, F.length(suffix) + 2))
        .when(suffix.isin("ig", "ik", "isch") & region.rlike("e(?:ig|ik|isch)$"), word)
        .when(suffix.isin("lich", "heit") & _tail(word, p1).rlike("(?:er|en)(?:lich|heit)$"),
              _cut(word, F.length(suffix) + 2))
        .when((suffix == "keit") & region.rlike("lichkeit$"), _cut(word, F.length(suffix) + 4))
        .when((suffix == "keit") & region.rlike("igkeit$"), _cut(word, F.length(suffix) + 2))
        .otherwise(plain))
    return _finish(df, out, F.translate(word, "äöüUY", "aouuy"), out_col)


def russian(df: DataFrame, word_col: str, out_col: str) -> DataFrame:
    """Words without a Cyrillic letter pass through unchanged, case included."""
    head, _, p2, rest, _ = (F.col(c) for c in _TMP)
    v = RUSSIAN_VOWELS

    lowered = F.translate(F.lower(F.col(word_col)), "ё", "е")
    out = df.withColumn("__w", lowered)
    out = out.withColumn("__p2", _region_start(head, v, 2))
    out = out.withColumn("__s", F.regexp_extract(head, f"^(.*?[{v}])(.*)$", 2))
    out = out.withColumn("__w", _cut(head, F.length(rest)))

    adjectival = f"(?:{RUSSIAN_PARTICIPLE})?(?:{RUSSIAN_ADJECTIVE})$"
    verb = f"(?:([ая])(?:{RUSSIAN_VERB_AFTER_A})|(?:{RUSSIAN_VERB}))$"
    gerund = f"(?:{RUSSIAN_GERUND})$"
    bare = F.col("__r")
    out = out.withColumn("__r", F.regexp_replace(rest, f"(?:{RUSSIAN_REFLEXIVE})$", ""))
    out = out.withColumn(
        "__s",
        F.when(rest.rlike(gerund), F.regexp_replace(rest, gerund, "$1"))
        .when(bare.rlike(adjectival), F.regexp_replace(bare, adjectival, "$1"))
        .when(bare.rlike(verb), F.regexp_replace(bare, verb, "$1"))
        .otherwise(F.regexp_replace(bare, f"(?:{RUSSIAN_NOUN})$", "")))
    out = out.withColumn("__s", F.regexp_replace(rest, "и$", ""))
    derived = _tail(F.concat(head, rest), p2)
    out = out.withColumn(
        "__s", F.when(derived.rlike("ость?$"), F.regexp_replace(rest, "ость?$", "")).otherwise(rest))
    out = out.withColumn(
        "__s",
        F.when(rest.rlike("ейше?$"), F.regexp_replace(F.regexp_replace(rest, "ейше?$", ""), "нн$", "н"))
        .when(rest.rlike("нн$"), F.regexp_replace(rest, "нн$", "н"))
        .otherwise(F.regexp_replace(rest, "ь$", "")))
    stem = F.when(F.col(word_col).rlike(r"\p{IsCyrillic}"), F.concat(head, rest)).otherwise(F.col(word_col))
    return _finish(df, out, stem, out_col)


STEMMERS = {"de": german, "german": german, "ru": russian, "russian": russian}
