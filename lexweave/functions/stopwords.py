"""Stop lists per language as plain lists and as a ``(lang, word)`` table."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# the default lists of Apache Spark's StopWordsRemover, one word per line
_FOLDER = Path(__file__).with_name("stoplists")

_LANGUAGES = {
    "ru": "russian", "russian": "russian",
    "de": "german", "german": "german",
    "en": "english", "english": "english",
    "fr": "french", "french": "french",
    "es": "spanish", "spanish": "spanish",
}

# Additions to the Russian base list.
RUSSIAN_EXTRAS = [
    "без", "ведь", "всегда", "где", "даже", "из-за", "из-под", "иногда", "ли",
    "над", "назад", "нечего", "ни", "никем", "никого", "никому", "ничего", "ничем",
    "ничему", "ничто", "ну", "обо", "очень", "под", "пока", "после", "потому", "почему",
    "со", "также", "там", "тоже", "тут", "хотя", "часто", "через",
]


@lru_cache
def _base_list(name: str) -> frozenset[str]:
    lines = (_FOLDER / f"{name}.txt").read_text(encoding="utf-8").splitlines()
    return frozenset(w.strip().lower() for w in lines)


def stopwords(language: str) -> list[str]:
    """Sorted, down-cased stop words; an unknown language has none."""
    name = _LANGUAGES.get(language.lower())
    if name is None:
        return []
    words = set(_base_list(name))
    if name == "russian":
        words.update(RUSSIAN_EXTRAS)
    words.discard("")
    return sorted(words)


def stop_lists(languages) -> dict[str, list[str]]:
    return {lang: stopwords(lang) for lang in languages}


def stopword_table(spark: SparkSession, languages) -> DataFrame:
    """Small fixed table: a few hundred words per language."""
    rows = [(lang, word) for lang, words in stop_lists(languages).items() for word in words]
    return spark.createDataFrame(rows, "lang string, word string")
