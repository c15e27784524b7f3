"""Language identification with a bit-sliced Bloom filter of n-grams.

The filter is one array of slots; a slot holds a bit for each language.  An n-gram of a language sets that
language's bit in ``HASHES`` slots, and the AND of an n-gram's slots returns all languages that contain it at
once.  A text's n-grams are counted per language (popcounts), each count is corrected for the language's rate
of false positives, and the highest corrected share decides.

An n-gram is four bytes of lower-cased letters with runs of anything else as one space; a language has its
``GRAMS`` most frequent ones.  Training reads at most about ``SAMPLE`` texts of each language, chosen by a hash
of the id in proportion to the language's row count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexweave.llm.batches import bounded_batches
from lexweave.llm.hashed_words import LOWER, mix, text_buffer, text_slices
from lexweave.llm.shipping import received, shared

GRAMS = 4000         # n-grams of a language
SAMPLE = 4000        # training texts of a language, in expectation
SLOTS = 1 << 17      # slots of the filter
HASHES = 3
FOLDS = 5            # rows whose id falls in fold 0 are held out

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_MAPPED = np.where(_LETTER[LOWER], LOWER, 32).astype(np.uint8)


def grams_of(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of the texts in ``buf``, and how many each text has."""
    low = _MAPPED[buf]
    if len(low) > 1:    # capitals of the Latin-1 letters, in UTF-8 behind byte C3
        capital = (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97) & (low[:-1] == 0xC3)
        low[1:][capital] += 32
    # a space before every text, so that its first word counts as one
    low = np.insert(low, bounds[:-1], 32)
    first = bounds[:-1] + np.arange(len(bounds) - 1)
    # runs of spaces become one
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    keep[first] = True
    new = np.cumsum(keep) - 1
    low, starts = low[keep].astype(np.uint32), new[first]
    n = len(low) - 3
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
    grams = low[:n] | (low[1:n + 1] << np.uint32(8)) | (low[2:n + 2] << np.uint32(16)) | (low[3:] << np.uint32(24))
    ends = np.append(starts[1:], len(low))
    inside = np.maximum(ends - starts - 3, 0)
    text = np.repeat(np.arange(len(starts)), inside)
    place = np.arange(len(text)) - np.repeat(np.cumsum(inside) - inside, inside)
    return grams[starts[text] + place], inside


def slices_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = text_buffer(column)
    for a, b in text_slices(offsets):
        if offsets[b] - offsets[a] > 8 << 20:     # one very long text: its n-grams in pieces, summed by the caller
            for at in range(offsets[a], offsets[b], 4 << 20):
                piece = data[at:min(at + (4 << 20), offsets[b])]
                grams, counts = grams_of(piece, np.array([0, len(piece)]))
                yield a, counts, grams
        else:
            grams, counts = grams_of(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            yield a, counts, grams


@dataclass
class LanguageModel:
    languages: list[str]
    default: int                 # the language of most training rows, for texts without n-grams
    slots: np.ndarray            # planes x slots of 64 language bits
    false_rate: np.ndarray       # chance that a language's bits answer yes to an unknown n-gram


def _places(grams: np.ndarray, slots: int) -> list[np.ndarray]:
    value = mix(grams.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    step = (value >> np.uint64(32)) | np.uint64(1)
    return [((value + np.uint64(j) * step) & np.uint64(slots - 1)).astype(np.int64) for j in range(HASHES)]


def build_filter(languages: list[str], sets: list[np.ndarray], default: int, slots: int = SLOTS) -> LanguageModel:
    planes = np.zeros((-(-len(languages) // 64), slots), dtype=np.uint64)
    rate = np.zeros(len(languages))
    for k, grams in enumerate(sets):
        plane, bit = planes[k // 64], np.uint64(1 << (k % 64))
        for place in _places(grams, slots):
            plane[place] |= bit
        rate[k] = (np.count_nonzero(plane & bit) / slots) ** HASHES
    return LanguageModel(languages, default, planes, rate)


def shares(model: LanguageModel, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Texts x languages: n-grams answered yes."""
    text = np.repeat(np.arange(len(counts)), counts)
    places = _places(grams, model.slots.shape[1])
    out = np.zeros((len(counts), len(model.languages)), dtype=np.int64)
    for p, plane in enumerate(model.slots):
        masks = plane[places[0]]
        for place in places[1:]:
            masks &= plane[place]
        for bit in range(min(64, len(model.languages) - 64 * p)):
            yes = (masks >> np.uint64(bit)) & np.uint64(1)
            out[:, 64 * p + bit] = np.bincount(text[yes.astype(bool)], minlength=len(counts))
    return out


def fold_of(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang, grams, counts):
        if lang in held:
            grams = np.concatenate([held[lang][0], grams])
            counts = np.concatenate([held[lang][1], counts])
        keys, where = np.unique(grams, return_inverse=True)
        held[lang] = keys, np.bincount(where, weights=counts, minlength=len(keys)).astype(np.int64)

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for first, counts, grams in slices_of(batch.column(1)):
            names = np.repeat(langs[first:first + len(counts)], counts)
            for lang in set(langs[first:first + len(counts)]):
                keys, n = np.unique(grams[names == lang], return_counts=True)
                add(lang, keys, n)
    for lang, (keys, n) in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE, grams: int = GRAMS) -> LanguageModel:
    """Learn from the rows with a language that are not held out.  No such rows: a model without languages."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("id")) != 0))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], 0, np.zeros((0, SLOTS), dtype=np.uint64), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / sizes[k]))]), F.col("lang"))
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)
    counted = (chosen.select("lang", "text").mapInArrow(_gram_counts, "lang string, gram bigint, n bigint")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("rank", rank).filter(F.col("rank") <= grams).select("lang", "gram").collect()
    sets: dict[str, list[int]] = {k: [] for k in languages}
    for r in top:
        sets[r["lang"]].append(r["gram"])
    default = max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k))
    return build_filter(languages, [np.array(sorted(sets[k]), dtype=np.uint32) for k in languages], default)


def _predictor(trained):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = received(trained)
        for batch in batches:
            names = batch.schema.names
            hits = np.zeros((batch.num_rows, len(model.languages)), dtype=np.int64)
            total = np.zeros(batch.num_rows, dtype=np.int64)
            for first, counts, grams in slices_of(batch.column(names.index("text"))):
                hits[first:first + len(counts)] += shares(model, grams, counts)
                total[first:first + len(counts)] += counts
            share = hits / np.maximum(total, 1)[:, None]
            share = np.clip((share - model.false_rate) / (1 - model.false_rate), 0, 1)
            best = np.where(total > 0, share.argmax(axis=1), model.default)
            score = np.where(total > 0, share.max(axis=1), 0.0)
            known = np.array(batch.column(names.index("letters")).to_pylist(), dtype=bool)
            lang = np.where(known, np.array(model.languages, dtype=object)[best], "und")
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[names.index("lang_pred")] = pa.array(lang.tolist(), pa.string())
            columns[names.index("score")] = pa.array(np.where(known, score, 0.0))
            columns[names.index("n_grams")] = pa.array(total)
            keep = [i for i, n in enumerate(names) if n not in ("text", "letters")]
            yield pa.RecordBatch.from_arrays([columns[i] for i in keep], [names[i] for i in keep])
    return predict


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row, and ``lang_pred, score, n_grams`` (of the text).

    Only the text is an input of the prediction.  A text that is null or has no letters is ``und`` with score 0;
    so is every text if the model has no languages.  A text with letters but no n-gram gets the language of most
    training rows and score 0.  Equal shares go to the first language in order of names.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct(*keep).alias("kept"), text.alias("text"),
                       F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"),
                       F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("n_grams"))
    if model.languages:
        schema = rows.drop("text", "letters").schema
        rows = rows.mapInArrow(_predictor(shared(spark, model)), schema)
    return rows.select("kept.*", "lang_pred", "score", "n_grams")
