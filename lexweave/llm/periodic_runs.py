"""Periodic runs of words, and texts with their repetitions collapsed.

A run is a longest stretch of consecutive words with smallest period q (words q apart are identical) and at least
``REPEATS`` * q and ``LEAST`` words.  Each word of a run occurs ``REPEATS`` times in it, so a word that is rarer in
its segment is in no run and splits the segment; counts are taken anew in the pieces until nothing splits.

Surviving segments are scanned lag by lag in classes: for lags from m/2 to below m, words are named in groups of
m.  At the first position of a run of such a period its group recurs exactly one period later and not before, and
so it does up to m + q words from the run's end, for a group longer than a period that recurred earlier would give
the run a smaller period.  Positions that follow each other with the same distance therefore span whole runs.
A group also stands at two periods from a run's first word, so groups that occur less than three times in their
segment drop out, as rare words did, before they are paired into groups of twice the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexweave.llm.batches import bounded_batches
from lexweave.llm.hashed_words import (
    NON_SPACE, SLICE_BYTES, Powers, hash_spans, spans_of_words, text_buffer, text_slices,
)

REPEATS = 4      # periods in a run, at least
LEAST = 6        # words in a run, at least


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense name of each key, how often each name occurs, and the positions in order of name and place."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    name = np.cumsum(new) - 1
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = name
    return out, np.bincount(name), order


def surviving(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words left by recursive frequency splitting, in order, and the segment of each."""
    place, segment, word = np.arange(len(words)), text, words
    settled_places, settled_segments, numbered = [], [], 0
    while len(place):
        name, counts, _ = _names(segment * (np.int64(words.max()) + 1) + word)
        frequent = counts[name] >= REPEATS
        # segments that lose nothing are stable; the others are cut at their rare words and counted again
        stable = np.bincount(segment[~frequent], minlength=int(segment.max()) + 1)[segment] == 0
        settled_places.append(place[stable])
        settled_segments.append(numbered + segment[stable])
        numbered += int(segment.max()) + 1
        going = frequent & ~stable
        place, segment, word = place[going], segment[going], word[going]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (np.diff(place) != 1) | (segment[1:] != segment[:-1])
        segment = np.cumsum(new) - 1
        long = np.bincount(segment)[segment] >= LEAST if len(segment) else new
        place, word = place[long], word[long]
        segment = np.unique(segment[long], return_inverse=True)[1] if len(place) else segment[long]
    if not settled_places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, segment = np.concatenate(settled_places), np.concatenate(settled_segments)
    order = np.argsort(place)
    return place[order], segment[order]


def runs_in(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length and period of every run; ``words`` are names from 0, ``text`` the text of each word."""
    place, segment = surviving(words, text)
    starts, lengths, periods = [], [], []
    n, size = len(place), 1
    name = np.zeros(n, np.int64)
    if n:
        name, counts, _ = _names(segment * (np.int64(words.max()) + 1) + words[place])
    at = np.arange(n)       # positions whose group of ``size`` words is still in question
    while len(at):
        alive = np.zeros(n + size, dtype=bool)
        alive[at] = True
        at = at[alive[at + size]]
        at = at[segment[at] == segment[at + size]]
        named, counts, order = _names(name[at] * (n + 1) + name[at + size])
        size *= 2
        name[at] = named
        one, two = at[order[:-1]], at[order[1:]]
        lag = two - one
        found = (named[order[1:]] == named[order[:-1]]) & (lag >= size // 2) & (lag < size)
        one, lag = one[found], lag[found]
        turn = np.argsort(one, kind="stable")
        one, lag = one[turn], lag[turn]
        new = np.ones(len(one), dtype=bool)
        new[1:] = (np.diff(one) != 1) | (lag[1:] != lag[:-1])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(one))) - 1 + lag[first] + size
        whole = length >= np.maximum(LEAST, REPEATS * lag[first])
        starts.append(place[one[first[whole]]])
        lengths.append(length[whole])
        periods.append(lag[first[whole]])
        at = at[counts[named] >= 3] if len(at) else at
    if not starts:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    start, length, period = map(np.concatenate, (starts, lengths, periods))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _collapsed(buf: np.ndarray, start: np.ndarray, end: np.ndarray, kept: np.ndarray, text: np.ndarray,
               texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts made of the kept words, joined by one space."""
    start, end, text = start[kept], end[kept], text[kept]
    change = np.zeros(len(buf) + 2, dtype=np.int8)
    change[start] += 1
    followed = np.zeros(len(start), dtype=bool)     # by another kept word of its text
    followed[:-1] = text[1:] == text[:-1]
    # a followed word takes the separator behind it along, as a space
    change[end + followed] -= 1
    inside = np.cumsum(change[:len(buf)], dtype=np.int8) > 0
    out = buf.copy()
    out[end[followed]] = 0x20
    sizes = np.bincount(text, weights=end - start + followed, minlength=texts).astype(np.int64)
    return out[inside], np.concatenate([[0], np.cumsum(sizes)])


def _hashed(buf: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of the words, taken over about a megabyte of text at a time."""
    parts, i = [np.zeros(0, np.uint64)], 0
    while i < len(start):
        j = max(int(np.searchsorted(end, start[i] + SLICE_BYTES, side="right")), i + 1)
        base = start[i]
        parts.append(hash_spans(buf[base:end[j - 1]], start[i:j] - base, end[i:j] - base, powers))
        i = j
    return np.concatenate(parts)


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        keep = [i for i, n in enumerate(names) if n not in ("text", "n_words", "runs", "collapsed")]
        data, offsets = text_buffer(batch.column(names.index("text")))
        powers = Powers()
        for a, b in text_slices(offsets):
            buf, bounds = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            start, end = spans_of_words(buf, bounds, NON_SPACE) if len(buf) else (np.zeros(0, np.int64),) * 2
            first = np.searchsorted(start, bounds)
            counts = np.diff(first)
            text = np.repeat(np.arange(b - a), counts)
            words = _names(_hashed(buf, start, end, powers))[0]
            run, length, period = runs_in(words, text)
            change = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(change, run + period, 1)
            np.add.at(change, run + length, -1)
            flat, cuts = _collapsed(buf, start, end, np.cumsum(change[:-1]) == 0, text, b - a)
            of = text[run] if len(run) else run
            runs = pa.StructArray.from_arrays(
                [pa.array(run - first[of]), pa.array(length), pa.array(period)], ["start", "length", "period"])
            ends = pa.array(np.searchsorted(of, np.arange(b - a + 1)).astype(np.int32))
            texts = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(cuts), pa.py_buffer(flat)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).slice(a, b - a) for i in keep], pa.array(counts), pa.ListArray.from_arrays(ends, runs), texts],
                [*[names[i] for i in keep], "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns of every row, and ``n_words, runs, collapsed``.

    Words are what lies between white space (space, tab to carriage return); case counts.  ``runs`` is an array of
    ``start, length, period`` in words, by start and period; runs of different periods may overlap.  ``collapsed``
    holds the words that no run has behind its first period, joined by one space.  Null counts as the empty text:
    no words, no runs, an empty collapsed text.  Rows are handled one by one, so repeated rows give equal results
    and an empty table gives none; columns besides ``keep`` and the text are not read, and may have any name.  A text
    is worked on whole, in memory that grows with the longest text of a batch alone.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text_col).cast("string").alias("text"),
                       F.lit(0).cast("bigint").alias("n_words"),
                       F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs"),
                       F.lit("").alias("collapsed"))
    return rows.mapInArrow(_finder, rows.drop("text").schema).select("kept.*", "n_words", "runs", "collapsed")
