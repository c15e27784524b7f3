"""Benchmark decontamination: prefix-filtered join of item windows with documents.

A window is ``size`` consecutive words of an item (all words of a shorter one).  It occurs in a document only
if each of its shingles does, so one necessary shingle is enough as its prefix: the rarest over all documents.
Documents are searched for these prefix shingles only.  A match fixes where the window would have to start; it
must lie inside the document (positional and length bounds), and then all its words are compared.

The benchmark is taken in blocks of a bounded number of windows, each small enough to be sent to every task
whatever the benchmark's size; documents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lexweave.llm.batches import bounded_batches
from lexweave.llm.hashed_words import ALPHANUMERIC, runs_of, word_slices
from lexweave.llm.shipping import received, shared
from lexweave.session import materialised

WINDOW = 13
SHINGLE = 3
BLOCK_WINDOWS = 200_000      # windows in one block, in expectation, each counted once per item that has it
SHARE = 20                  # contaminated from one word in so many


def _item_windows(size: int):
    """A row for each window of each item."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts, hashes in word_slices(batch.column(1), ALPHANUMERIC):
                for k, (c, e) in enumerate(zip(counts.tolist(), np.cumsum(counts).tolist())):
                    if not c:
                        continue
                    span = min(size, c)
                    rows = np.lib.stride_tricks.sliding_window_view(hashes[e - c:e], span)
                    rows = np.unique(rows, axis=0) if len(rows) > 1 else rows
                    for at in range(0, len(rows), 4096):
                        part = np.ascontiguousarray(rows[at:at + 4096])
                        ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * 8 * span)
                        flat = pa.Array.from_buffers(pa.binary(), len(part), [None, ends.buffers()[1], pa.py_buffer(part.tobytes())])
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(first + k, 1).take(pa.array(np.zeros(len(part), np.int64))), flat], ["item", "words"])
    return windows


class Windows(NamedTuple):
    """Distinct windows of a block, and the items that have each."""

    items: list[str]
    owners: list[list[int]]
    words: list[np.ndarray]
    length: np.ndarray


def _grams(windows: Windows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By shingle size: the windows and a row of each one's shingles; a window shorter than a shingle is one."""
    out = {}
    for n in np.unique(windows.length).tolist():
        which = np.flatnonzero(windows.length == n)
        g = min(SHINGLE, n)
        flat = np.concatenate([windows.words[k] for k in which])
        # shingles across two windows are left out
        rows = np.concatenate([runs_of(flat, g), np.zeros(g - 1, np.uint64)]).reshape(len(which), n)[:, :n - g + 1]
        out.setdefault(g, []).append((which, rows))
    return out


def shingles(windows: Windows) -> dict[int, np.ndarray]:
    """Sorted distinct shingles by size."""
    return {g: np.unique(np.concatenate([rows.ravel() for _, rows in parts])) for g, parts in _grams(windows).items()}


def prefixes(windows: Windows, keys: dict[int, np.ndarray], counts: dict[int, np.ndarray]) -> dict[int, tuple]:
    """By shingle size: each window's rarest shingle, in order, with the window and the shingle's place in it."""
    out = {}
    for g, parts in _grams(windows).items():
        found = []
        for which, rows in parts:
            at = np.searchsorted(keys[g], rows)
            # the rarest; of equals the smallest shingle
            rank = counts[g][at] * np.int64(len(keys[g])) + at
            place = rank.argmin(axis=1)
            found.append((rows[np.arange(len(rows)), place], which, place))
        grams, which, place = map(np.concatenate, zip(*found))
        order = np.lexsort((place, which, grams))
        out[g] = grams[order], which[order], place[order]
    return out


def _counter(wanted_shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = received(wanted_shared)
        totals = {g: np.zeros(len(keys), dtype=np.int64) for g, keys in wanted.items()}
        for batch in batches:
            for _, _, hashes in word_slices(batch.column(0), ALPHANUMERIC):
                for g, keys in wanted.items():      # runs across two texts only blur an order
                    grams = runs_of(hashes, g)
                    at = np.searchsorted(keys, grams)
                    at[at == len(keys)] = 0
                    totals[g] += np.bincount(at[keys[at] == grams], minlength=len(keys))
        for g, keys in wanted.items():
            seen = np.flatnonzero(totals[g])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), g, dtype=np.int32)), pa.array(seen), pa.array(totals[g][seen])], ["g", "at", "n"])
    return count


def _matches(hashes, starts, ends, table, windows):
    """Windows that occur in the words of a slice: arrays of text, first word, window."""
    texts, firsts, which = [], [], []
    bounds = np.append(starts, ends[-1:])
    for g, (keys, owner, offset) in table.items():
        grams = runs_of(hashes, g)
        low = np.searchsorted(keys, grams, side="left")
        low[low == len(keys)] = 0
        here = np.flatnonzero(keys[low] == grams)
        if not here.size:
            continue
        left = np.searchsorted(keys, grams[here], side="left")
        many = np.searchsorted(keys, grams[here], side="right") - left
        turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(left, many) + turn
        place, window = np.repeat(here, many), owner[entry]
        first = place - offset[entry]
        text = np.searchsorted(bounds, place, side="right") - 1
        fits = (first >= starts[text]) & (first + windows.length[window] <= ends[text])
        text, first, window = text[fits], first[fits], window[fits]
        good = np.fromiter((np.array_equal(hashes[f:f + len(windows.words[w])], windows.words[w])
                            for f, w in zip(first, window)), dtype=bool, count=len(first))
        texts.append(text[good])
        firsts.append(first[good])
        which.append(window[good])
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(texts), np.concatenate(firsts), np.concatenate(which)


def _searcher(table_shared):
    """Adds a block's matches to ``n_words, spans, items``; ``spans`` are merged word ranges, flattened."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, table = received(table_shared)
        for batch in batches:
            names = batch.schema.names
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            spans = batch.column(names.index("spans")).to_pylist()
            items = batch.column(names.index("items")).to_pylist()
            for first_text, counts, hashes in word_slices(batch.column(names.index("text")), ALPHANUMERIC):
                n_words[first_text:first_text + len(counts)] = counts
                if not table or not len(hashes):
                    continue
                ends = np.cumsum(counts)
                starts = ends - counts
                text, first, window = _matches(hashes, starts, ends, table, windows)
                order = np.argsort(text, kind="stable")
                text, first, window = text[order], first[order], window[order]
                for t in np.unique(text):
                    a, b = np.searchsorted(text, [t, t + 1])
                    row = first_text + int(t)
                    begin = first[a:b] - starts[t]
                    spans[row] = _merge(spans[row], begin, begin + windows.length[window[a:b]])
                    owned = {windows.items[o] for w in np.unique(window[a:b]) for o in windows.owners[w]}
                    items[row] = sorted(owned.union(items[row]))
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[names.index("n_words")] = pa.array(n_words)
            columns[names.index("spans")] = pa.array(spans, pa.list_(pa.int64()))
            columns[names.index("items")] = pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)
    return search


def _merge(old: list[int], begin: np.ndarray, end: np.ndarray) -> list[int]:
    pairs = sorted([*zip(old[::2], old[1::2]), *zip(begin.tolist(), end.tolist())])
    out: list[int] = []
    for a, b in pairs:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_windows: int) -> Iterator[Windows]:
    """The benchmark's windows, made and merged in tasks, in blocks of about ``block_windows`` (window, item) pairs."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    pairs = items.filter(F.col("item").isNotNull() & F.col("text").isNotNull()).mapInArrow(
        _item_windows(window), "item string, words binary")
    found = materialised(pairs.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")
    total = found.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_windows))
    for k in range(blocks):     # windows fall into blocks by hash, also those of one long item
        rows = found.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).toArrow()
        owners = rows["items"].to_pylist()
        names = sorted({i for o in owners for i in o})
        number = {name: j for j, name in enumerate(names)}
        words = [np.frombuffer(w, dtype=np.uint64) for w in rows["words"].to_pylist()]
        yield Windows(names, [[number[i] for i in o] for o in owners], words, np.array([len(w) for w in words], dtype=np.int64))


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                      block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The ``keep`` columns of every row, and ``n_words, n_hit, items, contaminated``.

    ``items`` are the ids, as sorted strings, of items with a window in the text; ``n_hit`` counts words inside
    any occurrence.  A row is contaminated from one hit word in 20.  A null text has no words; an item whose id
    or text is null, or which has no words, has no windows.  Equal items each count.  Empty tables mark nothing.
    Columns not named are not read, so clashing names do no harm.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.struct(*keep).alias("kept"), F.col(text_col).cast("string").alias("text"),
                        F.lit(0).cast("bigint").alias("n_words"), F.array().cast("array<bigint>").alias("spans"),
                        F.array().cast("array<string>").alias("items"))
    schema = texts.schema
    plain = texts.select("text")
    for windows in _blocks(benchmark, item_col, item_text_col, window, block_windows):
        table = {}
        if windows.words:
            keys = shingles(windows)
            counts = {g: np.zeros(len(k), dtype=np.int64) for g, k in keys.items()}
            wanted = shared(spark, keys)
            # counted in the documents themselves, whatever blocks came before; a row per shingle of the block at most
            seen = plain.mapInArrow(_counter(wanted), "g int, at bigint, n bigint").groupBy("g", "at").agg(F.sum("n").alias("n")).toArrow()
            wanted.destroy()
            for g in keys:
                mine = seen.filter(pc.equal(seen["g"], g))
                counts[g][mine["at"].to_numpy()] = mine["n"].to_numpy()
            table = prefixes(windows, keys, counts)
        texts = texts.mapInArrow(_searcher(shared(spark, (windows, table))), schema)
    pair = F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2))
    n_hit = F.when(F.size("spans") > 0, F.aggregate(
        F.transform(pair, lambda i: F.get("spans", i + 1) - F.get("spans", i)), F.lit(0).cast("bigint"),
        lambda a, x: a + x)).otherwise(F.lit(0).cast("bigint"))
    marked = texts.select("kept.*", "n_words", n_hit.alias("n_hit"), "items")
    return marked.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))
