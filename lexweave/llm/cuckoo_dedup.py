"""Exact duplicates through a cuckoo-filter index of live digests.

The index is split into buckets by digest: by partition, and within one by the digest's first two bytes, in whose
order a task goes through them and drops each set of buckets once their content is sent.  A bucket holds a cuckoo filter (16-bit fingerprints, two
candidate slots of four entries) and its content: the full digests that are live, with the smallest id and
the number of rows of each.  A lookup asks the filter first; a hit is verified against the content, so a
false positive never joins two texts.  A full filter is rebuilt at twice the size from the stored keys.
Deletions take one row off a digest and remove its fingerprint when none is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SLOTS = 4            # entries per filter slot
MAX_KICKS = 200      # displacements before the filter counts as full
FIRST_SLOTS = 1024   # slots of a new filter; it doubles on overflow
PREFIX = 2           # leading bytes of a digest that name its bucket
HELD = 50_000        # live digests from which a task sends its complete buckets on


class CuckooFilter:
    """Fingerprints of byte strings with insertion, deletion and no false negatives."""

    def __init__(self, slots: int = FIRST_SLOTS):
        self.slots = slots                         # a power of two
        self.table = np.zeros((slots, SLOTS), dtype=np.uint16)
        self.count = 0
        self._turn = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        value = int.from_bytes(key[:16], "little")
        mark = (value & 0xFFFF) or 1
        first = (value >> 16) & (self.slots - 1)
        return mark, first, self._other(first, mark)

    def _other(self, slot: int, mark: int) -> int:
        return (slot ^ ((mark * 0x5BD1E995) & 0x7FFFFFFF)) & (self.slots - 1)

    def contains(self, key: bytes) -> bool:
        mark, first, second = self._places(key)
        return mark in self.table[first].tolist() or mark in self.table[second].tolist()

    def insert(self, key: bytes) -> bool:
        """False if no place was found; the caller then rebuilds the filter from its keys."""
        mark, first, second = self._places(key)
        for slot in (first, second):
            free = np.flatnonzero(self.table[slot] == 0)
            if free.size:
                self.table[slot, free[0]] = mark
                self.count += 1
                return True
        slot = first
        for _ in range(MAX_KICKS):
            self._turn = (self._turn + 1) % SLOTS
            mark, self.table[slot, self._turn] = int(self.table[slot, self._turn]), mark
            slot = self._other(slot, mark)
            free = np.flatnonzero(self.table[slot] == 0)
            if free.size:
                self.table[slot, free[0]] = mark
                self.count += 1
                return True
        return False

    def delete(self, key: bytes) -> bool:
        mark, first, second = self._places(key)
        for slot in (first, second):
            held = np.flatnonzero(self.table[slot] == mark)
            if held.size:
                self.table[slot, held[0]] = 0
                self.count -= 1
                return True
        return False


class DigestIndex:
    """Live digests of one bucket: filter in front, content behind."""

    def __init__(self):
        self.filter = CuckooFilter()
        self.content: dict[bytes, list] = {}       # digest -> [smallest id, rows]
        self.rebuilds = 0

    def find(self, key: bytes) -> list | None:
        return self.content.get(key) if self.filter.contains(key) else None

    def insert(self, key: bytes, doc_id, rows: int = 1) -> bool:
        """True if the digest is new; otherwise its entry takes the smaller id and the sum of rows."""
        entry = self.find(key)
        if entry is not None:
            if entry[0] is None or (doc_id is not None and doc_id < entry[0]):
                entry[0] = doc_id
            entry[1] += rows
            return False
        self.content[key] = [doc_id, rows]
        if not self.filter.insert(key):
            self._grow()
        return True

    def delete(self, key: bytes, rows: int = 1) -> bool:
        """Take ``rows`` rows off a digest; False if it is not live."""
        entry = self.find(key)
        if entry is None:
            return False
        entry[1] -= rows
        if entry[1] <= 0:
            del self.content[key]
            self.filter.delete(key)
        return True

    def _grow(self) -> None:
        slots = self.filter.slots
        while True:
            slots, self.rebuilds = slots * 2, self.rebuilds + 1
            fresh = CuckooFilter(slots)
            if all(fresh.insert(k) for k in self.content):
                self.filter = fresh
                return


def normalised(text: Column) -> Column:
    """Every run of white space (space, tab to carriage return) as one space; null as the empty text."""
    # runs that already are one space need no replacement
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task merged through an index of its own, so a hot group leaves a task as one row."""
    yield from _merged(batches, limit=200_000)


def _merged(batches: Iterator[pa.RecordBatch], limit: int | None = None) -> Iterator[pa.RecordBatch]:
    index = DigestIndex()
    for batch in batches:
        _apply(index, *[batch.column(i).to_pylist() for i in range(3)])
        if limit and len(index.content) >= limit:
            yield _batch(index)
            index = DigestIndex()
    yield _batch(index)


def _apply(index: DigestIndex, keys: list, ids: list, changes: list) -> None:
    for key, doc_id, rows in zip(keys, ids, changes):
        if rows >= 0:
            index.insert(key, doc_id, rows)
        else:
            index.delete(key, -rows)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their bucket: what is held is ``HELD`` digests and one bucket, whatever the task's share."""
    index, last = DigestIndex(), None
    for batch in batches:
        keys, ids, changes = [batch.column(i).to_pylist() for i in range(3)]
        start = 0
        for at, key in enumerate(keys):
            if key[:PREFIX] != last:
                # all buckets before this one are complete
                _apply(index, keys[start:at], ids[start:at], changes[start:at])
                start, last = at, key[:PREFIX]
                if len(index.content) >= HELD:
                    yield _batch(index)
                    index = DigestIndex()
        _apply(index, keys[start:], ids[start:], changes[start:])
    yield _batch(index)


def _batch(index: DigestIndex) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(index.content), pa.binary()),
         pa.array([e[0] for e in index.content.values()], pa.int64()),
         pa.array([e[1] for e in index.content.values()], pa.int64())], ["digest", "keep_id", "rows"])


_SCHEMA = "digest binary, keep_id bigint, rows bigint"


def build_index(digests: DataFrame) -> DataFrame:
    """``digest, keep_id, rows`` of the live digests; input ``digest, doc_id, rows``.

    Positive ``rows`` insert, negative ones delete.  A digest's changes are applied together, insertions
    first, so the order in which a shuffle brings them does not matter.
    """
    changes = digests.select("digest", "doc_id", F.col("rows").cast("bigint").alias("rows"))
    # deletions wait until a digest's insertions are in: they skip the merging inside map tasks
    added = changes.filter("rows >= 0").mapInArrow(_partials, _SCHEMA)
    gone = changes.filter("rows < 0").selectExpr("digest", "doc_id AS keep_id", "rows")
    return _indexed(added.unionByName(gone))


def _indexed(partials: DataFrame) -> DataFrame:
    bucket, gone = F.substring("digest", 1, PREFIX), F.col("rows") < 0
    ordered = (partials.repartition("digest").withColumn("bucket", bucket).withColumn("gone", gone)
               .sortWithinPartitions("bucket", "gone").drop("bucket", "gone"))
    return ordered.mapInArrow(_by_bucket, _SCHEMA)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Texts are equal when their white-space-normalised forms are; null counts as empty.  The row of the
    smallest id stays.  Rows repeated with the same id share group and ``keep_id``; each counts in
    ``group_size`` and each is marked kept.  A null id never is the kept one unless its whole group has none.
    Only the id and text columns are read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest"))
    live = (rows.select("digest", "doc_id", F.lit(1).cast("bigint").alias("rows"))
            .mapInArrow(_partials, _SCHEMA))
    index = _indexed(live)
    # the row side may be skewed on a hot digest, the index side has one row per digest: Spark splits the former
    return (rows.join(index.hint("merge"), "digest")
            .select("doc_id", "keep_id", F.col("rows").alias("group_size"),
                    F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))
