"""Packing documents into training sequences: bounded-space online best fit.

A document is its token ids and an end id.  Each partition keeps a fixed number of open windows.  Whole windows of
a long document close at once; the rest goes to the open window whose room it fits best.  Where none has room, a
new window is opened, and once all are open the fullest is filled with the document's first ids and emitted, and
what remains is placed anew.  So a document is cut only at a full window or where it fits nowhere.

Windows still open at a partition's end are merged: those of ``FAN_IN`` neighbouring partitions are packed in the
same way, each window an item, and the leftovers of that again, until one group is left.  Its last windows are cut
into sequences whose lengths are powers of two, which are not padded.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexweave.llm.batches import bounded_batches
from lexweave.llm.token_ids import Encoder, public_vocabulary, shared_vocabulary
from lexweave.session import materialised

WINDOW = 1024            # tokens of a sequence, a power of two
OPEN_WINDOWS = 32        # windows a partition keeps open
FAN_IN = 64              # partitions whose leftovers are merged together
END_ID = 0
_ROUND, _GROUP = 58, 33  # bits below the round and the group in a sequence id

_PIECES = ("sequence_id bigint, offset bigint, id bigint, start bigint, length bigint, doc_tokens bigint, "
           "ids binary, open boolean, part bigint")


class Windows:
    """A bounded number of open windows; an item is a list of pieces ``(id, start, doc_tokens, ids)``."""

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most
        self.rooms: list[tuple[int, int]] = []          # (room, number), the fullest first
        self.held: dict[int, list] = {}
        self.number = 0

    def _open(self) -> int:
        self.number += 1
        self.held[self.number] = []
        return self.number

    def place(self, item: list, size: int) -> Iterator[list]:
        """Puts the item away; yields the windows that are full then."""
        while size:
            at = bisect_left(self.rooms, (size, 0))
            if size >= self.window:
                full, item = _cut(item, self.window)
                size -= self.window
                yield full
            elif at == len(self.rooms) == self.most:    # none fits: the fullest is filled and emitted
                room, number = self.rooms.pop(0)
                head, item = _cut(item, room)
                size -= room
                yield self.held.pop(number) + head
            else:
                room, number = self.rooms.pop(at) if at < len(self.rooms) else (self.window, self._open())
                # copies, so that a window does not keep whole documents
                self.held[number] += [(doc, start, tokens, ids.copy()) for doc, start, tokens, ids in item]
                if room == size:
                    yield self.held.pop(number)
                else:
                    insort(self.rooms, (room - size, number))
                size = 0

    def rest(self) -> list[list]:
        """The windows still open, the fullest first."""
        return [self.held[number] for _, number in self.rooms]


def _cut(item: list, size: int) -> tuple[list, list]:
    head, tail = [], list(item)
    while size:
        doc, start, tokens, ids = tail[0]
        if len(ids) <= size:
            head.append(tail.pop(0))
            size -= len(ids)
        else:
            head.append((doc, start, tokens, ids[:size]))
            tail[0] = (doc, start + size, tokens, ids[size:])
            size = 0
    return head, tail


class _Rows:
    """Pieces of windows as Arrow batches."""

    def __init__(self, base: int):
        self.base, self.sequence, self.rows = base, 0, []

    def add(self, pieces: list, part: int | None = None) -> None:
        offset = 0
        for doc, start, tokens, ids in pieces:
            self.rows.append((self.base + self.sequence, offset, doc, start, len(ids), tokens,
                              ids.astype("<u4").tobytes(), part is not None, part))
            offset += len(ids)
        self.sequence += 1

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 9
        self.rows = []
        kinds = [*[pa.int64()] * 6, pa.binary(), pa.bool_(), pa.int64()]
        names = ["sequence_id", "offset", "id", "start", "length", "doc_tokens", "ids", "open", "part"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _packer(vocabulary, window: int, most: int, end_id: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows = Encoder(vocabulary.value), Windows(window, most)
        part = TaskContext.get().partitionId()
        rows = _Rows(part << _GROUP)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encoder.ids(text.as_py() or ""), end])
                for full in windows.place([(doc, 0, len(ids), ids)], len(ids)):
                    rows.add(full)
                if len(rows.rows) >= 512:
                    yield rows.batch()
        for left in windows.rest():
            rows.add(left, part)
        yield rows.batch()
    return pack


def _merger(window: int, most: int, level: int, last: bool):
    """Packs the open windows of each group (``part``), which come sorted by group, sequence and offset."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sequence, item, windows, rows = None, None, [], None, None

        def away():
            for full in windows.place(item, sum(len(p[3]) for p in item)):
                rows.add(full)

        def close():
            if last:        # what is left over at the very end: full windows, then powers of two
                left = [p for w in windows.rest() for p in w]
                size = sum(len(p[3]) for p in left)
                while size:
                    length = window if size >= window else 1 << (size.bit_length() - 1)
                    head, left = _cut(left, length)
                    rows.add(head)
                    size -= length
            else:
                for w in windows.rest():
                    rows.add(w, group)

        for row in (row for batch in batches for row in batch.to_pylist()):
            if row["part"] != group:
                if group is not None:
                    away()
                    close()
                    yield rows.batch()
                group, sequence, item = row["part"], None, []
                windows, rows = Windows(window, most), _Rows((level << _ROUND) + (group << _GROUP))
            if row["sequence_id"] != sequence:
                if item:
                    away()
                sequence, item = row["sequence_id"], []
            item.append((row["id"], row["start"], row["doc_tokens"], np.frombuffer(row["ids"], dtype="<u4")))
        if group is not None:
            away()
            close()
            yield rows.batch()
    return merge


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
         window: int = WINDOW, open_windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens, sequence_id, offset`` of every piece.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers, ``start`` the number of its
    document's ids before it, ``doc_tokens`` the document's ids with the end id, ``offset`` the piece's place in its
    sequence.  Sequences are full, or as long as a power of two.  Null counts as the empty text, which is the end
    id alone.  Rows of equal or null ids are documents of their own.  An empty table gives no rows; only the two
    columns are read.  A task holds one document and ``open_windows`` windows, a merging task the windows of one
    group; the pieces are written once, so that closed and open windows come from the same packing.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    shared = shared_vocabulary(spark, vocabulary or public_vocabulary())
    pieces = materialised(texts.mapInArrow(_packer(shared, window, open_windows, end_id), _PIECES), "packed")
    closed, left, level = [pieces.filter(~F.col("open"))], pieces.filter("open"), 0
    most = pieces.agg(F.max("part")).first()[0]
    groups = 0 if most is None else most + 1
    while groups:
        level += 1
        groups = -(-groups // fan_in)
        grouped = left.withColumn("part", F.floor(F.col("part") / fan_in))
        ordered = grouped.repartition("part").sortWithinPartitions("part", "sequence_id", "offset")
        merged = materialised(ordered.mapInArrow(_merger(window, open_windows, level, groups == 1), _PIECES), "merged")
        closed.append(merged.filter(~F.col("open")))
        left = merged.filter("open")
        if groups == 1:
            break
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out.select(F.col("id").alias("doc_id"), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def padding(length: Column, window: int = WINDOW) -> Column:
    """Tokens added to a sequence of this length: none at a power of two."""
    return F.when(F.bit_count(length) == 1, F.lit(0)).otherwise(F.lit(window) - length)
