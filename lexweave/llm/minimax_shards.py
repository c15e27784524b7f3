"""Sharding by minimax contiguous partition (DataFrame functions only).

Rows with equal texts form an atomic group.  Groups are ordered by the SHA-256 of their text, an order
every row can compute for itself, so no global sort and no join back to the rows is needed.  The smallest
feasible shard capacity over that order is found by binary search with a greedy check, and the cuts are
digest prefixes: a row's shard is the number of cuts not above its digest.

The search never sees all groups at once.  Groups are first summed into blocks of a common digest prefix
(a fixed number of blocks), which brackets the capacity and each cut; only blocks inside a bracket are
split further, until no bracket holds a block of several groups.  What reaches the driver is bounded by
the number of blocks per level, whatever the input's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexweave.session import materialised

FIRST_DIGITS = 4     # 16**4 blocks on the first level
NEXT_DIGITS = 2      # each block of a bracket is split 16**2 ways on the next
ROW_OVERHEAD = 8     # bytes a row counts beside its text
SLOT_SALTS = 16      # rows of one hot digest are numbered in so many tasks
DIGEST_LENGTH = 64


@dataclass
class Units:
    """Consecutive blocks in digest order: prefix, bytes, number of groups, largest group."""
    prefix: list[str]
    size: np.ndarray
    groups: np.ndarray
    largest: np.ndarray


def _ends(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def greedy_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Unit indexes at which a greedy filling starts a new shard; None if it needs more than ``shards``."""
    cuts, at, last = [], 0, len(ends) - 1
    while True:
        reach = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        if reach >= last:
            return cuts
        if reach == at or len(cuts) == shards - 1:
            return None
        cuts.append(reach)
        at = reach


def smallest_capacity(ends: np.ndarray, largest: int, shards: int) -> int:
    """Binary search for the smallest capacity with which the greedy filling succeeds."""
    low, high = max(largest, -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts within ``capacity`` that lie as near to an even share of what remains as the capacity allows.

    ``must[k]`` is the first unit from which the rest still fits into the shards left after the k-th cut.
    """
    last = len(ends) - 1
    must, at = [last], last
    for _ in range(shards - 1):
        at = int(np.searchsorted(ends, ends[at] - capacity, side="left"))
        must.append(max(at, 0))
    must = must[::-1]
    cuts, at = [], 0
    for k in range(shards - 1):
        goal = ends[at] + (ends[-1] - ends[at]) / (shards - k)
        near = int(np.searchsorted(ends, goal, side="left"))
        if near > at and abs(ends[near - 1] - goal) <= abs(ends[near] - goal):
            near -= 1
        reach = int(np.searchsorted(ends, ends[at] + capacity, side="right")) - 1
        at = min(max(near, must[k], at), reach)
        cuts.append(at)
    return cuts


def _brackets(units: Units, capacity: int, floor: int, shards: int) -> list[tuple[int, int]]:
    """Unit ranges that hold each cut for any capacity between ``floor`` and ``capacity``, and the even cuts."""
    ends, last, found = _ends(units.size), len(units.size), []
    low = high = 0
    for _ in range(shards - 1):
        low = max(low, int(np.searchsorted(ends, ends[low] + floor, side="right")) - 1)
        high = min(last, int(np.searchsorted(ends, ends[high] + capacity, side="left")))
        found.append((min(low, last), high))
    found += [(max(c - 1, 0), min(c + 1, last)) for c in even_cuts(ends, capacity, shards)]
    return found


def _units(groups: DataFrame, digits: int) -> DataFrame:
    return (groups.groupBy(F.substring("digest", 1, digits).alias("prefix"))
            .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("bytes").alias("top")))


def _collected(rows: DataFrame) -> Units:
    got = sorted(rows.collect(), key=lambda r: r["prefix"])
    return Units([r["prefix"] for r in got], *[np.array([r[c] for r in got], dtype=np.int64)
                                               for c in ("bytes", "n", "top")])


def _merged(old: Units, split: set[int], new: Units) -> Units:
    keep = [i for i in range(len(old.prefix)) if i not in split]
    rows = sorted([(old.prefix[i], old.size[i], old.groups[i], old.largest[i]) for i in keep]
                  + list(zip(new.prefix, new.size, new.groups, new.largest)))
    return Units([r[0] for r in rows], *[np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3)])


def minimax_cuts(groups: DataFrame, shards: int) -> list[str]:
    """Digest prefixes at which shards 1, 2, ... begin; ``groups`` has ``digest`` and ``bytes``."""
    digits = FIRST_DIGITS
    units = _collected(_units(groups, digits))
    if not units.prefix:
        return []
    while True:
        ends, top = _ends(units.size), int(units.largest.max())
        capacity = smallest_capacity(ends, int(units.size.max()), shards)
        multi = units.groups > 1
        # a cut inside a block can move to the end away from its largest group, at either side of a shard
        slack = 2 * int((units.size - units.largest)[multi].max()) if multi.any() else 0
        floor = max(top, -(-int(ends[-1]) // shards), capacity - slack)
        ranges = _brackets(units, capacity, floor, shards) if digits < DIGEST_LENGTH else []
        # a block heavier than the floor may hold back the capacity wherever it lies
        ranges += [(int(i), int(i)) for i in np.flatnonzero(multi & (units.size > floor))] if digits < DIGEST_LENGTH else []
        runs: list[list[int]] = []
        for a, b in sorted((a, min(b, len(units.prefix) - 1)) for a, b in ranges):
            if multi[a:b + 1].any():
                if runs and a <= runs[-1][1] + 1:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
        split = {i for a, b in runs for i in range(a, b + 1) if multi[i]}
        if not split:
            cuts = even_cuts(ends, capacity, shards)
            return [units.prefix[c] if c < len(units.prefix) else "~" for c in cuts]
        digits = min(digits + NEXT_DIGITS, DIGEST_LENGTH)
        where = F.lit(False)
        for a, b in runs:   # "g" sorts behind every hexadecimal digit
            where = where | ((F.col("digest") >= units.prefix[a]) & (F.col("digest") < units.prefix[b] + "g"))
        fresh = _collected(_units(groups.filter(where), digits))
        if any(a != b for a, b in runs):    # a run may span single groups, which stay as they are
            alone = {p for i, p in enumerate(units.prefix) if i not in split}
            lengths = {len(p) for p in alone}
            keep = [j for j, p in enumerate(fresh.prefix) if not any(p[:n] in alone for n in lengths)]
            fresh = Units([fresh.prefix[j] for j in keep], fresh.size[keep], fresh.groups[keep], fresh.largest[keep])
        units = _merged(units, split, fresh)


def shard_of(digest: Column, cuts: list[str]) -> Column:
    """Number of cuts that are not above the digest."""
    place = F.lit(0)
    for cut in cuts:
        place = place + (F.lit(cut) <= digest).cast("int")
    return place


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, size, text CRC-32, shard and gapless slot in the shard.

    Size is the text's UTF-8 bytes plus 8.  A null text counts as empty (8 bytes, CRC 0) and joins the group
    of empty texts.  Rows of equal texts share a shard; repeated rows each get a slot.  With fewer groups than
    shards, some shards are empty; an empty table gives no rows.  Other columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = materialised(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text.cast("binary"), 256).alias("digest")), "sized")
    groups = materialised(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    placed = rows.withColumn("shard", shard_of(F.col("digest"), minimax_cuts(groups, shards)))
    # slots: number rows inside small buckets and add each bucket's offset; buckets are a fixed number
    placed = placed.select("*", F.substring("digest", 1, 3).alias("part"),
                           F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_SALTS)).cast("int").alias("salt"))
    bucket = ["shard", "part", "salt"]
    before = Window.partitionBy("shard").orderBy("part", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy(*bucket).agg(F.count("*").alias("n"))
               .select(*bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    inside = F.row_number().over(Window.partitionBy(*bucket).orderBy("digest", "doc_id")) - 1
    return (placed.select("doc_id", "size", "text_crc32", *bucket, inside.alias("place"))
            .join(offsets, bucket)
            .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("place")).alias("slot")))
