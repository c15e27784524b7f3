"""Near duplicates: exact Jaccard self-join of shingle sets, with skipping by position and by answers.

Each distinct set has a prefix: its rarest shingles, so many that two sets similar enough share one.  The
inverted index holds prefix shingles with set, size and position.  Two means keep its lists from being paired off:

* index level: a list is cut into blocks of similar set sizes.  Size and position of an entry bound the sizes of its
  partners, so it visits the blocks within its reach and skips the others whole; deep entries often reach none.
  In a visited block a pair is formed only if both sizes and positions leave room for enough common shingles;
* answer level: each list first asks only its pivot, the entry of lowest position.  Sets whose link to a pivot is
  verified share the pivot's answers: they are one component already, and pairs inside a component are skipped.
  What remains of a list is then formed in full across components, so no link between components is lost.

Shingles frequent everywhere come last in the order, before them those of long lists; both are recognised from
counts over all documents.  Lists of one entry are left out before anything is sorted.  Lists of frequent shingles
are spread over tasks by set name; what is known of a whole list is put together from its parts.
Words and shingles are 64-bit hashes.  A formed pair is tested on parity sketches, which rule it out only if its
sets differ in too many shingles, and then verified on the whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from lexweave.llm.batches import bounded_batches
from lexweave.llm.components import components
from lexweave.llm.hashed_words import NON_SPACE, runs_of, word_slices
from lexweave.llm.shipping import received, shared
from lexweave.session import materialised

SHINGLE = 5
THRESHOLD = 80              # per cent
CHUNK = 512                 # sets counted together when frequent shingles are looked for
FREQUENT = 1 / 200          # share of the sets from which a shingle is frequent; 200 times the mean size is the most there are
FEW = 200                   # long lists are looked for until fewer than one in so many shingles has a new one
LONG_LIST = 16              # entries from which a list's shingle is moved back in the order
SPREAD = 64                 # tasks over which the list of a frequent shingle is spread
COPIES = 8                  # parts of a block of such a list when it is paired off
BLOCK = 1.1                 # ratio of the set sizes in a block of a list
FILTER_BITS = 27            # of the bit maps of shingles and of sets: 16 MB each, whatever the input's size


def _prefix_length(n: int) -> int:
    return n - (-(-n * THRESHOLD // 100)) + 1


def _set_builder(size: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, counts, hashes in word_slices(batch.column(1), NON_SPACE):
                grams, ends = runs_of(hashes, size), np.cumsum(counts)
                sizes, names, tokens = [], [], []
                for c, e in zip(counts.tolist(), ends.tolist()):
                    if not c:
                        sizes.append(0)
                        names.append(None)
                        tokens.append(None)
                        continue
                    whole = np.unique(grams[e - c:e - size + 1] if c >= size else runs_of(hashes[e - c:e], c)).tobytes()
                    name = int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little", signed=True)
                    sizes.append(len(whole) // 8)
                    names.append(name)
                    tokens.append(None if name in seen else whole)   # a copy in the same task needs no second set
                    seen.add(name)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(counts)), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()),
                     pa.array(tokens, pa.binary())], ["id", "n", "name", "tokens"])
    return build


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id, n, name, tokens``: set size and name of every row; the set itself once per task and name."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n", T.LongType()),
                           T.StructField("name", T.LongType()), T.StructField("tokens", T.BinaryType())])
    return rows.mapInArrow(_set_builder(size), schema)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that stand out in chunks of sets; a rare one leaves the task in no row."""
    least = max(2, round(CHUNK * FREQUENT))
    for batch in batches:
        tokens = batch.column(0).to_pylist()
        for at in range(0, len(tokens), CHUNK):
            keys, n = np.unique(np.frombuffer(b"".join(tokens[at:at + CHUNK]), dtype=np.int64), return_counts=True)
            much = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(keys[much]), pa.array(n[much])], ["token", "n"])


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the frequent shingles; their number is bounded by mean set size / FREQUENT."""
    total = sets.count()
    rows = (sets.select("tokens").mapInArrow(_frequent, "token bigint, n bigint").groupBy("token")
            .agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2, total * FREQUENT)).toArrow())
    keys = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows.column("n").to_numpy()[order]


class BitMap:
    """A bit map of fixed size, sent compressed: few bits set are few bytes to broadcast and to keep."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def __reduce__(self):
        return _unpacked, (pa.compress(pa.py_buffer(self.table), codec="zstd", asbytes=True), len(self.table))


def _unpacked(raw: bytes, size: int) -> BitMap:
    return BitMap(np.frombuffer(pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8))


@contextmanager
def _broadcast(spark, value):
    """``value`` broadcast while its readers are written; afterwards no executor keeps it."""
    sent = shared(spark, value)
    try:
        yield sent
    finally:
        sent.destroy()


def _bits(bitmap: BitMap, keys: np.ndarray) -> np.ndarray:
    table = bitmap.table
    place = keys & np.uint64((1 << FILTER_BITS) - 1)
    return ((table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


class ShingleOrder:
    """The order of shingles: by hash, behind them those of long lists, last the frequent ones by count.

    A long list is marked in a bit map of fixed size.  A rare shingle that shares a bit is moved back as well,
    which is the same for all sets and so changes no result.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, long: BitMap | None = None):
        self.keys, self.counts, self.long = keys, counts, long

    def _often(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(whole), dtype=bool), np.zeros(len(whole), dtype=np.int64)
        at = np.searchsorted(self.keys, whole)
        at[at == len(self.keys)] = 0
        return self.keys[at] == whole, at

    def prefix(self, whole: np.ndarray) -> np.ndarray:
        p = _prefix_length(len(whole))
        for head in (whole[:p + 64], whole):    # mostly the first shingles by hash are enough
            often, at = self._often(head)
            plain = head[~often]
            slow = _bits(self.long, plain)
            if np.count_nonzero(~slow) >= p or len(head) == len(whole):
                break
        first = np.concatenate([plain[~slow][:p], plain[slow]])[:p]
        if len(first) < p:
            rest = head[often][np.lexsort((head[often], self.counts[at[often]]))][:p - len(first)]
            first = np.concatenate([first, rest])
        return first

    def beyond(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``prefix`` takes from beyond the counted shingles, and as many again that may come next.

        The second array is 1 for shingles not known to have a long list.
        """
        p = _prefix_length(len(whole))
        plain = whole[~self._often(whole)[0]]
        slow = _bits(self.long, plain)
        lost = int(np.count_nonzero(slow[:p]))
        if not lost:
            return plain[:0], np.zeros(0, dtype=np.int64)
        order = np.concatenate([np.flatnonzero(~slow)[:p + 2 * lost + 8], np.flatnonzero(slow)])[:p + 2 * lost + 8]
        order = order[order >= p]
        return plain[order], (~slow[order]).astype(np.int64)

    def counted(self, whole: np.ndarray) -> np.ndarray:
        """The shingles whose lists are measured: the prefix before long lists are known, without frequent ones."""
        p = _prefix_length(len(whole))
        for head in (whole[:p + 64], whole):
            plain = head[~self._often(head)[0]]
            if len(plain) >= p or len(head) == len(whole):
                return plain[:p]


def _counter(sent):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = received(sent)
        for batch in batches:
            parts = [order.counted(np.frombuffer(raw, dtype=np.uint64)) for raw in batch.column(0).to_pylist()]
            keys, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["token", "n"])
    return count


def _overflow(sent):
    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = received(sent)
        for batch in batches:
            parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            parts += [order.beyond(np.frombuffer(raw, dtype=np.uint64)) for raw in batch.column(0).to_pylist()]
            keys, where = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["token", "n"])
    return beyond


def _indexer(sent):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, shared_bits = received(sent)
        for batch in batches:
            parts, places, sizes, lengths, hot = [], [], [], [], []
            for raw in batch.column(1).to_pylist():
                whole = np.frombuffer(raw, dtype=np.uint64)
                first = order.prefix(whole)
                often = order._often(first)[0]
                place = np.flatnonzero(_bits(shared_bits, first) | often)
                hot.append(often[place])
                parts.append(first[place])
                places.append(place)
                sizes.append(len(whole))
                lengths.append(len(place))
            rows = np.repeat(np.arange(len(lengths)), lengths)
            none = [np.zeros(0, dtype=np.uint64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(parts or none).view(np.int64)), batch.column(0).take(pa.array(rows, pa.int64())),
                 pa.array(np.array(sizes, dtype=np.int32)[rows] if sizes else np.zeros(0, np.int32)),
                 pa.array(np.concatenate(places or none).astype(np.int32)),
                 pa.array(np.concatenate(hot or none).astype(bool))], ["token", "name", "n", "pos", "hot"])
    return index


def _possible(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Whether sizes and the positions of their first common shingle leave room for a link."""
    t = F.lit(THRESHOLD)
    sizes = F.least(n1, n2) * 100 >= F.greatest(n1, n2) * t
    needed = F.ceil((n1 + n2) * t / (t + 100))
    return sizes & (F.least(n1 - p1, n2 - p2) >= needed)


def _reach(n: Column, pos: Column) -> Column:
    """Size of the largest set that can link by an entry of this size and position."""
    return F.floor((n - pos) * (100 + THRESHOLD) / THRESHOLD) - n


def _block(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(BLOCK))).cast("int")


def _part(parts: int) -> Column:
    """Part of a frequent shingle's list in which an entry lies; other lists are whole."""
    return F.when(F.col("hot"), F.pmod(F.xxhash64("name"), F.lit(parts))).otherwise(0).cast("int")


def block_pairs(entries: DataFrame) -> DataFrame:
    """``a, b``: possible pairs across components among ``token, name, n, pos, hot, component``, repeated ones included.

    The larger set of a pair, of equal ones that of the smaller name, visits the blocks that its size and position
    reach; the other lies in the block of its size, and only if its own position leaves it a partner not smaller.
    """
    entries = entries.withColumns({c: F.col(c).cast("bigint") for c in ("n", "pos")})
    n, reach = F.col("n"), _reach(F.col("n"), F.col("pos"))
    least, most = F.ceil(n * THRESHOLD / 100), F.least(n, reach)
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
    x = (entries.filter(most >= least).withColumn("block", F.explode(F.sequence(_block(least), _block(most))))
         .withColumn("part", F.explode(parts)).alias("x"))
    y = entries.filter(reach >= n).withColumns({"block": _block(n), "part": _part(COPIES)}).alias("y")
    larger = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.name") < F.col("y.name")))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.block") == F.col("y.block"))
                   & (F.col("x.part") == F.col("y.part")))
    return pairs.filter(larger & (F.col("x.component") != F.col("y.component"))
                        & _possible(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))).select(
        F.least("x.name", "y.name").alias("a"), F.greatest("x.name", "y.name").alias("b"))


def _whole_lists(parts: DataFrame, of_list: dict[str, Column]) -> DataFrame:
    """Rows of parts of lists with the columns ``of_list`` put together for the lists of frequent shingles.

    There are at most (mean set size / FREQUENT) such lists, so a row for each is broadcast.
    """
    hot = parts.filter("hot")
    lists = hot.groupBy("token").agg(*[c.alias(k) for k, c in of_list.items()])
    return parts.filter("not hot").unionByName(hot.drop(*of_list).join(F.broadcast(lists), "token"))


def _bitmap(keys: DataFrame, into: BitMap | None = None) -> BitMap:
    """Bit map of fixed size with the bit of each ``key`` (its low bits); ``into`` gets them beside its own."""
    place = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1
    bucket = F.bitmap_bucket_number("p")
    # keys meet by bucket before they become bits, so tasks hold few partial maps
    rows = (keys.select(place.alias("p")).repartition(bucket).groupBy(bucket.alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).toArrow())
    into = into or BitMap(np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8))
    for b, raw in zip(rows["b"].to_pylist(), rows["bits"]):     # no second copy of the bits on the driver
        part = np.frombuffer(raw.as_buffer(), dtype=np.uint8)
        into.table[(b - 1) * len(part):b * len(part)] |= part
    return into


def inverted_lists(sets: DataFrame) -> DataFrame:
    """``token, name, n, pos, hot, pivot, entries`` of the lists with more than one set, one row per entry."""
    spark = sets.sparkSession
    order = ShingleOrder(*frequent_shingles(sets))
    tokens = sets.select("tokens")
    counted = "token bigint, n bigint"
    with _broadcast(spark, order) as sent:
        lengths = materialised(tokens.mapInArrow(_counter(sent), counted).groupBy(F.col("token").alias("key"))
                               .agg(F.sum("n").alias("n")).filter("n > 1"), "lengths")
    met = _bitmap(lengths)      # shingles met twice; the others' lists have one entry and need not be sent
    fresh = lengths.filter(F.col("n") > LONG_LIST)
    while True:     # shingles that take the place of those moved back may have long lists too
        order = ShingleOrder(order.keys, order.counts, _bitmap(fresh, order.long))
        with _broadcast(spark, order) as sent:
            far = materialised(tokens.mapInArrow(_overflow(sent), counted)
                               .groupBy(F.col("token").alias("key")).agg(F.sum("n").alias("n")), "far")
        met = _bitmap(far, met)
        fresh = far.filter(F.col("n") > LONG_LIST)
        if fresh.count() * FEW <= far.count():      # the rest of the long lists costs pairs, not links
            break
    own = Window.partitionBy("token", "part")
    with _broadcast(spark, (order, met)) as sent:
        entries = sets.select("name", "tokens").mapInArrow(
            _indexer(sent), "token bigint, name bigint, n int, pos int, hot boolean").withColumn("part", _part(SPREAD))
        lists = entries.select("*", F.min("name").over(own).alias("low"), F.max("name").over(own).alias("high"),
                               F.min(F.struct("pos", "n", "name")).over(own).alias("pivot"))
        lists = lists.filter("hot or low <> high").dropDuplicates(["token", "part", "name"])
        lists = materialised(lists.withColumn("entries", F.count("*").over(own)).drop("part", "low", "high"), "lists")
    return _whole_lists(lists, {"pivot": F.min("pivot"), "entries": F.count("*")}).filter("entries > 1")


def parity_sketch(whole: np.ndarray) -> bytes:
    """Parity of the shingles per slot, with about as many slots as shingles (a power of two, at least 64)."""
    slots = max(64, 1 << (len(whole) - 1).bit_length())
    odd = np.bincount((whole >> np.uint64(20)).astype(np.int64) & (slots - 1), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _picker(sent, sketches: bool):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = received(sent)
        for batch in batches:
            batch = batch.filter(pa.array(_bits(bits, batch.column(0).to_numpy().view(np.uint64))))
            if not sketches:
                yield batch
                continue
            sets = [np.frombuffer(raw, dtype=np.uint64) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int32()),
                 pa.array([parity_sketch(x) for x in sets], pa.binary())], ["name", "n", "sketch"])
    return pick


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer slots: slots that fall together add up, so their parities combine by xor."""
    while len(sketch) > size:
        sketch = sketch.reshape(2, -1)
        sketch = sketch[0] ^ sketch[1]
    return sketch


def _near_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that differ in no more slots than a link allows; every differing slot is a differing shingle."""
    for batch in batches:
        near = np.zeros(batch.num_rows, dtype=bool)
        columns = [batch.column(i).to_pylist() for i in range(2, 6)]
        for k, (n1, n2, x, y) in enumerate(zip(*columns)):
            a, b = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
            size = min(len(a), len(b))
            differ = int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())
            needed = -(-(n1 + n2) * THRESHOLD // (100 + THRESHOLD))
            near[k] = differ <= n1 + n2 - 2 * needed
        yield batch.select(["a", "b"]).filter(pa.array(near))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = np.zeros(batch.num_rows, dtype=bool)
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for k, (x, y) in enumerate(zip(left, right)):
            a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            common = int(np.count_nonzero(b[at] == a))
            linked[k] = 100 * common >= THRESHOLD * (len(a) + len(b) - common)
        yield batch.select(["a", "b"]).filter(pa.array(linked))


def _with_both(pairs: DataFrame, picked: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """The pairs with columns of either set; the pair side may be skewed, the set side has unique names."""
    for end, side in (("a", 0), ("b", 1)):
        named = picked.select(F.col("name").alias(end), *[F.col(c).alias(v[side]) for c, v in columns.items()])
        pairs = pairs.join(named.hint("merge"), end)
    return pairs.select("a", "b", *[x for v in columns.values() for x in v])


def _picked(pairs: DataFrame, sets: DataFrame, schema: str, sketches: bool) -> DataFrame:
    """One row per set named in ``pairs``: its size and sketch, or its shingles.  Other sets are not shuffled."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    with _broadcast(sets.sparkSession, _bitmap(ends)) as bits:
        rows = sets.select("name", "tokens").mapInArrow(_picker(bits, sketches), schema).dropDuplicates(["name"])
        return materialised(rows, "picked")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs ``a, b`` whose whole sets are similar enough.

    All pairs are tested on sketches, a bit or two a shingle; whole sets move only for those left.
    """
    sketched = _picked(pairs, sets, "name bigint, n int, sketch binary", True)
    near = materialised(_with_both(pairs, sketched, {"n": ("n1", "n2"), "sketch": ("x", "y")})
                        .mapInArrow(_near_enough, "a bigint, b bigint"), "near")
    whole = _picked(near, sets, "name bigint, tokens binary", False)
    return _with_both(near, whole, {"tokens": ("x", "y")}).mapInArrow(_compare, "a bigint, b bigint")


def set_links(sets: DataFrame) -> DataFrame:
    """``a, b``: links whose components are those of all links between distinct sets.

    Components that the pivots' answers form already are handed on as stars, which need no further rounds.
    """
    lists = inverted_lists(sets)
    pivot = F.col("pivot")
    asked = (lists.filter((F.col("name") != pivot["name"]) & _possible(F.col("n"), F.col("pos"), pivot["n"], pivot["pos"]))
             .select(F.least("name", pivot["name"]).alias("a"), F.greatest("name", pivot["name"]).alias("b")).distinct())
    asked = materialised(asked, "asked")
    answers = materialised(verified(asked, sets), "answers")
    groups = components(answers).select(F.col("node").alias("name"), "component")
    own = Window.partitionBy("token", "part")
    # with two entries, the pivot has answered all
    open_lists = (lists.filter("entries > 2").select("token", "name", "n", "pos", "hot").join(groups, "name", "left")
                  .withColumns({"component": F.coalesce("component", "name"), "part": _part(SPREAD)})
                  .withColumns({"low": F.min("component").over(own), "high": F.max("component").over(own)})
                  .filter("hot or low <> high").drop("part"))
    open_lists = _whole_lists(materialised(open_lists, "open"), {"low": F.min("low"), "high": F.max("high")})
    rest = (block_pairs(open_lists.filter("low <> high").drop("low", "high")).distinct()
            .join(asked, ["a", "b"], "left_anti"))
    stars = groups.filter("name <> component").select(F.col("name").alias("a"), F.col("component").alias("b"))
    return stars.unionByName(verified(materialised(rest, "rest"), sets))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Words are runs of non-space characters with A-Z lower-cased; a text of fewer than ``size`` words is one
    shingle.  Rows link from a Jaccard similarity of 0.8; ``component_id`` is the smallest id reachable.  A null,
    empty or blank text has no shingles and links with nothing: its component is its own id.  Equal texts, also
    repeated rows, share a component.  Null ids are ignored in the minimum unless a component has no other.
    Only the id and text columns are read; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = materialised(shingle_sets(docs, id_col, text_col, size), "sets")
    sets = rows.filter(F.col("tokens").isNotNull()).select("name", "tokens")
    groups = components(set_links(sets)).select(F.col("node").alias("name"), "component")
    least = rows.filter(F.col("name").isNotNull()).groupBy("name").agg(F.min("id").alias("least"))
    placed = least.join(groups, "name", "left").withColumn("component", F.coalesce("component", "name"))
    final = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = placed.join(final, "component").select("name", "component_id")
    return (rows.select("id", "n", "name").join(by_set.hint("merge"), "name", "left")
            .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")))
