"""Hard negatives through a multiway hyperplane tree whose split points know the distances to sibling subtrees.

Vectors are integers (a component x becomes floor(scale * x)) and a score is an inner product.  One more component,
sqrt(M - |x|²) with M the greatest squared length, gives all rows the same length; an anchor gets 0 there.  The
squared distance of an anchor a to a row is then |a|² + M - 2 * score, so a window of scores is an annulus around the
anchor and the triangle inequality holds.

The tree is made of a bounded sample of the rows: a node has ``FAN_OUT`` split points far from each other, and a row
belongs to the nearest of them, on two levels.  All rows are put into its leaves, and for each leaf the least and
greatest distance of its rows to every split point of the nodes above it is kept.  An anchor asks only leaves whose
ranges meet its annulus at each of these points; what is left is compared exactly, in blocks of bounded size.
Annuli begin with bounds from the sample: its fifth score bounds that of all rows from below.

Two rounds are made: positives first, then negatives within the windows that the positives set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexweave.llm.batches import bounded_batches
from lexweave.llm.shipping import received, shared
from lexweave.session import materialised

SCALE = 256
SAMPLE = 4096            # rows from which the tree is made and first bounds are taken
FAN_OUT = 16
LEAST_NODE = 64          # sample rows below which a node is not divided again
BLOCK_ROWS = 8192        # rows of a leaf compared at a time, in expectation
ANCHORS_AT_A_TIME = 128
POSITIVES, NEGATIVES = 5, 3
LEAST_SHARE, MOST_SHARE = 50, 95    # of a positive's score, in per cent, that a negative's must have
HELD_AT = 1 << 26        # components are held at this absolute value, so that scores fit 64 bits
SLACK = 1e-6             # relative room for the rounding of distances
_NOTHING = -(1 << 62)


class Tree(NamedTuple):
    """Split points of the root and of each of its children, in the space with the additional component."""

    root: np.ndarray
    children: list
    firsts: list            # number of the first leaf of each child


class Sample(NamedTuple):
    row: np.ndarray
    label: np.ndarray
    vectors: np.ndarray


def _far_points(points: np.ndarray, count: int) -> np.ndarray:
    """Split points chosen one after another, each the farthest from those before."""
    chosen = [0]
    near = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < count:
        far = int(near.argmax())
        if near[far] <= 0:
            break
        chosen.append(far)
        near = np.minimum(near, ((points - points[far]) ** 2).sum(axis=1))
    return points[chosen]


def distances(points: np.ndarray, splits: np.ndarray) -> np.ndarray:
    square = (points ** 2).sum(axis=1)[:, None] + (splits ** 2).sum(axis=1)[None] - 2 * points @ splits.T
    return np.sqrt(np.maximum(square, 0))


def build_tree(points: np.ndarray, fan_out: int = FAN_OUT, least: int = LEAST_NODE) -> Tree:
    root = _far_points(points, fan_out)
    nearest = distances(points, root).argmin(axis=1)
    children, firsts, leaves = [], [], 0
    for k in range(len(root)):
        inside = points[nearest == k]
        splits = _far_points(inside, fan_out) if len(inside) >= least else inside[:1]
        children.append(splits)
        firsts.append(leaves)
        leaves += len(splits)
    return Tree(root, children, firsts)


def leaves_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    nearest = distances(points, tree.root).argmin(axis=1)
    out = np.zeros(len(points), dtype=np.int64)
    for k in np.unique(nearest):
        rows = np.flatnonzero(nearest == k)
        out[rows] = tree.firsts[k] + distances(points[rows], tree.children[k]).argmin(axis=1)
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    """The integer vectors of a batch."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that gives all of them the same length."""
    wide = vectors.astype(np.float64)
    return np.hstack([wide, np.sqrt(np.maximum(most - (wide ** 2).sum(axis=1), 0))[:, None]])


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, exact: in floating point as long as its integers reach, else in 64 bits."""
    reach = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if reach < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(scores: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and scores of the ``count`` highest of each row; the first column of equals comes first."""
    for _ in range(min(count, scores.shape[1])):
        column = scores.argmax(axis=1)
        rows = np.arange(len(scores))
        best = scores[rows, column]
        found = best > _NOTHING
        if not found.any():
            return
        yield rows[found], column[found], best[found]
        scores[rows, column] = _NOTHING


def _window(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of a negative: whole numbers s with share * positive <= 100 * s."""
    return -((-LEAST_SHARE * positive) // 100), (MOST_SHARE * positive) // 100


class _Search(NamedTuple):
    tree: Tree
    sample: Sample
    most: float         # greatest squared length
    low: np.ndarray     # leaves x split points (root, then child): least distance of the leaf's rows
    high: np.ndarray


def _open(e: np.ndarray, near: np.ndarray, far: np.ndarray, low: np.ndarray, high: np.ndarray, slack: float) -> np.ndarray:
    """Anchors x leaves: whether the annuli meet the leaves' ranges at each of the split points.

    A row at distance d of the anchor lies at |d - e| to d + e of a split point at distance e of the anchor.
    """
    least = np.maximum(near[:, None] - e, e - far[:, None]) - slack
    most = far[:, None] + e + slack
    return ((least[:, None, :] <= high[None]) & (most[:, None, :] >= low[None])).all(axis=2)


def _meets(search: _Search, points: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Anchors x leaves: whether a leaf may hold rows at a distance from ``near`` to ``far`` of the anchor."""
    tree, slack = search.tree, SLACK * (1 + math.sqrt(search.most))
    r, root = len(tree.root), distances(points, tree.root)
    out = np.zeros((len(points), len(search.low)), dtype=bool)
    for first, splits in zip(tree.firsts, tree.children):
        leaves = slice(first, first + len(splits))
        low, high = search.low[leaves], search.high[leaves]
        above = _open(root, near, far, low[:, :r], high[:, :r], slack)
        rows = np.flatnonzero(above.any(axis=1))
        if len(rows):
            beside = slice(r, r + len(splits))
            out[rows, leaves] = above[rows] & _open(
                distances(points[rows], splits), near[rows], far[rows], low[:, beside], high[:, beside], slack)
    return out


def _annulus(points: np.ndarray, most: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of rows whose scores lie from ``low`` to ``high``."""
    whole = (points ** 2).sum(axis=1) + most
    return (np.sqrt(np.maximum(whole - 2.0 * high, 0)), np.sqrt(np.maximum(whole - 2.0 * low, 0)))


def _targets(tree, negatives: bool):
    """Anchors with the leaves that their annuli meet, and the least score that can still count."""
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = received(tree)
        sample = search.sample
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            row = batch.column(names.index("row")).to_numpy()
            label = batch.column(names.index("label")).to_numpy()
            vectors = _vectors(batch.column(names.index("vector")))
            wide = vectors.astype(np.float64)
            points = np.hstack([wide, np.zeros((len(wide), 1))])
            reach = np.sqrt((wide ** 2).sum(axis=1) * search.most) + 1     # no score lies beyond
            scores = _scores(vectors, sample.vectors)
            same = label[:, None] == sample.label[None]
            meets, floors = np.zeros((len(points), len(search.low)), dtype=bool), []
            if not negatives:
                scores = np.where(same & (row[:, None] != sample.row[None]), scores, _NOTHING)
                bound = np.partition(scores, -POSITIVES, axis=1)[:, -POSITIVES] if scores.shape[1] >= POSITIVES \
                    else np.full(len(scores), _NOTHING)
                floors = bound[:, None]
                near, far = _annulus(points, search.most, np.maximum(bound, -reach), reach)
                meets = _meets(search, points, near, far)
            else:
                positives = batch.column(names.index("positives")).to_pylist()
                floors = np.full((len(points), POSITIVES), _NOTHING, dtype=np.int64)
                for j in range(POSITIVES):
                    score = np.array([p[j]["score"] if j < len(p) else -1 for p in positives], dtype=np.int64)
                    low, high = _window(score)
                    usable = low <= high
                    inside = ~same & (scores >= low[:, None]) & (scores <= high[:, None])
                    seen = np.where(inside, scores, _NOTHING)
                    if seen.shape[1] >= NEGATIVES:
                        low = np.maximum(low, np.partition(seen, -NEGATIVES, axis=1)[:, -NEGATIVES])
                    floors[:, j] = low
                    near, far = _annulus(points, search.most, low.astype(np.float64), high.astype(np.float64))
                    meets |= _meets(search, points, near, far) & usable[:, None]
            leaves = [np.flatnonzero(m).tolist() for m in meets]
            keep = [i for i, n in enumerate(names) if n not in ("leaves", "floors")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(leaves, pa.list_(pa.int64())),
                 pa.array(floors.tolist(), pa.list_(pa.int64()))], [*[names[i] for i in keep], "leaves", "floors"])
    return route


_MINED = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
          "negative_score bigint")
_FOUND = "anchor bigint, anchor_id bigint, place int, positive_id bigint, positive_score bigint, other bigint, other_id bigint, score bigint"


def _comparer(negatives: bool):
    """Exact comparison: rows of a block come first, then the anchors that ask for it, in batches."""
    names = [c.split(" ")[0] for c in _FOUND.split(", ")]

    def answers(block, anchors, vectors):
        ids, rows, labels, stored = block
        scores = _scores(vectors, stored)
        label = np.array([a["label"] for a in anchors])
        same = label[:, None] == labels[None]
        for j in range(POSITIVES if negatives else 1):
            if negatives:
                at = np.array([i for i, a in enumerate(anchors) if j < len(a["positives"])], dtype=np.int64)
                if not len(at):
                    return
                positive = np.array([anchors[i]["positives"][j]["score"] for i in at], dtype=np.int64)
                low, high = _window(positive)
                floor = np.maximum(low, np.array([anchors[i]["floors"][j] for i in at], dtype=np.int64))
                s = scores[at]
                s = np.where(~same[at] & (s >= floor[:, None]) & (s <= high[:, None]), s, _NOTHING)
            else:
                at = np.arange(len(anchors))
                own = np.array([a["row"] for a in anchors])
                floor = np.array([a["floors"][0] for a in anchors], dtype=np.int64)
                s = np.where(same & (own[:, None] != rows[None]) & (scores >= floor[:, None]), scores, _NOTHING)
            for r, c, best in _best(s, NEGATIVES if negatives else POSITIVES):
                for i, k, x in zip(at[r], c, best):
                    a = anchors[i]
                    p = a["positives"][j] if negatives else {"id": None, "score": None}
                    yield (a["row"], a["id"], j, p["id"], p["score"], int(rows[k]), int(ids[k]), int(x))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            where = np.stack([columns["leaf"].to_numpy(), columns["salt"].to_numpy()], axis=1)
            asks = columns["asks"].to_numpy(zero_copy_only=False).astype(bool)
            edges = np.flatnonzero((where[1:] != where[:-1]).any(axis=1) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if a == b:
                    continue
                if key != tuple(where[a]):
                    key, parts, block = tuple(where[a]), [], None
                piece = batch.slice(a, b - a)
                vectors = _vectors(piece.column(batch.schema.names.index("vector")))
                if not asks[a]:
                    parts.append((columns["id"].slice(a, b - a).to_numpy(), columns["row"].slice(a, b - a).to_numpy(),
                                  columns["label"].slice(a, b - a).to_numpy(), vectors))
                    continue
                if parts:
                    block = tuple(np.concatenate(c) for c in zip(*parts))
                    parts = []
                if block is None:
                    continue
                fields = ["row", "id", "label", "floors", *(["positives"] if negatives else [])]
                anchors = piece.select(fields).to_pylist()
                for i in range(0, len(anchors), ANCHORS_AT_A_TIME):
                    out = list(answers(block, anchors[i:i + ANCHORS_AT_A_TIME], vectors[i:i + ANCHORS_AT_A_TIME]))
                    if out:
                        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
    return compare


def _asked(rows: DataFrame, anchors: DataFrame, blocks: Column, negatives: bool) -> DataFrame:
    """Answers of all blocks that an anchor asks; ``blocks`` is the number of blocks of a leaf."""
    extra = "array<struct<score:bigint,id:bigint>>"
    stored = rows.select("leaf", F.pmod(F.xxhash64("row"), blocks).alias("salt"), F.lit(False).alias("asks"), "id", "row",
                         "label", "vector", F.lit(None).cast("array<bigint>").alias("floors"),
                         F.lit(None).cast(extra).alias("positives"))
    asking = anchors.withColumn("leaf", F.explode("leaves")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).select(
        "leaf", "salt", F.lit(True).alias("asks"), "id", "row", "label", "vector", "floors",
        (F.col("positives") if negatives else F.lit(None)).cast(extra).alias("positives"))
    together = stored.unionByName(asking).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "asks", "id", "row")
    return together.mapInArrow(_comparer(negatives), _FOUND)


def _first(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "other_id", "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def usable_rows(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``row, id, label, vector``: rows with an id, a label and a vector of finite components, made whole numbers."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    whole = F.transform("x", lambda v: F.greatest(F.least(F.floor(v * scale), F.lit(HELD_AT)), F.lit(-HELD_AT)).cast("int"))
    return rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"),
        F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("x"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        "row", "id", "label", whole.alias("vector"))


def _assigner(tree_shared, most: float):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = received(tree_shared)
        for batch in batches:
            if batch.num_rows:
                names = batch.schema.names
                vectors = _vectors(batch.column(names.index("vector")))
                columns = [batch.column(i) for i in range(batch.num_columns)]
                columns[names.index("leaf")] = pa.array(leaves_of(tree, _lifted(vectors, most)))
                yield pa.RecordBatch.from_arrays(columns, names)
    return assign


def _ranger(tree_shared, most: float):
    """Rows of each leaf in a task and their least and greatest distances to the split points above it."""
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = received(tree_shared)
        child_of = np.repeat(np.arange(len(tree.children)), [len(c) for c in tree.children])
        held: dict[int, list] = {}
        for batch in batches:
            points = _lifted(_vectors(batch.column(1)), most) if batch.num_rows else np.zeros((0, 1))
            leaf = batch.column(0).to_numpy()
            for k in np.unique(leaf):
                inside = points[leaf == k]
                d = np.hstack([distances(inside, tree.root), distances(inside, tree.children[child_of[k]])])
                n, low, high = held.get(k, (0, np.inf, -np.inf))
                held[k] = [n + len(inside), np.minimum(low, d.min(axis=0)), np.maximum(high, d.max(axis=0))]
        rows = [(int(k), i, n, float(x), float(y)) for k, (n, low, high) in held.items() for i, (x, y) in enumerate(zip(low, high))]
        names = ["leaf", "split", "n", "low", "high"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, kinds)], names)
    return ranges


def mine(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         every: int = 50, sample: int = SAMPLE, fan_out: int = FAN_OUT, scale: int = SCALE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``.  An anchor's positives are the ``POSITIVES`` other rows
    of its label with the highest scores; for each, its negatives are the ``NEGATIVES`` rows of other labels with
    the highest scores from ``LEAST_SHARE`` to ``MOST_SHARE`` per cent of the positive's.  Equal scores go by id,
    then by row.  Positives whose window is empty, and so all with a negative score, have no negatives and no rows.

    Rows without an id, a label or a vector, or with a component that is null or not finite, take no part.  Rows
    with equal ids are rows of their own.  Shorter vectors count as continued by zeros; components are held at
    ``HELD_AT``.  An empty table gives no rows; only the three columns are read, whatever the others are called.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    good = materialised(usable_rows(rows, id_col, vector_col, label_col, scale), "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    size, most = good.agg(F.max(F.size("vector")), F.max(square)).first()
    size = max(size or 0, 1)
    good = good.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0), size - F.size("vector"))))
    taken = good.orderBy(F.xxhash64("row"), "row").limit(sample).select("row", "label", "vector").toArrow().combine_chunks()
    if not taken.num_rows:
        return spark.createDataFrame([], _MINED)
    drawn = Sample(taken["row"].to_numpy(), taken["label"].to_numpy(), _vectors(taken["vector"]))
    tree = build_tree(_lifted(drawn.vectors, most), fan_out)
    planted = shared(spark, tree)
    stored = materialised(good.withColumn("leaf", F.lit(0).cast("bigint")).mapInArrow(
        _assigner(planted, most), "row bigint, id bigint, label bigint, vector array<int>, leaf bigint"), "leaves")

    leaves = sum(len(c) for c in tree.children)
    width = len(tree.root) + max(len(c) for c in tree.children)
    low, high, counts = np.full((leaves, width), np.inf), np.full((leaves, width), -np.inf), np.zeros(leaves, np.int64)
    ranges = stored.select("leaf", "vector").mapInArrow(
        _ranger(planted, most), "leaf bigint, split int, n bigint, low double, high double")
    # as many rows as the tree has leaves and split points above each
    for r in ranges.groupBy("leaf", "split").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[r["leaf"], r["split"]], high[r["leaf"], r["split"]], counts[r["leaf"]] = r["low"], r["high"], r["n"]
    # split points that a leaf does not have exclude nothing; leaves without rows meet nothing
    for k in range(leaves):
        if counts[k]:
            missing = np.isinf(low[k])
            low[k, missing], high[k, missing] = 0, np.inf
    search = shared(spark, _Search(tree, drawn, most, low, high))
    blocks = F.element_at(F.array(*[F.lit(max(1, -(-int(n) // BLOCK_ROWS))).cast("bigint") for n in counts]), F.col("leaf").cast("int") + 1)

    anchors = stored.filter(F.col("id") % every == 0).select("row", "id", "label", "vector")
    asked = "row bigint, id bigint, label bigint, vector array<int>, {}leaves array<bigint>, floors array<bigint>"
    first = anchors.mapInArrow(_targets(search, False), asked.format(""))
    positives = _first(_asked(stored, first, blocks, False), POSITIVES).groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("rank", "score", F.col("other_id").alias("id")))).alias("ranked"))
    having = materialised(anchors.join(positives, F.col("row") == F.col("anchor")).select(
        "row", "id", "label", "vector", F.transform("ranked", lambda p: F.struct(p["score"].alias("score"), p["id"].alias("id"))).alias("positives")), "positives")
    second = having.mapInArrow(_targets(search, True), asked.format("positives array<struct<score:bigint,id:bigint>>, "))
    return _first(_asked(stored, second, blocks, True), NEGATIVES).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
