"""Hard negatives against a comparison of all rows."""

import math
import random

import numpy as np
import pytest

from lexweave.llm import hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, leaf string, vector string"


def plain(rows, every=50):
    good = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    size = max((len(v) for _, v, _ in good), default=0)
    good = [(i, v + [0] * (size - len(v)), label) for i, v, label in good]
    out = []
    for k, (i, v, label) in enumerate(good):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m, x) for m, (j, w, x) in enumerate(good) if m != k)
        for s, j, _, _ in [r for r in scored if r[3] == label][:5]:
            inside = [r for r in scored if r[3] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(i, j, rank + 1, r[1], -s, -r[0]) for rank, r in enumerate(inside)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, *"xxx") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(table, **options).collect())


def clustered(n, size, seed):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, size))
    return [(i, (centres[c] + 0.4 * draw.normal(size=size)).tolist(), int(c if draw.random() < 0.8 else draw.integers(6)))
            for i, c in enumerate(draw.integers(6, size=n))]


@pytest.mark.parametrize("options", [{}, {"sample": 60, "fan_out": 4}])
def test_equal_to_all_comparisons(spark, options, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 40)       # leaves of several blocks
    rows = clustered(700, 8, 3)
    assert mined(spark, rows, every=10, **options) == plain(rows, 10) != []


def test_ties_copies_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.5, 0.25, float(i % 3 == 0)], i % 2) for i in range(120)]     # very many equal scores
    rows += [(100, [0.5, 0.25, 1.0], 1), (100, [0.5, 0.25, 1.0], 0)]            # repeated ids
    rows += [(None, [1.0, 1.0, 1.0], 1), (200, None, 1), (250, [1.0, 1.0, 1.0], None), (300, [1.0, None, 1.0], 0),
             (350, [1.0, nan, 1.0], 0), (400, [inf, 1.0, 1.0], 1), (450, [0.5], 0), (500, [], 1), (550, [-1.0, -1.0, -1.0], 0)]
    assert mined(spark, rows) == plain(rows) != []


def test_single_rows_and_empty_tables(spark):
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, None, 1)]) == []
    table = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(table).collect() == []
    # a component far out of range is held at the bound
    held = hard_negatives.HELD_AT * 256 + 256 * 256
    assert mined(spark, [(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.75, 1.0], 0)]) == [
        (0, 1, 1, 2, held, hard_negatives.HELD_AT * 192 + 256 * 256)]


def test_leaves_are_left_out_but_none_that_counts():
    """On clustered rows the ranges exclude leaves, and every row inside the annulus lies in a leaf that is asked."""
    rows = np.array([v for _, v, _ in clustered(3000, 4, 9)])
    vectors = np.floor(256 * rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.int64)
    most = float((vectors ** 2).sum(axis=1).max())
    points = hard_negatives._lifted(vectors, most)
    tree = hard_negatives.build_tree(points[:500])
    leaf = hard_negatives.leaves_of(tree, points)
    leaves, width = sum(map(len, tree.children)), len(tree.root) + max(map(len, tree.children))
    low, high = np.full((leaves, width), np.inf), np.full((leaves, width), -np.inf)
    for k in range(leaves):
        child = max(c for c, first in enumerate(tree.firsts) if first <= k)
        d = np.hstack([hard_negatives.distances(points[leaf == k], s) for s in (tree.root, tree.children[child])])
        if len(d):
            low[k, :d.shape[1]], high[k, :d.shape[1]] = d.min(axis=0), d.max(axis=0)
            low[k, d.shape[1]:], high[k, d.shape[1]:] = 0, np.inf
    search = hard_negatives._Search(tree, None, most, low, high)
    anchors = np.hstack([vectors[:40].astype(float), np.zeros((40, 1))])
    scores = vectors[:40] @ vectors.T
    top = np.sort(scores, axis=1)[:, -20].astype(float)
    near, far = hard_negatives._annulus(anchors, most, top, np.full(40, most))
    meets = hard_negatives._meets(search, anchors, near, far)
    assert meets.mean() < 0.5
    for a in range(40):
        assert meets[a, leaf[scores[a] >= top[a]]].all()
