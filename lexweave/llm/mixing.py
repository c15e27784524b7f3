"""Mixing sources to target weights: raking by iterative proportional fitting, then calibrated sampling.

Documents fall into cells of source, language and topic.  Topics are clusters: whole texts are read once and
counted in ``GROUPS`` groups of hashed words, and k-means over the groups' shares of all documents finds ``TOPICS``
centres.  The cells' token weights are raked in turn to the target of each marginal until all agree.  The ratio of
raked to present weight is a cell's rate.  A document's expected copies are its rate times a scale, the same for
all, so that the sample has the target marginals in expectation: the whole part of that, and one more by a draw from
a hash of its id.  By default the scale is one over the largest rate, and no document is taken twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from lexweave.llm.batches import bounded_batches
from lexweave.llm.hashed_words import NON_SPACE, word_slices
from lexweave.session import materialised

GROUPS = 64              # groups of hashed words
TOPICS = 8
TOPIC_ROUNDS = 6         # passes of k-means over the groups of all documents
FIRST_CENTRES = 1024     # documents among which the first centres are chosen
# target share of a marginal's value: its present token share to this power, made to sum to one
POWERS = {"source": 0.7, "language": 0.8, "topic": 0.8}
ROUNDS = 20              # most rounds; raking stops before when the marginals agree
TOLERANCE = 1e-2         # largest relative difference of a marginal from its target
SEED = 17
_MISSING = "\x00"        # stands for a null source or language


def _word_groups(groups: int, inside: str | None):
    """Adds the groups' counts; the text lies in the kept row's field ``inside``, or else in ``body``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            kept = batch.column(names.index("kept"))
            texts = kept.field(inside) if inside else batch.column(names.index("body"))
            counted = np.zeros((batch.num_rows, groups), dtype=np.int32)
            for first, counts, hashes in word_slices(texts, NON_SPACE):
                text = np.repeat(np.arange(len(counts)), counts)
                which = ((hashes >> np.uint64(40)) % np.uint64(groups)).astype(np.int64)
                counted[first:first + len(counts)] += np.bincount(
                    text * groups + which, minlength=len(counts) * groups).reshape(-1, groups).astype(np.int32)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * groups)
            keep = [i for i, n in enumerate(names) if n not in ("body", "groups")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.ListArray.from_arrays(ends, pa.array(counted.ravel()))],
                [*[names[i] for i in keep], "groups"])
    return count


def features(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Roots of a document's shares of the groups, less those of the corpus: the space of the topics."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.sqrt(counts / total) - np.sqrt(shares)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1)[None] - 2 * points @ centres.T).argmin(axis=1)


def _matrix(column: pa.Array, groups: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, groups).astype(np.float64)


def _summed(centres: np.ndarray, shares: np.ndarray):
    """Sum and number of the documents nearest to each centre, a row per centre and task."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros_like(centres), np.zeros(len(centres), dtype=np.int64)
        for batch in batches:
            counts = _matrix(batch.column(0), len(shares))
            points = features(counts[counts.sum(axis=1) > 0], shares)
            which = nearest(points, centres)
            for k in range(len(centres)):
                sums[k] += points[which == k].sum(axis=0)
            n += np.bincount(which, minlength=len(centres))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(centres))), pa.array(n), pa.array(list(sums), pa.list_(pa.float64()))], ["k", "n", "sums"])
    return add


def first_centres(points: np.ndarray, topics: int) -> np.ndarray:
    """Centres far from each other; fewer if there are fewer distinct points."""
    chosen = [0]
    far = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < topics and far.max() > 1e-12:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def topic_centres(counted: DataFrame, topics: int, rounds: int, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Centres of the topics and the groups' shares, from the ``groups`` of all documents with words."""
    sums = counted.agg(*[F.coalesce(F.sum(F.get("groups", F.lit(k))), F.lit(0)).alias(f"g{k}") for k in range(groups)]).first()
    shares = np.array(sums, dtype=np.float64) / max(sum(sums), 1)
    drawn = counted.filter(F.exists("groups", lambda c: c > 0)).select("groups").orderBy(F.xxhash64("groups")).limit(FIRST_CENTRES)
    sample = _matrix(drawn.toArrow()["groups"].combine_chunks(), groups)
    if not len(sample):
        return np.zeros((1, groups)), shares
    centres = first_centres(features(sample, shares), topics)
    for _ in range(rounds):
        parts = counted.select("groups").mapInArrow(_summed(centres, shares), "k bigint, n bigint, sums array<double>")
        # as many rows as there are topics
        for r in parts.groupBy("k").agg(F.sum("n").alias("n"), F.array(*[
                F.sum(F.get("sums", F.lit(g))) for g in range(groups)]).alias("sums")).collect():
            if r["n"]:
                centres[r["k"]] = np.array(r["sums"]) / r["n"]
    return centres, shares


def _topics(centres: np.ndarray, shares: np.ndarray):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            counts = _matrix(batch.column(names.index("groups")), len(shares))
            tokens = counts.sum(axis=1).astype(np.int64)
            which = np.where(tokens > 0, nearest(features(counts, shares), centres), 0)
            keep = [i for i, n in enumerate(names) if n != "groups"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array([str(k) for k in which], pa.string()), pa.array(tokens)],
                [*[names[i] for i in keep], "topic", "tokens"])
    return name


def tempered(cells: DataFrame, powers: dict[str, float]) -> dict[str, DataFrame]:
    """Target shares per marginal: a power of the present share."""
    out = {}
    for name, power in powers.items():
        raw = cells.groupBy(name).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("raw"))
        whole = raw.agg(F.sum("raw")).first()[0] or 1.0
        out[name] = raw.select(name, (F.col("raw") / F.lit(whole)).alias("target"))
    return out


def _weights(batch: pa.RecordBatch, values: dict[str, pa.Array], factors: dict[str, np.ndarray]):
    """Weights of the cells under the factors, and the number of each cell's value in each marginal (-1: none)."""
    weight = batch.column(batch.schema.names.index("tokens")).to_numpy().astype(np.float64)
    places = {}
    for name, known in values.items():
        column = batch.column(batch.schema.names.index(name)).cast(pa.string())
        places[name] = pc.fill_null(pc.index_in(column, known), -1).to_numpy()
        weight = weight * np.append(factors[name], 0.0)[places[name]]
    return weight, places


def _marginal_sums(values: dict[str, pa.Array], factors: dict[str, np.ndarray], wanted: list[str]):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {name: np.zeros(len(values[name]) + 1) for name in wanted}
        for batch in batches:
            weight, places = _weights(batch, values, factors)
            for name in wanted:
                sums[name] += np.bincount(places[name] + 1, weights=weight, minlength=len(sums[name]))
        for name in wanted:
            seen = np.flatnonzero(sums[name][1:])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen), pa.string()), pa.array(seen),
                                              pa.array(sums[name][1:][seen])], ["marginal", "place", "sum"])
    return add


def _weighted(values: dict[str, pa.Array], factors: dict[str, np.ndarray]):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, names = [batch.column(i) for i in range(batch.num_columns)], batch.schema.names
            columns[names.index("weight")] = pa.array(_weights(batch, values, factors)[0])
            yield pa.RecordBatch.from_arrays(columns, names)
    return weigh


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (marginal columns, ``tokens`` > 0) with raked ``weight`` that sums to about one.

    A cell's weight is its tokens times one factor for each of its marginal values.  Cells stay distributed: a step
    sums their weights by the values of a marginal and sets its factors anew.  Only the factors, a number for each
    value of a marginal, pass through the driver.  A value without a target, or with target 0, has weight 0.  If
    targets contradict each other the last round's weights are returned: they meet the last marginal exactly.
    """
    values, goals, factors = {}, {}, {}
    for name, target in targets.items():
        rows = target.filter("target > 0").select(F.col(name).cast("string").alias("value"), "target").toArrow()
        values[name] = rows["value"].combine_chunks()
        goals[name] = rows["target"].to_numpy()
        factors[name] = np.ones(len(goals[name]))

    def summed(wanted: list[str]) -> dict[str, np.ndarray]:
        parts = cells.select(*values, "tokens").mapInArrow(
            _marginal_sums(values, factors, wanted), "marginal string, place bigint, sum double")
        out = {name: np.zeros(len(goals[name])) for name in wanted}
        for r in parts.groupBy("marginal", "place").agg(F.sum("sum").alias("sum")).collect():
            out[r["marginal"]][r["place"]] = r["sum"]
        return out

    for turn in range(rounds + 1):
        sums = summed(list(targets))
        # values that no cell has cannot be met
        if turn == rounds or turn and all(np.abs(s[s > 0] / goals[name][s > 0] - 1).max(initial=0) <= tolerance for name, s in sums.items()):
            break
        for k, name in enumerate(targets):
            s = sums[name] if k == 0 else summed([name])[name]
            factors[name] = np.where(s > 0, factors[name] * goals[name] / np.where(s > 0, s, 1), 0.0)
    weighed = cells.withColumn("weight", F.lit(0.0))
    return weighed.mapInArrow(_weighted(values, factors), weighed.schema)


def mix(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        lang_col: str = "lang", powers: dict[str, float] = POWERS, topics: int = TOPICS, seed: int = SEED,
        scale: float | None = None) -> DataFrame:
    """The ``keep`` columns of every row, and ``tokens, topic, rate, probability, copies, sampled``.

    ``rate`` is the raked weight over the present one.  With ``scale``, a document's expected copies are ``rate`` *
    ``scale``, without it ``rate`` over the largest rate; ``probability`` is the chance of at least one copy.

    Null sources or languages are a value of their own.  A text without words has no tokens and topic 0, adds
    nothing to any weight, and takes its cell's rate, or 0 where no document of the cell has words.  Rows
    of equal ids are decided alike; a null id has a hash like any other.  An empty table gives no rows.  The
    text is read once; with the kept columns it is written once, if it is among them.
    """
    bounded_batches(docs.sparkSession)
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(_MISSING)).alias("source")
    language = F.coalesce(F.col(lang_col).cast("string"), F.lit(_MISSING)).alias("language")
    inside = text_col if text_col in keep and docs.schema[text_col].dataType.simpleString() == "string" else None
    body = [] if inside else [F.col(text_col).cast("string").alias("body")]     # a kept text is not sent twice
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(id_col).alias("id"), source, language, *body,
                       F.array().cast("array<int>").alias("groups"))
    counted = materialised(rows.mapInArrow(_word_groups(GROUPS, inside), rows.drop("body").schema), "groups")
    centres, shares = topic_centres(counted, topics, TOPIC_ROUNDS)
    shape = counted.select("kept", "id", "source", "language", F.lit("").alias("topic"), F.lit(0).cast("bigint").alias("tokens")).schema
    small = counted.select("source", "language", "groups").mapInArrow(
        _topics(centres, shares), "source string, language string, topic string, tokens bigint")
    cells = materialised(small.groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens"))
                         .filter("tokens > 0"), "cells")
    whole = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] or 1
    raked = materialised(rake(cells, tempered(cells, powers)), "raked")
    rates = raked.select("source", "language", "topic", (F.col("weight") / F.col("tokens") * whole).alias("rate"))
    largest = rates.agg(F.max("rate")).first()[0] or 1.0
    factor = F.lit(1 / largest if scale is None else float(scale))
    named = counted.mapInArrow(_topics(centres, shares), shape)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    expected = F.coalesce("rate", F.lit(0.0)) * factor
    copies = (F.floor(expected) + (draw < expected - F.floor(expected)).cast("bigint")).alias("copies")
    return (named.join(rates, ["source", "language", "topic"], "left")
            .select("kept.*", "tokens", "topic", F.coalesce("rate", F.lit(0.0)).alias("rate"),
                    F.least(F.lit(1.0), expected).alias("probability"), copies, (copies > 0).alias("sampled")))


def whole_copies(mixed: DataFrame, columns: list[Column | str]) -> DataFrame:
    """The sampled rows' ``columns``, each row as often as it has copies."""
    return mixed.filter("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)
