"""Variational inference for blocks of documents: the numpy helpers that ``lda.train_variational`` runs in its tasks."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # workers need numpy and pyarrow, not this package

CHUNK = 100_000         # words of documents that are worked on at once
SETTLED = 1e-3          # a document is done when a step changes its weights by no more on average
EXTRAPOLATED = 500      # steps after which a document goes on by plain steps
LONGEST = 64            # of an extrapolation, in steps


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence to x + 6 and the asymptotic series there."""
    y = x + 6.0
    r = 1.0 / (y * y)
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    return np.log(y) - 0.5 / y - series - sum(1.0 / (x + i) for i in range(6))


def trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 6.0
    r = 1.0 / (y * y)
    series = (1.0 + r * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))) / y
    return series + 0.5 * r + sum(1.0 / (x + i) ** 2 for i in range(6))


def expected_logs(weights: np.ndarray) -> np.ndarray:
    """Expected logarithms of shares under Dirichlet weights, topics by documents."""
    return digamma(weights) - digamma(weights.sum(axis=0))


def newton_step(alpha: np.ndarray, mean_logs: np.ndarray, documents: float, rate: float) -> np.ndarray:
    """Document weights one step nearer to the documents' expected logs; unchanged if one would not be positive."""
    gradient = documents * (mean_logs - expected_logs(alpha))
    q = -documents * trigamma(alpha)
    c = documents * trigamma(alpha.sum())
    shift = (gradient / q).sum() / (1.0 / c + (1.0 / q).sum())
    moved = alpha - rate * (gradient - shift) / q
    return moved if (moved > 0).all() else alpha


def extrapolated(x0: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Where three successive iterates of a document head for: a squared step (SQUAREM) of their logarithms."""
    logs = np.log(x0)
    first = np.log(x1) - logs
    second = np.log(x2) - logs - 2 * first
    length = np.sqrt((first ** 2).sum(axis=0) / np.maximum((second ** 2).sum(axis=0), 1e-300)).clip(1, LONGEST)
    ahead = np.exp((logs + 2 * length * first + length ** 2 * second).clip(-50, 50))
    return np.maximum(ahead * (x2.sum(axis=0) / ahead.sum(axis=0)), 1e-8)


def settled(beta: np.ndarray, n: np.ndarray, starts: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Topic weights of each document (topics by documents), iterated until a step moves them by no more than ``SETTLED``.

    Columns of ``beta`` (topics by words) and entries of ``n`` are the words of documents, which begin at ``starts``.
    Most of the way is extrapolated, as plain steps are many and small where topics differ little; a document that has
    not settled after ``EXTRAPOLATED`` steps goes on by plain ones, which never lower its bound.
    """
    k, docs = len(alpha), len(starts)
    found, left, lengths = np.empty((k, docs)), np.arange(docs), np.diff(np.append(starts, len(n)))
    x = np.ones((k, docs))
    before, moving, steps = [], np.ones(docs, dtype=bool), 0
    while True:
        theta = np.exp(expected_logs(x))
        share = n / (np.einsum("ij,ij->j", beta, np.repeat(theta, lengths, axis=1)) + 1e-100)
        new = theta * np.add.reduceat(beta * share, starts, axis=1) + alpha[:, None]
        steps += 1
        stopped = moving & (np.abs(new - x).mean(axis=0) <= SETTLED)
        found[:, left[stopped]] = new[:, stopped]
        moving &= ~stopped
        if not moving.any():
            return found
        if steps <= 3 or steps > EXTRAPOLATED:
            x, before = new, []
        elif not before:
            x, before = new, [x, new]
        else:
            x, before = extrapolated(*before, new), []
        if lengths[moving].sum() < 0.8 * len(n):    # go on with the documents that still move
            rows = np.repeat(moving, lengths)
            beta, n, lengths, left, x = beta[:, rows], n[rows], lengths[moving], left[moving], x[:, moving]
            before = [y[:, moving] for y in before]
            starts, moving = np.cumsum(lengths) - lengths, np.ones(len(left), dtype=bool)


def weights_of(words: pa.Table, k: int) -> np.ndarray:
    """Weights of a block's words, topics by words."""
    return np.ascontiguousarray(words.combine_chunks()["weights"].chunk(0).flatten().to_numpy().reshape(-1, k).T)


def terms_of(words: pa.Table) -> pa.Array:
    return words.combine_chunks()["term"].chunk(0)


def _places(docs: pa.Table, words: pa.Table) -> np.ndarray:
    """Places in ``words`` of the words of a block's documents, -1 for words not in the table."""
    ids, numbers = docs.combine_chunks()["ids"].chunk(0).flatten().to_numpy(), words["word"].to_numpy()
    place = np.full(max(ids.max(), numbers.max()) + 1, -1)
    place[numbers] = np.arange(len(numbers))
    return place[ids]


def known_words(docs: pa.Table, words: pa.Table) -> np.ndarray:
    return _places(docs, words) >= 0


def documents_of(docs: pa.Table, words: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``words`` and counts of the words of a block's documents, one after the other, the documents' offsets,
    and which documents these are: words not in the table are left out, and documents that have no others."""
    docs = docs.combine_chunks()
    n, places = docs["counts"].chunk(0).flatten().to_numpy(), _places(docs, words)
    known = places >= 0
    starts = np.cumsum(lengths := pc.list_value_length(docs["ids"]).to_numpy()) - lengths
    having = np.add.reduceat(known.astype(np.int64), starts)
    rows = np.flatnonzero(having)
    return places[known], n[known].astype(float), np.concatenate([[0], np.cumsum(having[rows])]), rows


def chunks(offsets: np.ndarray):
    """First and last documents of chunks of about ``CHUNK`` words."""
    first, docs = 0, len(offsets) - 1
    while first < docs:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        yield first, last
        first = last


def inferred(ids, n, offsets, beta, alpha) -> np.ndarray:
    """Topic weights of a block's documents, some documents at a time."""
    out = np.empty((len(alpha), len(offsets) - 1))
    for first, last in chunks(offsets):
        a, b = offsets[first], offsets[last]
        out[:, first:last] = settled(beta[:, ids[a:b]], n[a:b], offsets[first:last] - a, alpha)
    return out


def packer():
    """Rows ``block, doc_id, term, n`` of a block to one row for each document, and one with the block's words."""
    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block = table["block"][0].as_py()
        docs = table["doc_id"].chunk(0).dictionary_encode(null_encoding="encode")
        words = table["term"].chunk(0).dictionary_encode()
        at = docs.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(docs.dictionary)))]), pa.int32())
        size = len(docs.dictionary)
        numbers = words.indices.to_numpy().astype(np.int32)[order]
        counts = table["n"].to_numpy()[order]
        # the block's words stand in a row without documents
        columns = [
            pa.array([block] * (size + 1), pa.int32()),
            pa.concat_arrays([docs.dictionary, pa.nulls(1, docs.dictionary.type)]),
            pa.concat_arrays([pa.ListArray.from_arrays(offsets, pa.array(numbers)), pa.nulls(1, pa.list_(pa.int32()))]),
            pa.concat_arrays([pa.ListArray.from_arrays(offsets, pa.array(counts)), pa.nulls(1, pa.list_(pa.int64()))]),
            pa.concat_arrays([pa.nulls(size, pa.list_(words.dictionary.type)),
                              pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)]),
        ]
        return pa.Table.from_arrays(columns, names=["block", "doc_id", "ids", "counts", "terms"])
    return pack


def _lists(lengths: np.ndarray, values: np.ndarray, none: np.ndarray | None = None) -> pa.ListArray:
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values), mask=None if none is None else pa.array(none))


def block_of_texts(block: int, table: pa.Table) -> pa.RecordBatch:
    """Rows ``doc_id, words``, those of one id together, as one row for each id and one with the block's words.

    ``ids`` and ``counts`` are a document's distinct words, ``at`` the place among these of each of its tokens, and
    ``pos`` the tokens' positions where several rows have the id; else they are numbered as they come.
    """
    table = table.combine_chunks()
    ids_of, words = table["doc_id"].chunk(0), table["words"].chunk(0)
    lengths = pc.list_value_length(words).to_numpy()
    terms = pc.list_flatten(words).dictionary_encode()
    ids, size = terms.indices.to_numpy().astype(np.int64), max(1, len(terms.dictionary))
    same = ids_of.dictionary_encode(null_encoding="encode").indices.to_numpy()
    first = np.concatenate([[True], same[1:] != same[:-1]])
    of_row = np.cumsum(first) - 1
    of_token, docs = np.repeat(of_row, lengths), int(of_row[-1]) + 1
    entries, inverse, counts = np.unique(of_token * size + ids, return_inverse=True, return_counts=True)
    distinct = np.bincount(entries // size, minlength=docs)
    tokens, rows = np.bincount(of_token, minlength=docs), np.bincount(of_row, minlength=docs)
    at = inverse - np.repeat(np.cumsum(distinct) - distinct, tokens)
    pos = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    several = rows > 1
    vocabulary = terms.dictionary

    def column(values: pa.Array, last: pa.Array) -> pa.Array:
        return pa.concat_arrays([values, last])

    def of_words(values: pa.Array) -> pa.Array:
        kind = pa.list_(values.type)
        return column(pa.nulls(docs, kind), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))

    def none(values: pa.Array) -> pa.Array:
        return column(values, pa.nulls(1, values.type))

    in_words = entries % size
    return pa.RecordBatch.from_arrays([
        pa.array([block] * (docs + 1), pa.int64()), none(ids_of.filter(pa.array(first))),
        none(_lists(distinct, in_words.astype(np.int32))), none(_lists(distinct, counts.astype(np.int64))),
        none(_lists(tokens, at.astype(np.int32))),
        none(_lists(np.where(several, tokens, 0), pos[several[of_token]].astype(np.int32), ~several)),
        of_words(vocabulary), of_words(pa.array(np.bincount(ids, minlength=size)[:len(vocabulary)], pa.int64())),
        of_words(pa.array(np.bincount(in_words, minlength=size)[:len(vocabulary)], pa.int64()))],
        names=["block", "doc_id", "ids", "counts", "at", "pos", "terms", "term_freq", "doc_freq"])


def text_packer(size: int):
    """Texts in order of their id to blocks of about ``size`` tokens, in which all rows of an id are together."""
    def pack(batches):
        from pyspark import TaskContext

        block, left = TaskContext.get().partitionId() << 20, []
        for batch in batches:
            left.append(batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch["words"]), 0), 0)))
            table = pa.Table.from_batches(left)
            while table.num_rows:
                total = np.cumsum(pc.list_value_length(table["words"]).to_numpy())
                full = int(np.searchsorted(total, size))
                same = pc.dictionary_encode(table["doc_id"].combine_chunks(), null_encoding="encode").indices.to_numpy() if full < len(total) else np.empty(0)
                ends = np.flatnonzero(same[full + 1:] != same[full:-1]) if len(same) else same
                if not len(ends):
                    break
                cut = full + int(ends[0]) + 1
                yield block_of_texts(block, table.slice(0, cut))
                block, table = block + 1, table.slice(cut)
            left = table.to_batches()
        if sum(b.num_rows for b in left):
            yield block_of_texts(block, pa.Table.from_batches(left))
    return pack


def _none(docs: pa.Table, columns: dict) -> pa.Table:
    """No rows, of the columns of ``docs`` named and others of the types given."""
    return pa.table({c: pa.array([], docs.schema.field(c).type if t is None else t) for c, t in columns.items()})


def summer(totals: np.ndarray, alpha: np.ndarray):
    """Sums of a block for the next model: of each word the counts by topic; in a row without a word the documents and
    their expected logs."""
    k = len(alpha)

    def sums(docs: pa.Table, words: pa.Table) -> pa.Table:
        if not words.num_rows:
            return _none(docs, {"term": pa.string(), "documents": pa.int64(), **{f"t{j}": pa.float64() for j in range(k)}})
        ids, n, offsets, _ = documents_of(docs, words)
        beta = np.exp(digamma(weights_of(words, k)) - digamma(totals)[:, None])
        logs = expected_logs(inferred(ids, n, offsets, beta, alpha))
        theta, lengths = np.exp(logs), np.diff(offsets)
        share = np.empty(len(n))
        for first, last in chunks(offsets):
            at = slice(offsets[first], offsets[last])
            share[at] = n[at] / (np.einsum("ij,ij->j", beta[:, ids[at]], np.repeat(theta[:, first:last], lengths[first:last], axis=1)) + 1e-100)
        columns = [np.append(np.bincount(ids, weights=share * np.repeat(theta[j], lengths), minlength=beta.shape[1]) * beta[j],
                             logs[j].sum()) for j in range(k)]
        terms = terms_of(words)
        documents = np.append(np.zeros(len(terms), dtype=np.int64), len(lengths))
        return pa.Table.from_arrays([pa.concat_arrays([terms, pa.nulls(1, terms.type)]), pa.array(documents), *map(pa.array, columns)],
                                    names=["term", "documents", *[f"t{j}" for j in range(k)]])
    return sums


def describer(totals: np.ndarray, alpha: np.ndarray):
    """Topic shares of a block's documents."""
    k = len(alpha)

    def describe(docs: pa.Table, words: pa.Table) -> pa.Table:
        columns = ["block", "doc_id", "ids", "counts"]
        if not words.num_rows:
            return _none(docs, {**dict.fromkeys(columns), "weights": pa.list_(pa.float64())})
        *found, rows = documents_of(docs, words)
        beta = np.exp(digamma(weights_of(words, k)) - digamma(totals)[:, None])
        weights = inferred(*found, beta, alpha).T
        shares = pa.array((weights / weights.sum(axis=1, keepdims=True)).ravel())
        offsets = pa.array(np.arange(len(weights) + 1) * k, pa.int32())
        return docs.select(columns).take(pa.array(rows)).append_column("weights", pa.ListArray.from_arrays(offsets, shares))
    return describe


def shares_of(docs: pa.Table, rows: np.ndarray, k: int) -> np.ndarray:
    """Topic shares of some of a block's documents, topics by documents."""
    return np.ascontiguousarray(docs.combine_chunks()["weights"].chunk(0).flatten().to_numpy().reshape(-1, k)[rows].T)


def maximiser(totals: np.ndarray, alpha: np.ndarray, runs: int = 1):
    """One step of expectation-maximisation for a block: of each word the counts by topic, and the documents with their new
    shares.  The topics of several runs stand one after the other."""
    k = len(alpha) // runs

    def step(docs: pa.Table, words: pa.Table) -> pa.Table:
        columns = ["block", "doc_id", "ids", "counts"]
        if not words.num_rows or not docs.num_rows:
            return _none(docs, {**dict.fromkeys(columns), "weights": pa.list_(pa.float64()), "term": pa.string()})
        ids, n, offsets, rows = documents_of(docs, words)
        beta, theta, lengths = weights_of(words, len(alpha)) / totals[:, None], shares_of(docs, rows, len(alpha)), np.diff(offsets)
        counted, terms = np.zeros((beta.shape[1], len(alpha))), terms_of(words)
        for first, last in chunks(offsets):
            at, starts = ids[offsets[first]:offsets[last]], offsets[first:last] - offsets[first]
            for own in (slice(r * k, r * k + k) for r in range(runs)):
                share = beta[own, at] * np.repeat(theta[own, first:last], lengths[first:last], axis=1)
                share *= n[offsets[first]:offsets[last]] / share.sum(axis=0)
                for j, x in enumerate(share):
                    counted[:, own.start + j] += np.bincount(at, weights=x, minlength=len(counted))
                new = np.add.reduceat(share, starts, axis=1) + alpha[own, None]
                theta[own, first:last] = new / new.sum(axis=0)
        met = np.flatnonzero(np.bincount(ids, minlength=len(counted)))
        docs = docs.select(columns).combine_chunks().take(pa.array(rows))
        size, offset = len(met), pa.array(np.arange(len(met) + len(rows) + 1) * len(alpha), pa.int32())
        return pa.Table.from_arrays(
            [pa.concat_arrays([pa.nulls(size, docs[c].type), *docs[c].chunks]) for c in columns]
            + [pa.ListArray.from_arrays(offset, pa.array(np.concatenate([counted[met].ravel(), theta.T.ravel()]))),
               pa.concat_arrays([terms.take(pa.array(met)), pa.nulls(len(rows), terms.type)])], names=[*columns, "weights", "term"])
    return step


def _chosen(docs: pa.Table, words: pa.Table, k: int, runs: int = 1):
    """``documents_of`` and, for each run, the topic of largest weight for each word of each document; ties go to the smaller topic."""
    ids, n, offsets, rows = documents_of(docs, words)
    shares, beta, lengths = shares_of(docs, rows, k * runs), weights_of(words, k * runs), np.diff(offsets)
    topics = np.empty((runs, len(ids)), dtype=np.int32)
    for first, last in chunks(offsets):
        at = slice(offsets[first], offsets[last])
        for r in range(runs):
            own = slice(r * k, r * k + k)
            topics[r, at] = (beta[own, ids[at]] * np.repeat(shares[own, first:last], lengths[first:last], axis=1)).argmax(axis=0)
    return ids, n, offsets, rows, topics


def chooser(k: int):
    """The topic of each word of each document of a block."""
    def choose(docs: pa.Table, words: pa.Table) -> pa.Table:
        if not words.num_rows or not docs.num_rows:
            return _none(docs, {"doc_id": None, "term": pa.string(), "n": pa.int64(), "topic": pa.int32()})
        ids, n, offsets, rows, topics = _chosen(docs, words, k)
        at = pa.array(np.repeat(rows, np.diff(offsets)))
        return pa.Table.from_arrays([docs.combine_chunks()["doc_id"].chunk(0).take(at), terms_of(words).take(pa.array(ids)),
                                     pa.array(n.astype(np.int64)), pa.array(topics[0])], names=["doc_id", "term", "n", "topic"])
    return choose


def tokens_of(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``docs``, place among all words of its documents, and position of every token."""
    docs = docs.combine_chunks()
    tokens, distinct = (pc.list_value_length(docs[c].chunk(0)).to_numpy() for c in ("at", "ids"))
    of = np.repeat(np.arange(len(tokens)), tokens)
    entry = docs["at"].chunk(0).flatten().to_numpy() + np.repeat(np.cumsum(distinct) - distinct, tokens)
    pos = (np.arange(len(of)) - np.repeat(np.cumsum(tokens) - tokens, tokens)).astype(np.int32)
    given = docs["pos"].is_valid().combine_chunks().to_numpy(zero_copy_only=False)
    if given.any():
        pos[given[of]] = docs["pos"].chunk(0).flatten().to_numpy()
    return of, entry, pos


def assigner(k: int, runs: int):
    """``doc_id, pos, terms, topics`` of a block's documents: their tokens whose words are known, and the topics of these in each run."""
    def assign(docs: pa.Table, words: pa.Table) -> pa.Table:
        numbers = pa.list_(pa.int32())
        if not words.num_rows or not docs.num_rows:
            return _none(docs, {"doc_id": None, "pos": numbers, "terms": pa.list_(pa.string()), "topics": pa.list_(numbers)})
        ids, _, _, _, topics = _chosen(docs, words, k, runs)
        of, entry, pos = tokens_of(docs)
        known = known_words(docs, words)
        kept = known[entry]
        entry, of = (np.cumsum(known) - 1)[entry[kept]], of[kept]
        size = np.bincount(of, minlength=docs.num_rows)
        # the runs of a document one after the other
        order = np.argsort(np.tile(of, runs), kind="stable")
        each = _lists(np.repeat(size, runs), topics[:, entry].ravel()[order])
        terms = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), terms_of(words).take(pa.array(ids[entry])))
        every = pa.ListArray.from_arrays(pa.array(np.arange(docs.num_rows + 1) * runs, pa.int32()), each)
        return pa.Table.from_arrays([docs.combine_chunks()["doc_id"].chunk(0), _lists(size, pos[kept]), terms, every],
                                    names=["doc_id", "pos", "terms", "topics"])
    return assign


def joiner():
    """``__text, __out``: the words of a block's texts that are in the table, joined by blanks."""
    def join(docs: pa.Table, words: pa.Table) -> pa.Table:
        if not words.num_rows or not docs.num_rows:
            return pa.table({"__text": pa.array([], docs.schema.field("doc_id").type), "__out": pa.array([], pa.string())})
        of, entry, _ = tokens_of(docs)
        places = _places(docs, words)[entry]
        kept = places >= 0
        size = np.bincount(of[kept], minlength=docs.num_rows)
        offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, terms_of(words).take(pa.array(places[kept])))
        return pa.table({"__text": docs.combine_chunks()["doc_id"], "__out": pc.binary_join(lists, " ")})
    return join


def pair_counter(places: dict):
    """Rows ``group, doc_id, name, pos, topics``, a document's together, to counts of the topics that two runs give to one token.

    ``places`` has the number of the first run of each name.  A token that comes twice in a document counts once, with its largest topic.
    """
    def count(batches):
        cells, now, parts = {}, None, []

        def close():
            runs = max(places[name] + len(topics) for name, _, topics in parts)
            size = max(int(pos.max()) for _, pos, _ in parts if len(pos)) + 1 if any(len(pos) for _, pos, _ in parts) else 0
            met = np.full((runs, size), -1)
            for name, pos, topics in parts:
                for r, found in enumerate(topics):
                    np.maximum.at(met[places[name] + r], pos, found)
            for a in range(runs):
                for b in range(a + 1, runs):
                    both = (met[a] >= 0) & (met[b] >= 0)
                    codes, counts = np.unique((met[a][both] << 32) | met[b][both], return_counts=True)
                    for code, n in zip(codes.tolist(), counts.tolist()):
                        key = (now[0], a, b, code >> 32, code & 0xffffffff)
                        cells[key] = cells.get(key, 0) + n

        for batch in batches:
            group, doc, name = (batch[c].to_pylist() for c in ("group", "doc_id", "name"))
            for i in range(batch.num_rows):
                if now != (group[i], doc[i]):
                    if parts:
                        close()
                    now, parts = (group[i], doc[i]), []
                parts.append((name[i], batch["pos"][i].values.to_numpy(), [x.values.to_numpy() for x in batch["topics"][i]]))
        if parts:
            close()
        rows = list(cells.items())
        columns = [pa.array([key[c] for key, _ in rows], pa.int32()) for c in range(5)] + [pa.array([n for _, n in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["group", "a", "b", "topic_a", "topic_b", "n"])
    return count
