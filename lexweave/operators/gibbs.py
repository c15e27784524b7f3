"""Gibbs sweeps over blocks of documents: the numpy helpers that ``sampling`` runs in its tasks."""

from __future__ import annotations

import sys
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from lexweave.operators.variational import _lists, _none, known_words, terms_of, tokens_of, weights_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # workers need numpy and pyarrow, not this package

# positions as steps from token to token, which are small numbers
ROWS = {"words": pa.list_(pa.int32()), "steps": pa.list_(pa.int32()), "topics": pa.list_(pa.int16()), "weights": pa.list_(pa.float64()), "term": pa.string()}


def draws(seed: int, sweep: int, docs: list, of: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """``sampling.draw`` of tokens: a number from 0 to below 1 for each."""
    heads = [f"{seed}|{sweep}|{'' if d is None else f'{d}|'}".encode() for d in docs]
    numbers = {p: str(p).encode() for p in np.unique(pos).tolist()}
    digests = b"".join([md5(heads[o] + numbers[p]).digest()[:4] for o, p in zip(of.tolist(), pos.tolist())])
    return np.frombuffer(digests, ">u4").astype(float) / 2 ** 32


def _rows(docs: pa.Table, size, words, pos, topics, k: int, names: pa.Array, place: np.ndarray) -> pa.Table:
    """Documents with their tokens, and for each word of the block the tokens of every topic; ``place`` is where a word's name stands."""
    at = place[words]
    counted = np.stack([np.bincount(at[topics == j], minlength=len(names)) for j in range(k)], axis=1).astype(float)
    met = np.flatnonzero(counted.sum(axis=1))
    some = np.flatnonzero(size)
    docs = docs.select(["block", "doc_id"]).combine_chunks().take(pa.array(some))
    parts = [pa.concat_arrays([pa.nulls(len(met), docs[c].type), *docs[c].chunks]) for c in docs.column_names]
    ends = np.cumsum(size[some])
    steps = np.diff(pos, prepend=0)
    steps[ends[:-1]] = pos[ends[:-1]]
    for name, x in (("words", words), ("steps", steps), ("topics", topics)):
        kind = ROWS[name]
        parts.append(pa.concat_arrays([pa.nulls(len(met), kind), _lists(size[some], x.astype(kind.value_type.to_pandas_dtype()))]))
    parts.append(pa.concat_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1) * k, pa.int32()), pa.array(counted[met].ravel())),
                                   pa.nulls(len(some), ROWS["weights"])]))
    parts.append(pa.concat_arrays([names.take(pa.array(met)), pa.nulls(len(some), names.type)]))
    return pa.Table.from_arrays(parts, names=["block", "doc_id", *ROWS])


def _place(words: pa.Table, most: int) -> np.ndarray:
    numbers = words["word"].to_numpy()
    place = np.full(max(most, numbers.max()) + 1, -1)
    place[numbers] = np.arange(len(numbers))
    return place


def starter(seed: int, k: int):
    """The tokens of a block of ``lda.TokenBlocks`` whose words are known, with their first topics."""
    def start(docs: pa.Table, words: pa.Table) -> pa.Table:
        if not words.num_rows or not docs.num_rows:
            return _none(docs, {"block": None, "doc_id": None, **ROWS})
        of, entry, pos = tokens_of(docs)
        kept = known_words(docs, words)[entry]
        of, pos = of[kept], pos[kept]
        ids = docs.combine_chunks()["ids"].chunk(0).flatten().to_numpy()[entry[kept]]
        topics = np.floor(draws(seed, 0, docs["doc_id"].to_pylist(), of, pos) * k).astype(int)
        return _rows(docs, np.bincount(of, minlength=docs.num_rows), ids, pos, topics, k, terms_of(words), _place(words, int(ids.max(initial=0))))
    return start


def _tokens(docs: pa.Table):
    docs = docs.combine_chunks()
    words, steps, topics = (docs[c].chunk(0).flatten().to_numpy() for c in ("words", "steps", "topics"))
    size = np.diff(docs["words"].chunk(0).offsets.to_numpy())
    pos = np.cumsum(steps, dtype=np.int64)
    starts = np.cumsum(size) - size
    pos -= np.repeat(pos[starts] - steps[starts], size)
    return size, np.repeat(np.arange(len(size)), size), words, pos.astype(np.int32), topics.astype(np.int32)


def _by_document(of: np.ndarray, topics: np.ndarray, docs: int, k: int) -> np.ndarray:
    return np.bincount(of * k + topics, minlength=docs * k).reshape(docs, k).astype(float)


def sweeper(seed: int, sweep: int, alpha: list[float], beta: float, totals: list[int], whole: float):
    """New topics of a block's tokens, drawn from the counts of the sweep before with each token's own left out."""
    k = len(alpha)

    def step(docs: pa.Table, words: pa.Table) -> pa.Table:
        if not words.num_rows or not docs.num_rows:
            return _none(docs, {"block": None, "doc_id": None, **ROWS})
        size, of, ids, pos, topics = _tokens(docs)
        place = _place(words, int(ids.max()))
        by_doc, by_term, at = _by_document(of, topics, len(size), k), weights_of(words, k), place[ids]
        upto, total = np.empty((k, len(ids))), np.zeros(len(ids))
        for j in range(k):
            own = (topics == j).astype(float)
            total = total + (by_doc[of, j] - own + alpha[j]) * (by_term[j, at] - own + beta) / (totals[j] - own + whole)
            upto[j] = total
        aim = draws(seed, sweep, docs["doc_id"].to_pylist(), of, pos) * total
        return _rows(docs, size, ids, pos, np.minimum((upto <= aim).sum(axis=0), k - 1), k, terms_of(words), place)
    return step


def lister():
    """``doc_id, pos, term, topic`` of a block's tokens."""
    def rows(docs: pa.Table, words: pa.Table) -> pa.Table:
        if not words.num_rows or not docs.num_rows:
            return _none(docs, {"doc_id": None, "pos": pa.int32(), "term": pa.string(), "topic": pa.int32()})
        _, of, ids, pos, topics = _tokens(docs)
        return pa.Table.from_arrays([docs.combine_chunks()["doc_id"].chunk(0).take(pa.array(of)), pa.array(pos), terms_of(words).take(
            pa.array(_place(words, int(ids.max()))[ids])), pa.array(topics)], names=["doc_id", "pos", "term", "topic"])
    return rows


def judge(alpha: list[float], beta: float, totals: list[int], whole: float, every: int):
    """``tokens, log_likelihood`` of a block's tokens whose position ``every`` divides, by document completion."""
    k = len(alpha)

    def judged(docs: pa.Table, words: pa.Table) -> pa.Table:
        if not words.num_rows or not docs.num_rows:
            return pa.table({"tokens": pa.array([], pa.int64()), "log_likelihood": pa.array([], pa.float64())})
        size, of, ids, pos, topics = _tokens(docs)
        by_doc, by_term = _by_document(of, topics, len(size), k), weights_of(words, k)
        held = pos % every == 0
        of, at, length = of[held], _place(words, int(ids.max()))[ids[held]], size + sum(alpha)
        chance = sum((by_doc[of, j] + alpha[j]) / length[of] * (by_term[j, at] + beta) / (totals[j] + whole) for j in range(k))
        if not len(of):
            return pa.table({"tokens": pa.array([], pa.int64()), "log_likelihood": pa.array([], pa.float64())})
        return pa.table({"tokens": pa.array([len(of)], pa.int64()), "log_likelihood": pa.array([float(np.log(chance).sum())])})
    return judged
