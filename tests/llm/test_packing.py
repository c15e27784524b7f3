"""Packed sequences: an exact round trip to the ids of the public tokenizer, full sequences, merged leftovers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import packing
from lexweave.llm.token_ids import Encoder, public_vocabulary

SCHEMA = "doc_id bigint, text string, ids string, part string, open string"
LONG = " ".join(f"w{i % 977}é{i % 13}" for i in range(240_000))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_vocabulary())


def check(rows, expected, window):
    """``expected``: ids of each document by name; returns the lengths of the sequences."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(expected)
    for doc, ids in expected.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids[at:at + r["length"]]
            at += r["length"]
        assert at == len(ids)
    lengths = []
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window and (at == window or at & (at - 1) == 0)
        lengths.append(at)
    return lengths


def test_round_trip_with_odd_texts(spark, tokenizer):
    texts = [None, "", " ", "\n\n  \t x  ", "a <|endoftext|> b", "ünï 😀 çödé's  12", LONG, "a", "a", "don't  stop\r\n now "]
    docs = spark.createDataFrame([(i, t, *"xxx") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    expected = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    check(packing.pack(docs).collect(), expected, 1024)
    assert packing.pack(docs.limit(0)).collect() == []


def test_ids_of_all_texts_equal_the_tokenizer(spark, tokenizer):
    with open(public_vocabulary(), encoding="utf-8") as f:
        encoder = Encoder(f.read())
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in texts:
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("partitions, fan_in", [(1, 64), (9, 2), (9, 3)])
def test_leftovers_are_merged_over_partitions(spark, tokenizer, partitions, fan_in):
    draw = random.Random(partitions)
    texts = [" ".join(draw.choice(["alpha", "beta", "of"]) for _ in range(draw.choice([0, 3, 20, 70, 300]))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, *"xxx") for i, t in enumerate(texts)], SCHEMA).repartition(partitions)
    expected = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    lengths = check(packing.pack(docs, window=128, open_windows=4, fan_in=fan_in).collect(), expected, 128)
    assert sum(n < 128 for n in lengths) <= 7       # the powers of two of one remainder


def test_rows_of_equal_or_null_ids_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(7, "x y", *"xxx"), (7, "x y", *"xxx"), (None, "x y", *"xxx")], SCHEMA)
    rows = packing.pack(docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows if r["start"] == 0) == ["7", "7", "None"]
    assert sum(r["length"] for r in rows) == 9


def test_windows_take_the_best_fit_and_emit_the_fullest():
    windows = packing.Windows(10, 2)

    def put(name, n):
        return [[(p[0], len(p[3])) for p in w] for w in windows.place([(name, 0, n, np.arange(n))], n)]

    assert put("a", 6) == [] and put("b", 7) == []          # rooms 4 and 3
    assert put("c", 3) == [[("b", 7), ("c", 3)]]            # the room that fits exactly
    assert put("d", 8) == []                                # rooms 2 and 4
    assert put("e", 5) == [[("d", 8), ("e", 2)]]            # fits nowhere: the fullest is filled, the rest placed anew
    assert [[(p[0], p[1], len(p[3])) for p in w] for w in windows.rest()] == [[("a", 0, 6), ("e", 2, 3)]]


def test_padding(spark):
    lengths = spark.createDataFrame([(1024,), (512,), (1,), (3,), (1000,)], "n bigint")
    assert [r[0] for r in lengths.select(packing.padding(F.col("n"))).collect()] == [0, 0, 0, 1021, 24]
