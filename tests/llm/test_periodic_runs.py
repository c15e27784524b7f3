"""Runs and collapsed texts against a plain scan of every lag."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import periodic_runs
from lexweave.llm.queries import LLM_QUERIES


def plain_runs(words):
    out = []
    for lag in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - lag:
            if words[i] != words[i + lag]:
                i += 1
                continue
            j = i
            while j < len(words) - lag and words[j] == words[j + lag]:
                j += 1
            length = j - i + lag
            smaller = any(all(words[k] == words[k + r] for k in range(i, i + length - r)) for r in range(1, lag))
            if length >= max(6, 4 * lag) and not smaller:
                out.append((i, length, lag))
            i = j + 1
    return sorted(out)


def plain_collapsed(words):
    gone = {i for s, n, q in plain_runs(words) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(draw):
    """Words of a small alphabet with repeated stretches, also one within another."""
    words = [draw.choice("abcdefgh") for _ in range(draw.randint(0, 30))]
    for _ in range(draw.randint(0, 4)):
        unit = [draw.choice("abc") for _ in range(draw.randint(1, 7))]
        if draw.random() < 0.4:
            unit = unit * draw.randint(4, 6) + [draw.choice("xy")]
        unit = unit * draw.randint(3, 6)
        words += unit[:len(unit) - draw.randint(0, 3)] + [draw.choice("abcxyz") for _ in range(draw.randint(0, 5))]
    return words


def test_runs_equal_a_scan_of_every_lag():
    draw = random.Random(5)
    texts = [made(draw) for _ in range(300)]
    names = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    flat = np.array([names[w] for t in texts for w in t])
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, length, period = periodic_runs.runs_in(flat, text)
    got = {k: [] for k in range(len(texts))}
    for s, n, q in zip(start, length, period):
        k = int(text[s])
        got[k].append((int(s - first[k]), int(n), int(q)))
    assert [got[k] for k in got] == [plain_runs(t) for t in texts]
    assert sum(map(len, got.values())) > 200


def test_splitting_keeps_every_word_of_a_run_and_settles():
    words = np.array([0, 1] * 6 + [2, 3, 2, 3, 4, 2, 3] + [5] * 6)
    place, segment = periodic_runs.surviving(words, np.zeros(len(words), np.int64))
    assert set(range(12)) | set(range(19, 25)) == set(place.tolist())
    assert len(set(segment.tolist())) == 2


def test_periods_of_a_long_text():
    draw = random.Random(2)
    unit = [f"w{draw.randint(0, 400)}" for _ in range(5003)]
    words = [str(i % 700) for i in range(2000)] + ["|"] + unit * 4 + unit[:17]
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    found = periodic_runs.runs_in(np.array([names[w] for w in words]), np.zeros(len(words), np.int64))
    assert [tuple(map(int, r)) for r in zip(*found)] == [(2001, 4 * 5003 + 17, 5003)]


SCHEMA = "doc_id bigint, text string, kept string, runs string, collapsed string, n_words string"


def test_texts_with_odd_content(spark):
    long = " ".join(f"w{i % 977}é{i % 13}" for i in range(240_000))     # a period of 12,701 words, over two slices of text
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a\ta\n\na\r a  a a b", "A a A a A a A a",
             "ü ö ü ö ü ö ü ö 😀", "x " * 50 + "y", "           ", long, "a b c d e f"]
    rows = [(None if i == 3 else i // 2, t, *"xxxx") for i, t in enumerate(texts)]     # ids repeat, one is null
    docs = spark.createDataFrame(rows, SCHEMA)
    found = periodic_runs.find_runs(docs, ["doc_id", "kept", "text"]).collect()
    assert len(found) == len(texts)
    for r in found:
        words = [w for w in (r["text"] or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
        assert r["n_words"] == len(words) and r["kept"] == "x"
        if len(words) > 1000:
            assert [tuple(x) for x in r["runs"]] == [(0, 240_000, 12_701)]
            assert r["collapsed"] == " ".join(words[:12_701])
        else:
            assert [tuple(x) for x in r["runs"]] == plain_runs(words)
            assert r["collapsed"] == plain_collapsed(words)
    assert periodic_runs.find_runs(docs.limit(0), ["doc_id"]).collect() == []


def test_query_against_plain_version(spark, tmp_path):
    import hashlib
    import zlib

    draw = random.Random(8)
    texts = [" ".join(made(draw)) for _ in range(120)] + [None, "", "  ", "one"]
    docs = spark.createDataFrame([(None if i == 50 else i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    planted = 0
    for r in LLM_QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect():
        i = 50 if r["doc_id"] is None else r["doc_id"]
        words = [w for w in (texts[i] or "").split(" ") if w]
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
            planted += 1
        runs = plain_runs(words)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_collapsed(words).encode()).hexdigest()
    assert planted > 5


@pytest.mark.parametrize("n", [1, 7])
def test_every_row_of_a_partition_is_answered(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b a b a b a b").alias("text"))
    assert [len(r["runs"]) for r in periodic_runs.find_runs(docs, ["doc_id"]).collect()] == [1] * n
