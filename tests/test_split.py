"""Splitters against plain Python on generated and hand-made documents."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import split


def by_word_count(text, n):
    words = text.split()
    return [" ".join(words[i:i + n]) for i in range(0, len(words), n)]


def by_blank_line(text):
    passages, current = [], []
    lines = text.replace("\r\n", "\n").split("\n")
    if lines[-1] == "":
        lines.pop()
    for line in lines:
        if line.strip() == "":
            if current:
                passages.append(" ".join(current))
            current = []
        else:
            current += line.split()
    if current or not lines or lines[-1].strip() == "":
        passages.append(" ".join(current))
    return passages


def by_line_count(text, k, m):
    lines = [line.split() for line in text.replace("\r\n", "\n").split("\n") if line.strip()]
    passages, group = [], []
    for line in lines:
        if len(group) >= k and sum(map(len, group)) >= m:
            passages.append(group)
            group = []
        group.append(line)
    if group:
        passages.append(group)
    return [" ".join(w for line in g for w in line) for g in passages]


def texts():
    rnd = random.Random(3)
    made = ["", " ", "\n", "one", "one\n", "one\n\n", "one\n  ", "\n\none", "a\n\nb\n \n\t\nc d\te\n\n",
            "a b\r\nc\r\n\r\nd", "l1\nl2\nl3", "l1\nl2\nl3\nl4\n", "\t\n\na\n"]
    for _ in range(60):
        lines = [" ".join("w" * rnd.randint(1, 4) for _ in range(rnd.choice([0, 0, 1, 3, 7])))
                 for _ in range(rnd.randint(0, 14))]
        made.append("\n".join(lines) + rnd.choice(["", "\n", "\n\n", " \n"]))
    return made


def run(spark, how, **kw):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id bigint, text string")
    rows = split.split_documents(docs.withColumn("label", F.lit("A")), how, **kw).collect()
    got = {}
    for r in rows:
        doc, nth = r["doc_id"].split("_")
        got.setdefault(int(doc), {})[int(nth)] = r["text"]
    return [[got.get(i, {})[n] for n in range(len(got.get(i, {})))] for i in range(len(texts()))]


@pytest.mark.parametrize("n", [1, 3, 50])
def test_word_count(spark, n):
    assert run(spark, "word_count", word_count=n) == [by_word_count(t, n) for t in texts()]


def test_blank_lines(spark):
    assert run(spark, "line_break") == [by_blank_line(t) for t in texts()]


@pytest.mark.parametrize("k,m", [(1, 0), (2, 5), (3, 1), (3, 10), (10, 500)])
def test_line_count(spark, k, m):
    assert run(spark, "line_count", line_count=k, word_count=m) == [by_line_count(t, k, m) for t in texts()]


def test_passage_ids_and_labels(spark):
    docs = spark.createDataFrame([("Tolstoy_Anna", "Tolstoy", "a b\n\nc d\n")], "doc_id string, label string, text string")
    rows = split.split_documents(docs, "line_break").orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [("Tolstoy_Anna_0", "Tolstoy", "a b"), ("Tolstoy_Anna_1", "Tolstoy", "c d")]


def test_unknown_splitter(spark):
    with pytest.raises(ValueError):
        split.split_documents(spark.createDataFrame([(1, "A", "x")], "doc_id int, label string, text string"), "other")
