"""Salted lookups, dense numbering, trees: same results as the plain form, whatever the partitions."""

import pytest
from pyspark.sql import functions as F

from lexweave.operators.keyed import dense_index, lookup_join
from lexweave.operators import tree, vocab


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_lookup_equals_plain_join(spark, no_broadcast, how):
    # one key holds most rows
    left = spark.range(3000).withColumn("k", F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 13))
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(0, 13, 2)], "k bigint, v string")
    salted = lookup_join(left, lookup, ["k"], how)
    assert "__salt" in salted._jdf.queryExecution().analyzed().toString()
    plain = left.join(lookup, ["k"], how)
    assert sorted(map(str, salted.collect())) == sorted(map(str, plain.select(salted.columns).collect()))


def test_salts_share_a_hot_key(spark, no_broadcast):
    left = spark.range(1000).withColumn("k", F.lit(1))
    lookup = spark.createDataFrame([(1, "v")], "k int, v string")
    plan = lookup_join(left, lookup, ["k"], salts=8)._jdf.queryExecution().executedPlan().toString()
    assert "__salt" in plan


def test_lookup_refuses_outer_joins(spark):
    with pytest.raises(ValueError):
        lookup_join(spark.range(1), spark.range(1), ["id"], "full")


def test_dense_index_follows_the_order(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    rows = dense_index(df, [F.col("x")], "i").orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(500))
    assert [r["x"] for r in rows] == sorted(r["x"] for r in rows)
    assert dense_index(df.filter("x < 0"), [F.col("x")], "i").count() == 0


def test_first_seen_index_skips_empty_terms(spark):
    rows = [(1, 1, "b"), (1, 0, "a"), (0, 5, ""), (2, 0, "a"), (0, 9, "c")]
    tokens = spark.createDataFrame(rows, "doc_id int, pos int, term string")
    got = {r["term"]: r["term_id"] for r in vocab.first_seen_index(tokens, "term", ["doc_id", "pos"]).collect()}
    assert got == {"c": 0, "a": 1, "b": 2}


def test_zipf_ranks_share_ties(spark):
    v = spark.createDataFrame([("a", 9), ("b", 4), ("c", 4), ("d", 1)], "term string, doc_freq bigint")
    got = {r["term"]: r["rank"] for r in vocab.zipf_ranks(v).collect()}
    assert got == {"a": 1, "b": 2, "c": 2, "d": 4}


def test_genres_reach_leaves_only(spark):
    nodes = [("1", "0", "news"), ("2", "0", None), ("3", "1", None), ("4", "3", None), ("5", "4", "ignored"),
             ("6", "2", None), ("7", "99", None), ("8", "9", None), ("9", "8", None), ("10", "0", "blog"), ("11", "9", None)]
    chain = [(f"c{i}", f"c{i - 1}" if i else "1", None) for i in range(40)]
    df = spark.createDataFrame(nodes + chain, "id string, parent string, genre string")
    got = {r["id"]: r["genre"] for r in tree.inherit_genre(df, "0").collect()}
    # 2 has no genre, 6 below it neither; 7 has no parent; 8 and 9 form a cycle that 11 hangs on
    assert got == {"5": "news", "10": "blog", "c39": "news"}


def test_sentences_become_document_positions(spark):
    tokens = spark.createDataFrame(
        [(2, 0, "c"), (1, 0, "a"), (1, 1, "b"), (3, 0, "x")], "sentence_id bigint, place int, surface string")
    mapping = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 3)], "doc_id string, sentence_id bigint")
    rows = tree.sentence_documents(tokens, mapping).select("doc_id", "pos", "surface")
    assert sorted(map(tuple, rows.collect())) == [("d1", 0, "a"), ("d1", 1, "b"), ("d1", 2, "c"), ("d2", 0, "x")]
