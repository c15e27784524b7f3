"""Topic models in blocks of documents: training, topics of words, and the queries on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.catalog import models
from lexweave.operators import lda, variational


@pytest.fixture(scope="module")
def bag(spark):
    rows = []
    for doc in range(40):
        words = ["sun", "sky", "cloud", "rain"] if doc % 2 else ["bread", "milk", "salt", "soup"]
        rows += [(doc, p, words[(p * 7 + doc) % 4]) for p in range(20)]
    return spark.createDataFrame(rows, "doc_id bigint, pos int, term string")


def _counts(tokens):
    return lda.bag_of_words(tokens, tokens.select("term").distinct())


def test_blocks_separate_two_vocabularies(spark, bag):
    model = lda.train_variational(_counts(bag), 2, 25, 3)
    assert model.documents.count() == 40 and len(model.alpha) == 2 and min(model.alpha) > 0
    assert all(sum(r["weights"]) == pytest.approx(1.0) for r in model.documents.collect())
    sums = np.sum([r["weights"] for r in model.terms.collect()], axis=0)
    assert sums == pytest.approx([1.0, 1.0])
    found = {frozenset(r["terms"]) for r in model.words.groupBy("topic").agg(F.collect_set("term").alias("terms")).collect()}
    assert found == {frozenset(["sun", "sky", "cloud", "rain"]), frozenset(["bread", "milk", "salt", "soup"])}


def test_neither_partitions_nor_blocks_change_the_model(spark, bag, monkeypatch):
    counts = _counts(bag)
    first = lda.train_variational(counts.repartition(1), 3, 3, 5)
    monkeypatch.setattr(lda, "BLOCK_WORDS", 9)
    second = lda.train_variational(counts.repartition(5), 3, 3, 5)
    for table, key in (("terms", "term"), ("documents", "doc_id")):
        a, b = [{r[key]: list(r["weights"]) for r in getattr(m, table).collect()} for m in (first, second)]
        assert a.keys() == b.keys()
        assert all(a[x] == pytest.approx(b[x], abs=1e-6) for x in a)
    assert first.alpha == pytest.approx(second.alpha)


def test_words_have_the_topics_of_their_tokens(spark, bag, monkeypatch):
    monkeypatch.setattr(lda, "BLOCK_WORDS", 9)
    odd = bag.unionByName(spark.createDataFrame([(None, 0, "sun"), (50, 0, "rare")], bag.schema))
    vocabulary = bag.filter("term != 'soup'").select("term").distinct()
    model = lda.train_variational(_counts(odd), 2, 3, 3, vocabulary)
    assert {r["term"] for r in model.terms.collect()} == {"sun", "sky", "cloud", "rain", "bread", "milk", "salt"}
    assert {r["doc_id"] for r in model.documents.collect()} == {None, *range(40)}
    by_token = lda.assign_topics(odd, model).groupBy("doc_id", "term", "topic").agg(F.count("*").alias("n"))
    names = ["doc_id", "term", "topic", "n"]
    assert sorted(map(tuple, model.words.select(names).collect())) == sorted(map(tuple, by_token.select(names).collect()))
    assert model.words.agg(F.sum("n")).first()[0] == 40 * 20 - 20 * 5


def test_extrapolated_steps_end_where_plain_steps_do(monkeypatch):
    random = np.random.default_rng(2)
    beta, alpha = np.exp(random.normal(size=(4, 90))), np.full(4, 0.25)
    ids, n, offsets = random.integers(0, 90, 600), np.ones(600), np.array([0, 50, 51, 300, 600])
    monkeypatch.setattr(variational, "SETTLED", 1e-9)
    fast = variational.inferred(ids, n, offsets, beta, alpha)
    monkeypatch.setattr(variational, "EXTRAPOLATED", 0)
    assert fast == pytest.approx(variational.inferred(ids, n, offsets, beta, alpha), abs=1e-5)
    assert variational.digamma(np.array([1.0, 0.1])) == pytest.approx([-0.5772156649, -10.4237549404])
    assert variational.trigamma(np.array([1.0, 0.1])) == pytest.approx([np.pi ** 2 / 6, 101.4332991508])


def test_queries_hold_no_model_on_the_driver(spark, tmp_path, monkeypatch):
    """The model of MLlib refused a vocabulary above a limit, and drew documents anew for every partitioning."""
    monkeypatch.setattr(lda, "MATRIX_BYTES", 8)
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwx"]
    rows = [(i, " ".join(words[(i % 6) * 4 + j % 4] for j in range(8)), "en", "a") for i in range(60)]
    rows += [(None, "wb wc", "en", "a"), (7, rows[7][1], "en", "a"), (90, None, "en", "a"), (91, "once", "en", "a")]
    found = []
    for parts in (1, 3):
        folder = str(tmp_path / str(parts))
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(parts).write.parquet(f"{folder}/documents.parquet")
        found.append(sorted(map(tuple, models.lda_token_topics(spark, folder).collect())))
        assert models.lda_topic_terms(spark, folder).filter("rank = 1").count() == models.TOPICS
        assert models.lda_document_topics(spark, folder).count() == 61 * models.TOPICS
        assert models.lda_priors(spark, folder).agg(F.sum("mean_share")).first()[0] == pytest.approx(1.0)
        assert models.lda_top_documents(spark, folder).count() == 20 * models.TOPICS
    assert found[0] == found[1] and sum(r[2] for r in found[0]) == 61 * 8


def test_queries_train_on_texts_in_blocks(spark, tmp_path, monkeypatch):
    """Words were grouped as rows and moved to blocks behind that."""
    monkeypatch.setattr(lda, "_blocks", None)
    rows = [(i, " ".join(f"w{chr(97 + (i % 4) * 3 + j % 3)}" for j in range(6)), "en", "a") for i in range(24)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert models.lda_document_topics(spark, str(tmp_path)).agg(F.sum("proportion")).first()[0] == pytest.approx(24.0)
