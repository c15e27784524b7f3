"""Texts are moved, not their tokens: plans and results on a few documents."""

import pytest
from pyspark.sql import functions as F

from lexweave.catalog import base as B, sources, topics as topic_queries, vocabularies
from lexweave.operators import state as st, vocab
from lexweave.session import WHOLE_JOIN_KEYS, setting
from lexweave.sources import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    rows = [(1, "the cat sat the mat", "en", "a"), (2, "the dogs sat", "en", "b"), (2, "the dogs sat", "en", "b"), (3, None, "en", "a"),
            (4, "mats and mats and mats and mats and mats", None, "b")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_document_are_counted_where_it_lies(spark, folder):
    counts = vocab.term_frequencies(B.tokens_by_document(spark, folder), "token")
    assert _plan(counts).count("Exchange hashpartitioning") == 2      # the texts and the words
    assert {tuple(r) for r in counts.filter("token IN ('the', 'dogs', 'mats')").collect()} == {("the", 4, 2), ("dogs", 2, 1), ("mats", 5, 1)}
    assert ("mats", 5, 1) not in {tuple(r) for r in vocabularies.pruned_words(spark, folder).collect()}


def test_states_and_analyses_are_joined_where_their_documents_lie(spark, folder):
    with setting(spark, WHOLE_JOIN_KEYS, "true", "true"):             # as a session has it by default
        with setting(spark, WHOLE_JOIN_KEYS, "false", "true"):
            assert "hashpartitioning(doc_id" in (plan := _plan(st.assigned_tokens(*B.state_and_gold(spark, folder))))
            assert not any("Exchange" in x and "pos#" in x for x in plan.splitlines())
        cells = topic_queries.assigned_cells(spark, folder)
        assert spark.conf.get(WHOLE_JOIN_KEYS) == "true" and "SortMergeJoin" not in _plan(cells)
        assert cells.agg(F.sum("n")).first()[0] == 5 + 4 * 3 + 9       # rows of a repeated id meet each other
        assert topic_queries.topic_summary(spark, folder).agg(F.sum("tokens")).first()[0] == 5 + 2 * 3 + 9


def test_words_of_the_gold_file_are_not_multiplied(spark, folder):
    rows = sources.gold_analysis_file(spark, folder)
    assert "Expand" not in _plan(rows)
    assert {(r["doc_name"], r["doc_index"], r["tokens"], r["terms"]) for r in rows.collect()} == {
        ("a_1", 0, 5, 4), ("b_2", 1, 6, 3), ("b_4", 2, 9, 2)}


def test_treatments_are_written_without_a_sort_and_whole(spark, tmp_path, monkeypatch):
    seen = []

    def watched(session, key, value, default):
        seen.append((key, int(value)))
        return setting(session, key, value, default)

    monkeypatch.setattr(corpus, "setting", watched)
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 60).alias("treatment"))
    corpus.write_treatments(rows, str(tmp_path / "t"))
    assert seen == [(corpus.OPEN_FILES, 50)]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 200
