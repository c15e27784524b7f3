"""Registered queries: inventory covered, and equal to their SQL on the smallest tables."""

import math
from glob import glob
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lexweave.catalog.base import REGISTRY

FOLDER = "/root/testdata/sf0.001"
INVENTORY = ([f"S{i}" for i in range(1, 15)] + [f"P{i}" for i in range(1, 30)] + [f"D{i}" for i in range(1, 5)]
             + [f"J{i}" for i in range(1, 16)] + [f"A{i}" for i in range(1, 26)] + [f"W{i}" for i in range(1, 9)]
             + [f"T{i}" for i in range(1, 6)] + [f"M{i}" for i in range(1, 18)])

# one or two of each family; tools/check.py runs them all
SAMPLED = ["tokenise_keep_punct", "remove_stop_words", "keep_listed_words", "usable_tokens", "lexicon_lemmas",
           "split_at_blank_lines", "split_by_line_count", "prepare_treated_documents", "treatment_statistics",
           "stopped_pairs", "rescued_by_conflation", "vocabulary_overlap", "zipf_ranks", "stemmed_vocabulary_index",
           "vocabulary_rollup", "document_length_description", "topic_morphology", "topic_diagnostics",
           "restated_counts", "author_divergence", "voi_within_and_between_treatments", "inherited_genres",
           "annotated_document_tree", "gold_analysis_file", "run_folders", "bag_of_words"]


def test_every_inventory_line_has_a_query():
    covered = {part for q in REGISTRY.values() for part in q.covers.split(",")}
    assert [i for i in INVENTORY if i not in covered] == []


def _normal(value):
    return f"{value:.9g}" if isinstance(value, float) and not math.isnan(value) else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_normal(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", SAMPLED)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    result = con.execute(entry.oracle_sql()[name])
    expected = _rows([d[0] for d in result.description], result.fetchall())
    assert _rows(df.columns, df.collect()) == expected


def test_flagship_has_rows(spark):
    assert {r["treatment"] for r in entry.entry(spark).collect()} == {"raw", "truncate5", "truncate6"}
