"""Token tables laid out by their key meet without a shuffle, and give what plain tables give."""

import pytest
from pyspark.sql import functions as F

from lexweave.operators import compare, morph, state as st
from lexweave.sources.aligned import align, bucket_count, write_aligned

BUCKETS = 5


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark):
    # a document of many tokens, short ones, and tokens that one table lacks
    tokens = spark.range(600).select(
        F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 7).cast("int").alias("doc_id"), F.col("id").cast("int").alias("pos"))
    state = tokens.select("*", (F.col("pos") % 3).alias("topic"), F.concat(F.lit("t"), F.col("pos") % 11).alias("term"))
    gold = tokens.filter("pos % 13 <> 0").select(
        "*", F.lit("s").alias("surface"), F.concat(F.lit("l"), F.col("pos") % 5).alias("lemma"), F.lit("S,x").alias("slot"))
    return state, gold


def test_joins_read_bucket_beside_bucket(spark, tables):
    state, gold = tables
    aligned = write_aligned(state, buckets=BUCKETS), write_aligned(gold, buckets=BUCKETS)
    joined = st.assigned_tokens(*aligned)
    assert "Exchange" not in plan_of(joined)
    assert "Exchange" in plan_of(st.assigned_tokens(state, gold))
    assert sorted(joined.collect()) == sorted(st.assigned_tokens(state, gold).select(joined.columns).collect())
    missing = st.misaligned(*aligned)
    assert "Exchange" not in plan_of(missing)
    assert sorted(missing.collect()) == sorted(st.misaligned(state, gold).collect())
    back = st.unmap(aligned[0].withColumn("term_id", F.lit(1)), aligned[0])
    assert "Exchange" not in plan_of(back) and back.count() == 600
    cells = morph.topic_cells(joined)
    # only the counted cells are shuffled, once
    assert plan_of(cells).count("Exchange hashpartitioning") == 1


def test_runs_are_compared_without_moving_tokens(spark, tables):
    state, _ = tables
    runs = state.select("doc_id", "pos", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("run")).withColumn(
        "topic", (F.col("pos") * (F.col("run") + 2) % 5).cast("int"))
    aligned = write_aligned(runs, buckets=BUCKETS)
    names = [(0,), (1,), (2,)]
    found = compare.run_pair_contingency(aligned, ["run"], runs=names)
    plan = plan_of(found)
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc_id" not in plan
    assert sorted(found.collect()) == sorted(compare.run_pair_contingency(runs, ["run"], runs=names).collect())
    two = [aligned.filter(F.col("run") == r) for r in (0, 1)]
    pair = compare.contingency(*two)
    assert plan_of(pair).count("Exchange hashpartitioning") == 1
    plain = compare.contingency(*[runs.filter(F.col("run") == r) for r in (0, 1)])
    assert sorted(pair.collect()) == sorted(plain.collect())


def test_layout_is_kept_and_spread(spark, tables, tmp_path):
    state, gold = tables
    table = write_aligned(state, "aligned_test_state", BUCKETS, str(tmp_path / "state"))
    try:
        assert bucket_count(spark, "aligned_test_state") == BUCKETS
        copy = align(gold, "aligned_test_state")
        assert "Exchange" not in plan_of(st.assigned_tokens(table, copy))
        # the long document lies in all buckets
        assert table.filter("doc_id = 0").select(F.input_file_name()).distinct().count() == BUCKETS
        with pytest.raises(Exception, match="already exists"):
            write_aligned(state, "aligned_test_state", BUCKETS, str(tmp_path / "again"))
    finally:
        spark.sql("DROP TABLE IF EXISTS aligned_test_state")
    assert write_aligned(state.filter("false"), buckets=BUCKETS).count() == 0
    nulls = spark.createDataFrame([(None, 1, "a"), (1, None, "b"), (None, None, "c")], "doc_id int, pos int, term string")
    assert sorted(r["term"] for r in write_aligned(nulls, buckets=BUCKETS).collect()) == ["a", "b", "c"]


def test_wide_states_give_the_pairs_of_long_ones(spark, tmp_path):
    from lexweave.catalog import base, topics

    texts = [(1, "a bb ccc dd e"), (2, "ff g"), (2, "g ff hhh"), (2, "ff g"), (None, "i jj"), (3, None), (4, "")]
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts], "doc_id bigint, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet"))
    folder = str(tmp_path)
    long = compare.run_pair_contingency(base.states(spark, folder), ["treatment", "run"], ["num_topics"], sorted({(t, r) for t, _, r in base.RUNS}))
    wide = topics._pair_cells(base.run_states(spark, folder))
    assert wide.dtypes == long.dtypes and sorted(wide.collect(), key=str) == sorted(long.collect(), key=str) != []
    aligned = write_aligned(base.wide_states(base.tokens(spark, folder)), buckets=BUCKETS)
    # a row for each token, without terms and names of runs
    assert aligned.count() == 14 and aligned.columns == ["doc_id", "pos", *base.RUN_TOPICS]
    assert sorted(topics._pair_cells(base.one_per_token(aligned)).collect(), key=str) == sorted(long.collect(), key=str)


def test_aligned_tables_hold_the_columns_that_are_compared(spark, monkeypatch):
    from lexweave.catalog import topics

    row = spark.createDataFrame([(1, 0, "s", "t", 2)], "doc_id bigint, pos int, source string, term string, topic int")
    assert topics._aligned(row, "topic").columns == ["doc_id", "pos", "topic"]
    assert topics._aligned(row).columns == row.columns


def test_aligned_tables_stand_for_their_shuffle(spark, tables, monkeypatch):
    from lexweave.session import SHUFFLE_CLEANUP
    from lexweave.sources import aligned

    seen = []

    def path(session, name):
        seen.append(session.conf.get(SHUFFLE_CLEANUP))
        return scratch_path(session, name)

    scratch_path = aligned.scratch_path
    monkeypatch.setattr(aligned, "scratch_path", path)
    table = write_aligned(tables[0], buckets=BUCKETS)
    assert seen == ["true"] and spark.conf.get(SHUFFLE_CLEANUP, "false") == "false"
    assert table.count() == 600 and all(".zstd." in f for f in table.inputFiles())
