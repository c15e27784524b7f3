"""Topic metrics on hand-made assignments, and invariants of trained models."""

import math

import pytest
from pyspark.sql import functions as F

from lexweave.session import materialised
from lexweave.operators import compare, lda, morph, state as st, stats, topics
from lexweave.plans import diagnostics as plan


def make_state(spark, rows):
    """rows: (doc_id, pos, topic, term, lemma, slot, author)"""
    df = spark.createDataFrame(
        rows, "doc_id bigint, pos int, topic int, term string, lemma string, slot string, author string")
    return df.select("doc_id", "pos", "topic", "term", "author"), df.select("doc_id", "pos", "lemma", "slot")


ROWS = [
    (0, 0, 0, "b", "l1", "N,sg", "x"), (0, 1, 0, "a", "l1", "N,pl", "x"), (0, 2, 0, "c", "l2", "V=f", "x"),
    (1, 0, 0, "c", "l2", "V=f", "y"), (1, 1, 1, "z", "l9", "N,sg", "y"), (1, 2, 1, "z", "l9", "N,sg", "y"),
    (2, 0, 0, "a", "l1", "N,sg", "x"),
]


def by_topic(df):
    return {r["topic"]: r for r in df.collect()}


def test_entropies_and_single_valued_topic(spark):
    state, gold = make_state(spark, ROWS)
    got = by_topic(morph.entropy_metrics(morph.topic_cells(st.assigned_tokens(state, gold))))
    expected = -(3 / 5 * math.log2(3 / 5) + 2 / 5 * math.log2(2 / 5))
    assert got[0]["lemma_entropy"] == pytest.approx(expected)
    assert got[0]["pos_entropy"] == pytest.approx(expected)
    assert str(got[1]["lemma_entropy"]) == "0.0" and str(got[1]["slot_entropy"]) == "0.0"


def test_ties_go_to_the_smaller_term_and_ratios_divide_by_n(spark):
    state, gold = make_state(spark, ROWS)
    cells = morph.topic_cells(st.assigned_tokens(state, gold))
    tops = [(r["topic"], r["term"]) for r in morph.top_n(cells, "term", 2).orderBy("topic", "rank").collect()]
    assert tops == [(0, "a"), (0, "c"), (1, "z")]
    got = by_topic(morph.top_n_metrics(cells, 2))
    assert got[1]["lemmas_to_top_2_surface_forms"] == 0.5  # one lemma, n = 2
    assert got[0]["lemmas_in_top_2_terms"] == "l1 l2"
    got = by_topic(morph.top_n_metrics(cells, 1))
    assert got[0]["top_1_lemma_set"] == "l1" and got[0]["num_top_lemmas_excluded_by_top_terms"] == 0


def test_top_n_limits_rows_before_the_shuffle(spark):
    state, _ = make_state(spark, ROWS)
    plan_text = morph.top_n(topics.term_cells(state), "term", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan_text


def test_misaligned_positions_are_reported(spark):
    state, gold = make_state(spark, ROWS)
    short = gold.filter("doc_id != 2").unionByName(
        spark.createDataFrame([(7, 0, "l", "N")], "doc_id bigint, pos int, lemma string, slot string"))
    rows = sorted(map(tuple, st.misaligned(state, short).collect()))
    assert rows == [(2, 0, True, False), (7, 0, False, True)]


def test_unmap_and_restate(spark):
    state, gold = make_state(spark, ROWS)
    treated = state.withColumn("topic", F.col("topic") + 5).withColumn("term", F.lit("t"))
    back = st.unmap(state.withColumn("term_id", F.lit(1)), treated)
    assert {r["topic"] for r in back.collect()} == {5, 6} and "t" not in {r["term"] for r in back.collect()}
    lemmas = st.restate(state.join(gold, st.KEY), F.when(F.col("lemma") == "l9", F.lit("")).otherwise(F.col("lemma")))
    ids = {(r["term"], r["term_id"]) for r in lemmas.collect()}
    assert ids == {("l1", 0), ("l2", 1), ("z", 2)}  # the empty lemma falls back to the term
    assert lemmas.count() == len(ROWS)


def brute_coherence(rows, topic, n):
    counts = {}
    for d, _, k, t, *_ in rows:
        if k == topic:
            counts[t] = counts.get(t, 0) + 1
    top = sorted(counts, key=lambda t: (-counts[t], t))[:n]
    docs = {t: {d for d, _, _, u, *_ in rows if u == t} for t in top}
    return sum(math.log((len(docs[a] & docs[b]) + 1) / len(docs[a]))
               for i, a in enumerate(top) for b in top[i + 1:])


def test_coherence_counts_pairs_that_never_meet(spark):
    rows = ROWS + [(3, 0, 0, "q", "l", "N", "x"), (3, 1, 0, "q", "l", "N", "x")]
    state, _ = make_state(spark, rows)
    got = by_topic(topics.coherence(state, topics.term_cells(state), 4))
    assert got[0]["coherence"] == pytest.approx(brute_coherence(rows, 0, 4))
    assert got[1]["coherence"] == 0.0  # one term, no pair


def test_coherence_of_very_many_top_terms(spark):
    import random
    draw = random.Random(6)
    rows = [(d, p, 0, f"t{int(abs(draw.gauss(0, 60)))}", "l", "s", "x") for d in range(12) for p in range(90)]
    state, _ = make_state(spark, rows)
    for n in (62, 63, 130):
        got = by_topic(topics.coherence(state, topics.term_cells(state), n))
        assert got[0]["coherence"] == pytest.approx(brute_coherence(rows, 0, n))


def test_distances_and_exclusivity(spark):
    state, _ = make_state(spark, ROWS)
    cells = topics.term_cells(state)
    got = by_topic(topics.distances(cells))
    assert got[1]["uniform_dist"] == pytest.approx(math.log(4))
    assert got[1]["corpus_dist"] == pytest.approx(math.log(1 / (2 / 7)))
    assert by_topic(topics.exclusivity(cells, 2))[1]["exclusivity"] == pytest.approx(1.0)


def test_author_measures(spark):
    state, _ = make_state(spark, ROWS)
    entropy = by_topic(topics.author_entropy(state, "author"))
    assert entropy[0]["author_entropy"] == pytest.approx(-(0.8 * math.log2(0.8) + 0.2 * math.log2(0.2)))
    div = by_topic(topics.author_divergence(state, "author"))
    assert div[1]["minus_major_author"] is None and div[1]["balanced_authors"] == pytest.approx(0.0)
    assert 0 < div[0]["balanced_authors"] < math.log(2) and 0 < div[0]["minus_major_author"] <= math.log(2)


def test_diagnostics_by_run_match_each_run_alone(spark):
    state, _ = make_state(spark, ROWS)
    other = state.withColumn("topic", 1 - F.col("topic"))
    runs = state.withColumn("run", F.lit(0)).unionByName(other.withColumn("run", F.lit(1)))
    both = plan.topic_diagnostics(runs, 3, ["run"])
    for run, single in ((0, state), (1, other)):
        alone = plan.topic_diagnostics(single, 3)
        part = both.filter(F.col("run") == run).select(alone.columns)
        for a, b in zip(sorted(alone.collect()), sorted(part.collect())):
            assert list(a) == pytest.approx(list(b))


def test_variation_of_information(spark):
    state, _ = make_state(spark, ROWS)
    renamed = state.withColumn("topic", F.col("topic") + 40)
    same = compare.variation_of_information(compare.contingency(state, renamed)).first()
    assert same["variation_of_information"] == pytest.approx(0.0) and same["tokens"] == len(ROWS)
    merged = state.withColumn("topic", F.lit(0))
    voi = compare.variation_of_information(compare.contingency(state, merged)).first()
    h = -(5 / 7 * math.log2(5 / 7) + 2 / 7 * math.log2(2 / 7))
    assert voi["variation_of_information"] == pytest.approx(h)


def test_all_run_pairs_equal_single_pairs(spark):
    state, _ = make_state(spark, ROWS)
    variants = [state.withColumn("topic", ((F.col("pos") * m + F.col("topic")) % 3).cast("int")) for m in range(3)]
    runs = None
    for i, v in enumerate(variants):
        part = v.withColumns({"treatment": F.lit("t" if i < 2 else "u"), "run": F.lit(i)})
        runs = part if runs is None else runs.unionByName(part)
    voi = compare.variation_of_information(
        compare.run_pair_contingency(runs, ["treatment", "run"]), ["run_a", "run_b"])
    got = {(r["run_a"]["run"], r["run_b"]["run"]): r["variation_of_information"] for r in voi.collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)}
    for (a, b), value in got.items():
        alone = compare.variation_of_information(compare.contingency(variants[a], variants[b])).first()[0]
        assert value == pytest.approx(alone)
    mean = {(r["group_a"], r["group_b"]): r["pairs"] for r in compare.average_voi(voi, "treatment").collect()}
    assert mean == {("t", "t"): 1, ("t", "u"): 2}


def test_describe_and_histogram(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 4, 10]], "m double")
    row = stats.describe(df, "m").first()
    assert (row["count"], row["mean"], row["q25"], row["median"], row["q75"], row["max"]) == (5, 3.8, 2, 2, 4, 10)
    assert row["std"] == pytest.approx(3.6331804)
    bins = {r["bin"]: r["count"] for r in stats.histogram(df, "m", 3).collect()}
    assert bins == {0: 3, 1: 1, 2: 1}
    flat = stats.histogram(df.filter("m = 2"), "m", 3).collect()
    assert [(r["bin"], r["count"], r["probability"]) for r in flat] == [(0, 2, 1.0)]


@pytest.fixture(scope="module")
def bag(spark):
    rows = []
    for doc in range(40):
        words = ["sun", "sky", "cloud", "rain"] if doc % 2 else ["bread", "milk", "salt", "soup"]
        rows += [(doc, p, words[(p * 7 + doc) % 4]) for p in range(20)]
    return spark.createDataFrame(rows, "doc_id bigint, pos int, term string")


def check_model(tokens, model):
    shares = lda.model_document_topics(model).groupBy("doc_id").agg(F.sum("proportion").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in shares)
    weights = model.terms.select(F.posexplode("weights")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1.0) for r in weights)
    assigned = lda.assign_topics(tokens, model)
    assert assigned.count() == tokens.count()
    assert assigned.select("doc_id", "pos").distinct().count() == tokens.count()
    return assigned


@pytest.mark.parametrize("train", [lda.train_online, lda.train_joined])
def test_training_separates_two_vocabularies(spark, bag, train):
    counts = lda.bag_of_words(bag, bag.select("term").distinct())
    model = train(counts, 2, 25, 3)
    assigned = check_model(bag, model)
    found = {frozenset(r["terms"]) for r in assigned.groupBy("topic").agg(F.collect_set("term").alias("terms")).collect()}
    assert found == {frozenset(["sun", "sky", "cloud", "rain"]), frozenset(["bread", "milk", "salt", "soup"])}
    assert len(model.alpha) == 2 and all(a > 0 for a in model.alpha)


def test_joined_training_does_not_depend_on_partitions(spark, bag):
    counts = lda.bag_of_words(bag, bag.select("term").distinct())
    models = [lda.train_joined(counts.repartition(n), 2, 4, 3) for n in (1, 5)]
    first, second = [{r["term"]: list(r["weights"]) for r in m.terms.collect()} for m in models]
    assert first.keys() == second.keys()
    for term in first:
        assert first[term] == pytest.approx(second[term])


def test_online_training_refuses_a_matrix_too_large(spark, bag, monkeypatch):
    monkeypatch.setattr(lda, "MATRIX_BYTES", 8 * 2 * 3)
    counts = lda.bag_of_words(bag, bag.select("term").distinct())
    with pytest.raises(ValueError, match="train_joined"):
        lda.train_online(counts, 2, 1)


def test_joined_training_adds_numbers_without_objects_or_copies(spark, monkeypatch):
    plans = []

    def recorded(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialised(df, name)

    monkeypatch.setattr(lda, "materialised", recorded)
    counts = spark.createDataFrame([(i % 5, f"w{i % 7}", 1 + i % 3) for i in range(35)], "doc_id bigint, term string, n bigint")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lda.train_joined(counts, 3, 2)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plans and not any("ObjectHashAggregate" in p or "__salt" in p for p in plans)


@pytest.fixture(scope="module")
def texts(spark):
    words = ["sun", "sky", "Cloud", "rain", "bread", "milk", "salt", "soup", "sunny", "clouds"]
    rows = [(d, [words[(p * 7 + d * (1 + p % 3)) % 10] for p in range(5 + d % 6)]) for d in range(40)]
    rows += [(3, ["sky", "sun", "sky"]), (3, ["salt", "sky"]), (41, None), (42, []), (43, ["once"])]     # an id on several rows
    return spark.createDataFrame(rows, "doc_id bigint, words array<string>")


def _sorted(df):
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df.collect())


def test_grid_on_texts_is_that_on_tokens(spark, texts, monkeypatch):
    from lexweave.plans import experiment

    monkeypatch.setattr(lda, "BLOCK_TOKENS", 20)
    cut = lambda w: F.substring(w, 1, 3)
    tokens = texts.select("doc_id", F.posexplode("words").alias("pos", "raw")).withColumn("short", cut("raw"))
    in_order = texts.repartition(3, "doc_id").sortWithinPartitions("doc_id").select("doc_id", F.col("words").alias("raw"), F.transform("words", cut).alias("short"))
    settings = dict(runs=2, iterations=3, max_doc_share=0.9, min_count=2)
    rows = experiment.run_experiment(tokens, ["raw", "short"], [2, 3], **settings)
    moved = []
    monkeypatch.setattr(lda, "assign_topics", lambda *_: moved.append(1))      # tokens stay where they lie
    whole = experiment.run_experiment(in_order, ["raw", "short"], [2, 3], **settings)
    assert not moved and whole.texts.count() < whole.states.select("doc_id", "pos", "treatment", "num_topics").distinct().count()
    assert dict(whole.states.dtypes) == dict(rows.states.dtypes) and _sorted(whole.states) == _sorted(rows.states.select(whole.states.columns)) != []
    assert _sorted(whole.pair_voi()) == _sorted(rows.pair_voi()) and len(_sorted(whole.pair_voi())) == 2 * 6
    assert whole.pair_voi().dtypes == rows.pair_voi().dtypes
    gold = tokens.select("doc_id", "pos", F.col("raw").alias("lemma"), F.lit("N,x").alias("slot")).distinct()
    lemmas = gold.select("doc_id", "pos", F.substring("lemma", 1, 2).alias("term"))
    for name, given in (("diagnostics", []), ("diagnostics_of", [lemmas]), ("morphology", [gold])):
        a, b = getattr(whole, name)(*given), getattr(rows, name)(*given)
        assert _sorted(a) == _sorted(b.select(a.columns)) != []


def test_words_of_texts_are_counted_in_their_blocks(spark, texts, monkeypatch):
    monkeypatch.setattr(lda, "BLOCK_TOKENS", 7)
    nulls = texts.unionByName(spark.createDataFrame([(None, ["sun"]), (None, ["sun", "moon"])], texts.schema))
    blocks = lda.token_blocks(nulls.repartition(2, "doc_id").sortWithinPartitions("doc_id"))
    assert blocks.documents.select("block").distinct().count() > 10
    assert blocks.documents.count() == blocks.documents.select("doc_id").distinct().count() == 40 + 2   # with tokens, null among them
    tokens = nulls.select("doc_id", F.explode("words").alias("term"))
    counts = tokens.groupBy("term", "doc_id").count().groupBy("term").agg(F.sum("count"), F.count("*"))
    assert _sorted(blocks.vocabulary) == _sorted(counts)
    several = blocks.documents.filter("doc_id = 3").first()
    assert several["pos"] == [0, 1, 2, 3, 4, 5, 6, 7, 0, 1, 2, 0, 1] and sum(several["counts"]) == 13 == len(several["at"])


def test_joined_training_counts_words_where_documents_lie(spark, tmp_path, monkeypatch):
    """Each round joined every word of every document with two tables, and all tokens were moved to get their topics."""
    from lexweave.catalog import models

    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwx"]
    rows = [(i, " ".join(words[(i % 6) * 4 + j % 4] for j in range(8)), "en", "a") for i in range(60)] + [(None, "wb wc", "en", "a"), (7, "wa", "en", "a")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(lda, "assign_topics", None)
    monkeypatch.setattr(lda, "bag_of_words", None)
    found = models.joined_lda_token_topics(spark, str(tmp_path))
    assert found.agg(F.sum("tokens")).first()[0] == 60 * 8 + 1 and dict(found.dtypes) == {"topic": "int", "tokens": "bigint", "terms": "bigint"}
