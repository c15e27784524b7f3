"""Sampled topics: partition independence, counts, fitted priors, likelihood."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexweave.operators import sampling


def corpus(spark, partitions=3, docs=40):
    draw = random.Random(1)
    rows = [(d, p, ("ab" if d % 2 else "xy")[draw.randrange(2)] + str(draw.randrange(5))) for d in range(docs) for p in range(30)]
    return spark.createDataFrame(rows, "doc_id bigint, pos int, term string").repartition(partitions)


def rows_of(model):
    return sorted(tuple(r) for r in model.state.select("doc_id", "pos", "term", "topic").collect())


def plain(tokens, k, sweeps, seed, alpha, beta):
    def draw(sweep, doc, pos):
        return int(hashlib.md5(f"{seed}|{sweep}|{doc}|{pos}".encode()).hexdigest()[:8], 16) / 2 ** 32

    z = {(d, p): int(draw(0, d, p) * k) for d, p, _ in tokens}
    size = len({t for *_, t in tokens})
    for s in range(1, sweeps + 1):
        docs, terms, mass = Counter(), Counter(), Counter()
        for d, p, t in tokens:
            docs[d, z[d, p]] += 1
            terms[t, z[d, p]] += 1
            mass[z[d, p]] += 1
        new = {}
        for d, p, t in tokens:
            own = [float(j == z[d, p]) for j in range(k)]
            w = [(docs[d, j] - own[j] + alpha) * (terms[t, j] - own[j] + beta) / (mass[j] - own[j] + size * beta) for j in range(k)]
            aim, upto, at = draw(s, d, p) * sum(w), 0.0, 0
            for x in w:
                upto += x
                at += upto <= aim
            new[d, p] = min(at, k - 1)
        z = new
    return z


def test_same_state_for_any_partitioning_and_as_in_plain_python(spark):
    tokens = corpus(spark, 1, 12)
    one = rows_of(sampling.sample_topics(tokens, 3, 3, seed=4, optimise_every=0))
    many = rows_of(sampling.sample_topics(tokens.repartition(7, "term"), 3, 3, seed=4, optimise_every=0))
    expected = plain([tuple(r) for r in tokens.collect()], 3, 3, 4, 5 / 3, 0.01)
    assert one == many
    assert {(d, p): z for d, p, _, z in one} == expected
    assert one != rows_of(sampling.sample_topics(tokens, 3, 3, seed=5, optimise_every=0))


def test_sweeps_separate_vocabularies_and_raise_the_likelihood(spark):
    tokens = corpus(spark)
    held = tokens.filter("pos % 5 = 0").select("doc_id", "term")
    seen = tokens.filter("pos % 5 <> 0")

    def likelihood(sweeps):
        model = sampling.sample_topics(seen, 2, sweeps, seed=2, burn_in=3, optimise_every=2)
        row = sampling.token_likelihood(model, held).first()
        assert row["tokens"] == held.count()
        return row["log_likelihood"] / row["tokens"], model

    start, _ = likelihood(0)
    end, model = likelihood(8)
    assert end > start
    assert model.alpha != [2.5, 2.5] and all(a > 0 for a in model.alpha)
    assert model.state.count() == seen.count()


def test_alpha_equals_plain_fixed_point(spark):
    state = spark.createDataFrame([(d, p, "t", (p * d) % 3 if d % 4 else 0) for d in range(20) for p in range(5 + d)],
                                  "doc_id bigint, pos int, term string, topic int")
    counts, lengths = Counter(), Counter()
    for r in state.collect():
        counts[r["doc_id"], r["topic"]] += 1
        lengths[r["doc_id"]] += 1

    def digamma(x):
        shift = 0.0
        while x < 20:
            shift -= 1 / x
            x += 1
        return shift + math.log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4)

    alpha = [0.7, 1.1, 0.4]
    for _ in range(6):
        whole = sum(alpha)
        below = sum(digamma(n + whole) - digamma(whole) for n in lengths.values())
        alpha = [a * sum(digamma(counts[d, j] + a) - digamma(a) for d in lengths) / below for j, a in enumerate(alpha)]
    assert sampling.fitted_alpha(state, [0.7, 1.1, 0.4], 6) == pytest.approx(alpha, rel=1e-6)
    assert sampling.fitted_alpha(state.filter("false"), [1.0, 2.0]) == [1.0, 2.0]


def test_draws_are_spread_evenly(spark):
    rows = spark.range(2000).select(sampling.draw(1, 2, F.col("id"), F.lit(3)).alias("u")).collect()
    values = [r["u"] for r in rows]
    assert 0 <= min(values) and max(values) < 1 and abs(sum(values) / 2000 - 0.5) < 0.03


def test_topics_are_counted_in_one_compiled_step(spark):
    state = spark.createDataFrame([(1, 0), (1, 2), (1, 2), (2, 1)], "doc_id bigint, topic int")
    counts = sampling._topic_counts(state, "doc_id", 3, "n")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.count("Exchange") == 1
    assert sorted((r["doc_id"], r["n"]) for r in counts.collect()) == [(1, [1.0, 0.0, 2.0]), (2, [0.0, 1.0, 0.0])]


def test_texts_in_blocks_are_sampled_like_tokens(spark, monkeypatch):
    from lexweave.operators import lda

    monkeypatch.setattr(lda, "BLOCK_TOKENS", 11)
    draw = random.Random(3)
    rows = [(d, [f"w{draw.randrange(9)}" for _ in range(4 + d % 5)]) for d in range(25)] + [(4, ["w1", "w2", "rare"]), (30, None), (31, ["rare"])]
    texts = spark.createDataFrame(rows, "doc_id bigint, words array<string>").repartition(2, "doc_id").sortWithinPartitions("doc_id")
    kept = spark.createDataFrame([(f"w{i}",) for i in range(9)], "term string")
    tokens = texts.select("doc_id", F.posexplode("words").alias("pos", "term")).join(kept, "term", "left_semi")
    settings = dict(num_topics=3, sweeps=4, seed=4, burn_in=1, optimise_every=2)
    plain = sampling.sample_topics(tokens, **settings)
    monkeypatch.setattr(sampling, "lookup_join", None)      # no token is joined with counts
    blocks = sampling.sample_topics(lda.token_blocks(texts).restricted(kept), **settings)
    assert rows_of(blocks) == rows_of(plain) and blocks.num_terms == plain.num_terms == 9
    assert blocks.alpha == pytest.approx(plain.alpha) and dict(blocks.state.dtypes) == dict(plain.state.select(blocks.state.columns).dtypes)
    monkeypatch.undo()
    held = tokens.filter("pos % 3 = 0").select("doc_id", "term")
    assert sampling.completion_likelihood(blocks, 3).first()["tokens"] == held.count()
    assert sampling.completion_likelihood(blocks, 3).first()[1] == pytest.approx(sampling.token_likelihood(plain, held).first()[1])
