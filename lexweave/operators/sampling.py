"""Topic of every token by Gibbs sampling, and fitted document priors.

A sweep draws all topics anew from the counts of the sweep before, each token's own left out.  The draw of a token is
a hash of seed, sweep, document and position, so the same seed gives the same state however the rows are partitioned,
and a lost executor's tokens are drawn again alike.  Counts are aggregated and joined each sweep; a number per topic
reaches the driver.  Texts in blocks (``lda.TokenBlocks``) keep their tokens as numbers, a row for each document; only
counts of a block's words move.

Alpha, one number per topic, is fitted by fixed-point steps from histograms of how many tokens of a topic documents
have: alpha * (sum of digamma(n + alpha) - digamma(alpha)) / (sum of digamma(length + total) - digamma(total)).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lexweave.operators import gibbs, lda
from lexweave.operators.keyed import lookup_join
from lexweave.session import discarded, materialised

BURN_IN, OPTIMISE_EVERY = 50, 20     # sweeps before alpha is first fitted, and between fits
ALPHA_STEPS = 20                     # fixed-point steps of a fit
_DRAWS = 1 << 32


@dataclass
class SampledTopics:
    """``state(doc_id, pos, term, topic)``, the priors and the number of terms."""

    state: DataFrame
    alpha: list[float]
    beta: float
    num_topics: int
    num_terms: int
    blocks: SampledBlocks | None = None


@dataclass
class SampledBlocks:
    """``documents(block, doc_id, words, steps, topics)`` of a written ``table``, the words' names and ``counts(term, weights)``: the tokens of each topic."""

    documents: DataFrame
    places: DataFrame
    counts: DataFrame
    table: DataFrame

    def totals(self, k: int) -> list[int]:
        row = self.counts.agg(*[F.sum(F.get("weights", F.lit(j))) for j in range(k)]).first()      # one number per topic
        return [int(x or 0) for x in row]


def draw(seed: int, sweep: int, doc: Column, pos: Column) -> Column:
    """A number from 0 to below 1, fixed by its arguments."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(str(sweep)), doc.cast("string"), pos.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(_DRAWS))


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _topic_counts(state: DataFrame, key: str, num_topics: int, out: str) -> DataFrame:
    """For each key the tokens of every topic, as an array."""
    counts = state.groupBy(key).agg(*[F.count_if(F.col("topic") == j).alias(f"__n{j}") for j in range(num_topics)])
    return counts.select(key, F.array(*[F.col(f"__n{j}").cast("double") for j in range(num_topics)]).alias(out))


def _sweep(state: DataFrame, model: SampledTopics, seed: int, sweep: int) -> DataFrame:
    k, beta = model.num_topics, model.beta
    totals = [0] * k
    for r in state.groupBy("topic").agg(F.count("*").alias("n")).collect():     # one row per topic
        totals[r["topic"]] = r["n"]
    documents = _topic_counts(state, "doc_id", k, "__doc")
    terms = _topic_counts(state, "term", k, "__term")
    rows = lookup_join(state.join(documents.hint("merge"), "doc_id"), terms, ["term"], "inner", ["doc_id", "pos"])
    whole = F.lit(float(model.num_terms * beta))

    def weight(j: int) -> Column:
        own = F.when(F.col("topic") == j, F.lit(1.0)).otherwise(F.lit(0.0))
        return ((F.get("__doc", F.lit(j)) - own + F.lit(float(model.alpha[j]))) * (F.get("__term", F.lit(j)) - own + F.lit(beta))
                / (F.lit(float(totals[j])) - own + whole))

    weighed = rows.select("doc_id", "pos", "term", F.array(*map(weight, range(k))).alias("__w"))
    zero = F.lit(0.0)
    drawn = weighed.withColumn("__aim", draw(seed, sweep, F.col("doc_id"), F.col("pos")) * F.aggregate("__w", zero, lambda a, w: a + w))
    start = F.struct(zero.alias("sum"), F.lit(0).alias("at"))
    at = F.aggregate("__w", start, lambda s, w: F.struct(
        (s["sum"] + w).alias("sum"), (s["at"] + F.when(s["sum"] + w <= F.col("__aim"), 1).otherwise(0)).alias("at")), lambda s: s["at"])
    return drawn.select("doc_id", "pos", "term", F.least(at, F.lit(k - 1)).alias("topic"))


def fitted_alpha(state: DataFrame, alpha: list[float], steps: int = ALPHA_STEPS) -> list[float]:
    """Alpha after fixed-point steps from the state's histograms: as many rows as there are different counts."""
    cells = materialised(state.groupBy("doc_id", "topic").agg(F.count("*").alias("n")), "document-topics")
    by_topic = materialised(cells.groupBy("topic", "n").agg(F.count("*").alias("docs")), "histogram").collect()
    lengths = cells.groupBy("doc_id").agg(F.sum("n").alias("n")).groupBy("n").agg(F.count("*").alias("docs")).collect()

    def rising(counts: np.ndarray, docs: np.ndarray, a: float) -> float:
        """Sum over documents of digamma(n + a) - digamma(a), that is of 1 / (a + i) for i below n."""
        parts = np.cumsum(1.0 / (a + np.arange(counts.max(initial=0))))
        return float((docs * parts[counts - 1]).sum())

    now = list(map(float, alpha))
    size = np.array([(r["n"], r["docs"]) for r in lengths], dtype=np.int64).reshape(-1, 2)
    held = [np.array([(r["n"], r["docs"]) for r in by_topic if r["topic"] == j], dtype=np.int64).reshape(-1, 2) for j in range(len(now))]
    for _ in range(steps if len(size) else 0):
        whole = rising(size[:, 0], size[:, 1], sum(now))
        # a topic without tokens would go to 0, which no count could leave again
        now = [max(a * rising(h[:, 0], h[:, 1], a) / whole, 1e-6) for a, h in zip(now, held)]
    return now


def _sample_blocks(tokens: lda.TokenBlocks, num_topics: int, sweeps: int, seed: int, alpha_sum: float, beta: float,
                   burn_in: int, optimise_every: int) -> SampledTopics:
    k, kind = num_topics, dict(tokens.documents.dtypes)["doc_id"]
    shape = f"block bigint, doc_id {kind}, words array<int>, steps array<int>, topics array<smallint>, weights array<double>, term string"

    def written(rows: DataFrame) -> SampledBlocks:
        table = materialised(rows, "state")
        counts = table.filter("term IS NOT NULL").groupBy("term").agg(*[F.sum(F.get("weights", F.lit(j))).alias(f"__n{j}") for j in range(k)])
        return SampledBlocks(table.filter("term IS NULL").select("block", "doc_id", "words", "steps", "topics"), tokens.places, materialised(
            counts.select("term", F.array(*[F.col(f"__n{j}") for j in range(k)]).alias("weights")), "counts"), table)

    def listed(blocks: SampledBlocks) -> DataFrame:
        return lda.beside_words(blocks.places, blocks.documents, blocks.counts, gibbs.lister(), f"doc_id {kind}, pos int, term string, topic int")

    none = F.lit(None).cast("array<double>")
    blocks = written(lda.beside_words(tokens.places, tokens.documents.select("block", "doc_id", "ids", "counts", "at", "pos"), tokens.vocabulary.select(
        "term", none.alias("weights")), gibbs.starter(seed, k), shape))
    model = SampledTopics(listed(blocks), [alpha_sum / k] * k, beta, k, blocks.counts.count(), blocks)
    for sweep in range(1, sweeps + 1):
        run = gibbs.sweeper(seed, sweep, model.alpha, beta, model.blocks.totals(k), model.num_terms * beta)
        former = model.blocks
        model.blocks = written(lda.beside_words(tokens.places, former.documents.filter("doc_id IS NOT NULL"), former.counts, run, shape))
        discarded(former.table)
        model.state = listed(model.blocks)
        if optimise_every and sweep > burn_in and sweep % optimise_every == 0:
            model.alpha = fitted_alpha(model.state, model.alpha)
    return model


def sample_topics(tokens: DataFrame | lda.TokenBlocks, num_topics: int, sweeps: int = 1000, seed: int = 0, alpha_sum: float = 5.0,
                  beta: float = 0.01, burn_in: int = BURN_IN, optimise_every: int = OPTIMISE_EVERY) -> SampledTopics:
    """Sampled topics of ``(doc_id, pos, term)``, or of texts in blocks, after a number of sweeps; alpha is fitted every
    ``optimise_every`` sweeps behind ``burn_in``, and not at all with 0."""
    if isinstance(tokens, lda.TokenBlocks):
        return _sample_blocks(tokens, num_topics, sweeps, seed, alpha_sum, beta, burn_in, optimise_every)
    first = F.floor(draw(seed, 0, F.col("doc_id"), F.col("pos")) * num_topics).cast("int")
    state = materialised(tokens.select("doc_id", "pos", "term", first.alias("topic")), "state")
    terms = state.select("term").distinct().count()
    model = SampledTopics(state, [alpha_sum / num_topics] * num_topics, beta, num_topics, terms)
    for sweep in range(1, sweeps + 1):
        model.state = materialised(_sweep(model.state, model, seed, sweep), "state")
        if optimise_every and sweep > burn_in and sweep % optimise_every == 0:
            model.alpha = fitted_alpha(model.state, model.alpha)
    return model


def token_likelihood(model: SampledTopics, held_out: DataFrame) -> DataFrame:
    """``tokens, log_likelihood`` of held-out ``(doc_id, term)`` tokens by document completion.

    A held-out token's probability comes from its document's topic shares in the state and the topics' terms; tokens
    whose document or term the state does not know are left out.
    """
    k, state = model.num_topics, model.state
    totals = [0] * k
    for r in state.groupBy("topic").agg(F.count("*").alias("n")).collect():
        totals[r["topic"]] = r["n"]
    counts = held_out.groupBy("doc_id", "term").agg(F.count("*").alias("__n"))
    rows = lookup_join(counts.join(_topic_counts(state, "doc_id", k, "__doc").hint("merge"), "doc_id"),
                       _topic_counts(state, "term", k, "__term"), ["term"], "inner", ["doc_id"])
    alpha, mass, whole = _numbers(model.alpha), _numbers(totals), model.num_terms * model.beta
    length = F.aggregate("__doc", F.lit(0.0), lambda a, x: a + x) + F.lit(sum(model.alpha))
    shares = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (
        (F.get("__doc", j) + F.get(alpha, j)) / length * (F.get("__term", j) + F.lit(model.beta)) / (F.get(mass, j) + F.lit(whole))))
    probability = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
    return rows.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("tokens"), F.sum(F.col("__n") * F.ln(probability)).alias("log_likelihood"))


def completion_likelihood(model: SampledTopics, every: int) -> DataFrame:
    """``token_likelihood`` of the sampled blocks' own tokens whose position ``every`` divides, which stay in their blocks."""
    run = gibbs.judge(model.alpha, model.beta, model.blocks.totals(model.num_topics), model.num_terms * model.beta, every)
    documents = model.blocks.documents.filter("doc_id IS NOT NULL")
    rows = lda.beside_words(model.blocks.places, documents, model.blocks.counts, run, "tokens bigint, log_likelihood double")
    return rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.sum("log_likelihood").alias("log_likelihood"))
