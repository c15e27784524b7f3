"""Topic models: bags of words, LDA training, and one topic per token.

``train_joined``, which the experiment grid uses unless told otherwise, keeps term weights in a table, for a vocabulary
of any size; documents lie in blocks of bounded size that fetch the weights of their own words, and every step takes
every document once.  ``train_variational`` is online variational Bayes in the same blocks, another model with other
results.  ``train_online`` is MLlib's form of it, for
those who ask for it by name: it draws the documents of a step with replacement, keeps a vocabulary-by-topics matrix on
the driver and refuses one above ``MATRIX_BYTES``.  Nothing chooses between them by size.

All give posterior weights, not sampled assignments: a token's topic is the one of largest
weight for its word in its document, the same on every run over the same model.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexweave.operators import variational
from lexweave.operators.keyed import lookup_join
from lexweave.session import discarded, materialised, setting

MATRIX_BYTES = 256 * 1024 * 1024
BLOCK_WORDS = 500_000       # words of documents in a block, counted once in each document
BLOCK_TOKENS = 3_000_000    # tokens of documents in a block of texts


@dataclass
class TopicModel:
    """``terms(term, weights)`` holds p(term | topic), ``documents(doc_id, weights)`` topic shares.

    ``words(doc_id, term, n, topic)``, if the trainer has it, is the topic of each word of a document, as ``assign_topics``
    gives it to the word's tokens.
    """

    terms: DataFrame
    documents: DataFrame
    alpha: list[float]
    num_topics: int
    words: DataFrame | None = None


@dataclass
class JoinedRuns:
    """Runs of ``train_joined`` that differ in their seeds: the weights of a term or document in all runs stand one after the other."""

    terms: DataFrame
    documents: DataFrame    # block, doc_id, weights
    alpha: list[float]
    num_topics: int
    runs: int
    words: DataFrame


@dataclass
class TokenBlocks:
    """Token tables whose documents lie whole in blocks of about ``BLOCK_TOKENS`` tokens.

    ``documents(block, doc_id, ids, counts, at, pos)`` has a row for each document with its distinct words as numbers
    within its block, their counts, and the place among them of each token; positions count from 0 where ``pos`` is null.
    ``places(of_block, word, term)`` are the words the numbers stand for, ``vocabulary(term, term_freq, doc_freq)`` the counts of all.
    """

    documents: DataFrame
    places: DataFrame
    vocabulary: DataFrame

    def restricted(self, vocabulary: DataFrame) -> TokenBlocks:
        """The same documents with the words of a table; other words are passed over."""
        return TokenBlocks(self.documents, materialised(self.places.join(vocabulary.select("term"), "term", "left_semi"), "places"), vocabulary)


def token_blocks(texts: DataFrame) -> TokenBlocks:
    """Blocks of ``(doc_id, words)``, each row a text with its words in order; rows of one id are one document.

    Texts are moved once, so that those of an id are together; their words become numbers where they then lie.
    """
    kind, session = dict(texts.dtypes)["doc_id"], texts.sparkSession
    with setting(session, "spark.sql.execution.arrow.maxRecordsPerBatch", "1024", "10000"):     # whole texts
        table = materialised(texts.select("doc_id", "words").mapInArrow(
            variational.text_packer(BLOCK_TOKENS), f"block bigint, doc_id {kind}, ids array<int>, counts array<bigint>, at array<int>, pos array<int>, "
            "terms array<string>, term_freq array<bigint>, doc_freq array<bigint>"), "token-blocks")
    words = table.filter("terms IS NOT NULL")
    counts = words.select(F.inline(F.arrays_zip("terms", "term_freq", "doc_freq"))).groupBy(F.col("terms").alias("term")).agg(
        F.sum("term_freq").alias("term_freq"), F.sum("doc_freq").alias("doc_freq"))
    return TokenBlocks(table.filter("terms IS NULL").select("block", "doc_id", "ids", "counts", "at", "pos"),
                       words.select(F.col("block").alias("of_block"), F.posexplode("terms").alias("word", "term")), counts)


def bag_of_words(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``doc_id, term, n`` for the terms of the vocabulary."""
    counts = tokens.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return lookup_join(counts, vocabulary.select("term"), ["term"], "left_semi", ["doc_id"])


def count_vectors(bag: DataFrame, vocabulary: list[str]) -> DataFrame:
    """One count vector per document; a group is one document's words."""
    words = bag.groupBy("doc_id").agg(
        F.flatten(F.collect_list(F.transform(F.sequence(F.lit(1).cast("bigint"), "n"), lambda _: F.col("term"))))
        .alias("words"))
    model = CountVectorizerModel.from_vocabulary(vocabulary, "words", "features")
    return model.transform(words).select("doc_id", "features")


def train_online(bag: DataFrame, num_topics: int, iterations: int = 20, seed: int = 0) -> TopicModel:
    """MLlib's online LDA, every step over all documents, with document weights (alpha) fitted per topic."""
    bag = materialised(bag, "bag")
    limit = MATRIX_BYTES // (8 * num_topics)
    head = bag.select("term").distinct().limit(limit + 1).collect()
    if len(head) > limit:
        raise ValueError(f"more than {limit} terms: the driver's matrix would be too large, use train_joined")
    vocabulary = sorted(r["term"] for r in head)
    spark = bag.sparkSession
    vectors = materialised(count_vectors(bag, vocabulary), "vectors")
    model = LDA(k=num_topics, maxIter=iterations, seed=seed, optimizer="online",
                optimizeDocConcentration=True, subsamplingRate=1.0).fit(vectors)
    matrix = model.topicsMatrix().toArray()
    matrix = matrix / matrix.sum(axis=0, keepdims=True)
    terms = spark.createDataFrame(
        [(t, w.tolist()) for t, w in zip(vocabulary, matrix)], "term string, weights array<double>")
    documents = model.transform(vectors).select(
        "doc_id", vector_to_array("topicDistribution").alias("weights"))
    alpha = np.asarray(model.estimatedDocConcentration().toArray()).tolist()
    return TopicModel(materialised(terms, "terms"), materialised(documents, "documents"), alpha, num_topics)


def _products(a: str, b: str, k: int) -> list[Column]:
    """Products of the weights of two columns, topic by topic: plain arithmetic, which Spark compiles."""
    return [F.get(a, F.lit(j)) * F.get(b, F.lit(j)) for j in range(k)]


def beside_words(places: DataFrame, table: DataFrame, weights: DataFrame, run, schema: str) -> DataFrame:
    """Documents of a block beside the weights of the block's words."""
    words = places.join(weights, "term").select("of_block", "word", "term", "weights")
    return table.groupBy("block").cogroup(words.groupBy("of_block")).applyInArrow(run, schema)


def _documents_and_places(bag: DataFrame | TokenBlocks) -> tuple[DataFrame, DataFrame]:
    if isinstance(bag, TokenBlocks):
        return bag.documents.select("block", "doc_id", "ids", "counts"), bag.places
    blocks = _blocks(bag)
    return (blocks.filter("terms IS NULL").select("block", "doc_id", "ids", "counts"),
            blocks.filter("terms IS NOT NULL").select(F.col("block").alias("of_block"), F.posexplode("terms").alias("word", "term")))


def train_joined(bag: DataFrame | TokenBlocks, num_topics: int, iterations: int = 20, seed: int = 0,
                 eta: float = 0.01, alpha_sum: float = 5.0) -> TopicModel:
    """Expectation-maximisation with term weights in a table, for vocabularies of any size.

    Only ``num_topics`` sums reach the driver.  A block of documents meets the weights of the words it has; what it gives
    are counts of these words, and its documents with their new weights.  Starting weights are hashes of term and topic, so
    they do not depend on partitions; alpha follows each topic's share of the corpus.  Each round is written out to end its lineage.
    """
    model = train_joined_runs(bag, num_topics, iterations, [seed], eta, alpha_sum)
    return TopicModel(model.terms, model.documents.select("doc_id", "weights"), model.alpha, num_topics, model.words)


def train_joined_runs(bag: DataFrame | TokenBlocks, num_topics: int, iterations: int, seeds: list[int],
                      eta: float = 0.01, alpha_sum: float = 5.0) -> JoinedRuns:
    """``train_joined`` for several seeds, whose runs pass over the documents together."""
    if not isinstance(bag, TokenBlocks):
        bag = materialised(bag, "bag")
    k, runs = num_topics, len(seeds)
    topics = range(k * runs)
    docs, places = _documents_and_places(bag)
    kinds = dict(docs.dtypes)
    docs = docs.filter("doc_id IS NOT NULL").withColumn("weights", F.array(*[F.lit(1.0 / k)] * len(topics)))
    starts = [F.lit(1.0) + F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("term"), F.lit(str(j))).cast("binary")), 1, 8),
                                  16, 10).cast("bigint") % 1000 / 1000.0 for seed in seeds for j in range(k)]
    terms = materialised(places.select("term").distinct().select("term", F.array(*starts).alias("weights")), "terms")
    alpha = np.full(len(topics), alpha_sum / k)

    def column_sums(table: DataFrame) -> np.ndarray:
        row = table.agg(*[F.sum(F.get("weights", F.lit(j))) for j in topics]).first()
        return np.array([x or 0.0 for x in row])

    mass = column_sums(terms)
    shape = ", ".join(f"{c} {kinds[c]}" for c in ("block", "doc_id", "ids", "counts")) + ", weights array<double>, term string"
    former = None
    for _ in range(iterations):
        step = materialised(beside_words(places, docs, terms, variational.maximiser(mass, alpha, runs), shape), "step")
        counted = step.filter("term IS NOT NULL").groupBy("term").agg(*[F.sum(F.get("weights", F.lit(j))).alias(f"__t{j}") for j in topics])
        terms = materialised(counted.select("term", F.array(*[F.col(f"__t{j}") + eta for j in topics]).alias("weights")), "terms")
        docs = step.filter("term IS NULL").drop("term")
        if former is not None:
            discarded(former)
        former = step
        mass = column_sums(terms)
        alpha = (alpha_sum * mass.reshape(runs, k) / mass.reshape(runs, k).sum(axis=1, keepdims=True)).ravel()

    sums = F.array(*[F.lit(float(x)) for x in mass])
    scaled = materialised(terms.select("term", F.zip_with("weights", sums, lambda w, s: w / s).alias("weights")), "terms")
    words = beside_words(places, docs, scaled, variational.chooser(k), f"doc_id {kinds['doc_id']}, term string, n bigint, topic int")
    return JoinedRuns(scaled, docs.select("block", "doc_id", "weights"), alpha.tolist(), k, runs, words)


def _blocks(bag: DataFrame) -> DataFrame:
    """``block, doc_id, ids, counts, terms``: a row for each document with its words as numbers within its block, and for
    each block a row with the words these numbers stand for."""
    bag = bag.filter("term IS NOT NULL")
    blocks = max(1, math.ceil(bag.count() / BLOCK_WORDS))
    kind = dict(bag.dtypes)["doc_id"]
    rows = bag.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "term", F.col("n").cast("bigint"))
    return materialised(rows.groupBy("block").applyInArrow(
        variational.packer(), f"block int, doc_id {kind}, ids array<int>, counts array<bigint>, terms array<string>"), "blocks")


def _gamma_draw(seed: int, topic: Column, shape: float = 100.0) -> Column:
    """A draw with mean 1 from a gamma distribution, hashed from term and topic (Wilson and Hilferty's cube of a normal draw)."""
    def uniform(which: int) -> Column:
        bits = F.xxhash64(F.lit(seed), F.lit(which), F.col("term"), topic)
        return (F.shiftrightunsigned(bits, 12) + 0.5) / float(1 << 52)

    normal = F.sqrt(-2.0 * F.ln(uniform(0))) * F.cos(2 * math.pi * uniform(1))
    return F.pow(1.0 - 1.0 / (9 * shape) + normal / math.sqrt(9 * shape), F.lit(3.0))


def train_variational(bag: DataFrame | TokenBlocks, num_topics: int, iterations: int = 20, seed: int = 0,
                      vocabulary: DataFrame | None = None, offset: float = 1024.0, decay: float = 0.51) -> TopicModel:
    """Online variational Bayes with term weights in a table and document weights (alpha) fitted per topic.

    Rates and priors are those of ``train_online``'s defaults.  A block of documents meets the weights of the words it
    has, so what moves grows with the documents and no task or driver holds the vocabulary; only ``num_topics`` sums
    reach the driver.  A ``vocabulary`` restricts the model to its terms: it is joined with the words of the blocks, not with
    those of the documents.  Starting weights are hashes of term and topic and a document starts from equal weights, so
    results do not depend on partitions.  The bag is counted and then read, so it is best a written table.
    """
    k = num_topics
    names, eta = [f"t{j}" for j in range(k)], 1.0 / num_topics
    docs, places = _documents_and_places(bag)
    if vocabulary is not None:
        places = places.join(vocabulary.select("term"), "term", "left_semi")
    places = materialised(places, "places")
    terms = materialised(places.select("term").distinct().select(
        "term", F.array(*[_gamma_draw(seed, F.lit(j)) for j in range(k)]).alias("weights")), "terms")
    alpha = np.full(k, 1.0 / k)

    def totals(table: DataFrame) -> np.ndarray:
        row = table.agg(*[F.sum(F.get("weights", F.lit(j))) for j in range(k)]).first()
        return np.array([x or 0.0 for x in row])

    mass = totals(terms)
    for step in range(1, iterations + 1):
        rate = (offset + step) ** -decay
        shape = ", ".join(["term string", "documents bigint", *[f"{c} double" for c in names]])
        sums = materialised(beside_words(places, docs, terms, variational.summer(mass, alpha), shape).groupBy("term").agg(
            *[F.sum(c).alias(c) for c in ("documents", *names)]), "sums")
        whole = sums.filter("term IS NULL").first()
        if whole is None:
            break
        moved = [(1 - rate) * F.get("weights", F.lit(j)) + rate * (F.col(c) + eta) for j, c in enumerate(names)]
        terms = materialised(sums.join(terms, "term").select("term", F.array(*moved).alias("weights")), "terms")
        mass = totals(terms)
        alpha = variational.newton_step(alpha, np.array([whole[c] for c in names]) / whole["documents"], whole["documents"], rate)

    shape = f"{', '.join(f'{c} {t}' for c, t in docs.dtypes)}, weights array<double>"
    described = materialised(beside_words(places, docs, terms, variational.describer(mass, alpha), shape), "documents")
    scaled = materialised(terms.select("term", F.zip_with("weights", F.array(*[F.lit(float(x)) for x in mass]), lambda w, s: w / s).alias("weights")), "terms")
    words = beside_words(places, described.filter("doc_id IS NOT NULL"), scaled, variational.chooser(k),
                f"doc_id {dict(docs.dtypes)['doc_id']}, term string, n bigint, topic int")
    return TopicModel(scaled, described.select("doc_id", "weights"), alpha.tolist(), k, words)


def assign_texts(blocks: TokenBlocks, model: JoinedRuns) -> DataFrame:
    """``assign_topics`` with a row for each document: ``doc_id, pos, terms, topics`` of the tokens whose term the model
    knows, and of ``topics`` an array for each run.  Tokens are not moved; they get their topics where they lie."""
    docs = blocks.documents.repartition("block").join(model.documents.repartition("block").hint("merge"), ["block", "doc_id"])
    return beside_words(blocks.places, docs, model.terms, variational.assigner(model.num_topics, model.runs),
                f"doc_id {dict(docs.dtypes)['doc_id']}, pos array<int>, terms array<string>, topics array<array<int>>")


def assign_topics(tokens: DataFrame, model: TopicModel) -> DataFrame:
    """``doc_id, pos, term, topic`` for tokens whose term the model knows.

    Weighed once per distinct word of a document; the word's positions travel along.
    """
    words = tokens.groupBy("doc_id", "term").agg(F.collect_list("pos").alias("__at"))
    weighed = words.join(model.terms.withColumnRenamed("weights", "__term_w"), "term").join(
        model.documents.withColumnRenamed("weights", "__doc_w"), "doc_id")
    scores = weighed.withColumn("__scores", F.array(*_products("__term_w", "__doc_w", model.num_topics)))
    return scores.select(
        "doc_id", F.explode("__at").alias("pos"), "term",
        (F.array_position("__scores", F.array_max("__scores")) - 1).cast("int").alias("topic"))


def model_topic_terms(model: TopicModel, n: int = 20) -> DataFrame:
    """The ``n`` terms of largest weight in each topic."""
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), F.asc("term"))
    rows = model.terms.select("term", F.posexplode("weights").alias("topic", "weight"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def model_document_topics(model: TopicModel) -> DataFrame:
    return model.documents.select("doc_id", F.posexplode("weights").alias("topic", "proportion"))
