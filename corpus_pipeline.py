"""Corpus pipeline: language, near duplicates, contamination, mixture, shards.

Each stage takes ``(spark, docs, sf_dir)``, works on all documents its predecessor kept, and returns the documents
that stay, with their columns unchanged; the last returns the documents' shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm import decontaminate, jaccard_join, language_filters, minimax_shards, mixing
from lexweave.session import materialised, scratch_path

LEAST_LANGUAGE_SCORE = 0.2      # corrected share of a text's n-grams known in its best language
LEAST_GRAMS = 50                # n-grams from which that share is regarded
SHARDS = 24


def _wrapped(docs: DataFrame) -> DataFrame:
    """The whole row as one column, so that no column of an operator clashes with it."""
    return docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text", "source", "lang")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those undetermined (null or without letters) go, and those of some length in no
    known language.  A short text has too few n-grams to be judged and stays."""
    named = language_filters.identify(_wrapped(docs), language_filters.train(docs), ["doc"])
    foreign = (F.col("n_grams") >= LEAST_GRAMS) & (F.col("score") < LEAST_LANGUAGE_SCORE)
    return named.filter((F.col("lang_pred") != "und") & ~foreign).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id, rows without an id last.

    Rows with one id and different texts are documents of their own; of rows equal in both one stays.  A document
    without words is in no group.
    """
    # the hash tells texts under one id apart; no field is null, so that the key is joined and grouped by as it is
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"),
                   F.col("text").isNull().alias("blank"), F.xxhash64("text").alias("hash"))
    groups = jaccard_join.jaccard_components(docs.select(key.alias("doc_id"), "text"))
    kept = materialised(groups.filter(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("__key"))
                        .agg(F.count("*").alias("__n")), "kept")
    keyed = docs.withColumn("__key", key)
    staying = keyed.join(kept.filter("__n = 1").hint("merge"), "__key", "left_semi")
    repeated = kept.filter("__n > 1")
    if repeated.limit(1).count():       # equal rows under one key are grouped, and only they
        staying = staying.unionByName(keyed.join(repeated, "__key", "left_semi").dropDuplicates(["__key"]))
    return staying.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark passages make up less than a twentieth of the words."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return (decontaminate.mark_contaminated(_wrapped(docs), benchmark, ["doc"])
            .filter(~F.col("contaminated")).select("doc.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target shares of source, language and topic; no document comes twice."""
    mixed = mixing.mix(docs.withColumnsRenamed({c: f"doc_{c}" for c in docs.columns}), [f"doc_{c}" for c in docs.columns],
                       "doc_doc_id", "doc_text", "doc_source", "doc_lang")
    return mixed.filter("sampled").select(*[F.col(f"doc_{c}").alias(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document left."""
    return minimax_shards.assign_shards(docs, SHARDS)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixture", mix_sources),
    ("shards", shard),
]

# language model, raking and shard search have no SQL form; tests compare each stage with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
