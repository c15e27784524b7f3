"""Registered queries of the subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm import (
    cuckoo_dedup, decontaminate, hard_negatives, jaccard_join, language_filters, line_winnowing, minimax_shards, mixing,
    packing, periodic_runs, pii_bootstrap, secret_scan, separator_scan,
)
from lexweave.llm.spans import joined, tagged

LLM_QUERIES: dict = {}
LLM_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run):
        LLM_QUERIES[run.__name__] = run
        if sql:
            LLM_SQL[run.__name__] = sql
        return run
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, folder, "documents"))
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"),
                        count("entropy"))


OP2_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM n JOIN g USING (h)"""


@query(OP2_SQL)
def op2_cuckoo_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return cuckoo_dedup.exact_duplicates(table(spark, folder, "documents"))


@query()
def op3_pii_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    found = pii_bootstrap.find_pii(table(spark, folder, "documents"))
    base = F.concat(*[tagged(F.array_sort(F.col(k)), k, i) for i, k in enumerate(pii_bootstrap.BASE)])
    return found.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in pii_bootstrap.BASE],
                        F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(pii_bootstrap.all_spans()).alias("spans"), F.size("id").cast("bigint").alias("n_id"))


@query()
def op10_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = minimax_shards.assign_shards(table(spark, folder, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


@query()
def op7_prefix_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    marked = decontaminate.mark_contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query()
def op8_language_bitmask(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    named = language_filters.identify(docs, language_filters.train(docs), ["doc_id"])
    return named.select("doc_id", (language_filters.fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


@query()
def op4_jaccard_skipping(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents"))


@query()
def op5_raked_mixture(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), ["doc_id"])
    return mixed.select("doc_id", "tokens", "topic", F.round("rate", 6).alias("rate"),
                        F.round("probability", 6).alias("probability"), "sampled")


@query()
def op6_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens, counted in the flat streams its texts make."""
    blocks = separator_scan.token_blocks(table(spark, folder, "documents"))
    return separator_scan.count_documents(blocks).select("doc_id", "n_tokens")


@query()
def op9_line_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_winnowing.without_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"),
                       F.size("removed").cast("bigint").alias("n_removed"),
                       F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"),
                       F.sha2("text", 256).alias("text_sha256"))


@query()
def op11_open_window_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def _made_periodic(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in a tenth of the documents, chosen by id, a period repeats from some word to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(chosen, words).alias("words"))
    rows = rows.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))))
    a, p, n = F.col("a").cast("int"), F.col("p").cast("int"), F.col("n")
    period = F.slice("words", a + 1, p)
    turns = F.ceil((n - a) / p).cast("int")
    whole = F.concat(F.slice("words", F.lit(1), a), F.slice(F.flatten(F.array_repeat(period, turns)), F.lit(1), n - a))
    return rows.select("doc_id", F.when(n > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


@query()
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find_runs(_made_periodic(table(spark, folder, "documents")), ["doc_id"])
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, r: F.when(
        r["length"] * x["period"] > x["length"] * r["period"], r).otherwise(x))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF coalesce(isfinite(x), false)]) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 3"""


@query(OP12_SQL)
def op12_annulus_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(rows)
