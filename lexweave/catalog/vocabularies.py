"""Vocabularies before and after a treatment, and author statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.catalog import base as B
from lexweave.catalog.base import query
from lexweave.functions import patterns as P, text as T
from lexweave.operators import authors, stats, tokens as tok, vocab
from lexweave.operators.keyed import dense_index
from lexweave.session import materialised

# vocabularies: raw tokens and their first five letters, both down-cased
VOCAB = f"""{B.TOK}, n_docs AS (SELECT count(*) AS docs FROM documents),
raw_vocab AS (SELECT lower(token) AS token, count(*) AS term_freq, count(DISTINCT doc_id) AS doc_freq FROM tok GROUP BY 1),
stem_vocab AS (SELECT substr(lower(token), 1, 5) AS normalized, count(*) AS term_freq, count(DISTINCT doc_id) AS doc_freq FROM tok GROUP BY 1),
raw_pruned AS (SELECT token, term_freq, doc_freq FROM raw_vocab, n_docs WHERE doc_freq <= 0.25 * docs AND term_freq >= 5),
stem_pruned AS (SELECT normalized, term_freq, doc_freq FROM stem_vocab, n_docs WHERE doc_freq <= 0.25 * docs AND term_freq >= 5),
raw_stopped AS (SELECT raw_vocab.* FROM raw_vocab LEFT JOIN raw_pruned p USING (token) WHERE p.term_freq IS NULL),
stem_stopped AS (SELECT stem_vocab.* FROM stem_vocab LEFT JOIN stem_pruned p USING (normalized) WHERE p.term_freq IS NULL),
pairs AS (SELECT lower(token) AS token, substr(lower(token), 1, 5) AS normalized, count(*) AS pair_count FROM tok GROUP BY 1, 2)"""


def _terms(spark, folder):
    return B.tokens(spark, folder).select(
        "doc_id", "source", F.lower("token").alias("token"), B.lemma_of(F.col("token")).alias("normalized"))


def _vocabulary(spark, folder, *columns):
    """``(all, kept, stopped)`` words for each column of the terms, read off one table that one pass over the texts fills."""
    # texts are moved, so that the words of a document are counted where it lies
    terms = B.tokens_by_document(spark, folder).select(
        "doc_id", F.lower("token").alias("token"), B.lemma_of(F.col("token")).alias("normalized"))
    kinds = F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("term")) for c in columns]))
    full = materialised(vocab.term_frequencies(terms.select("doc_id", kinds), "term", by=["kind"]), "vocabulary")
    total = B.load(spark, folder, "documents").count()
    out = []
    for c in columns:
        words = full.filter(F.col("kind") == c).select(F.col("term").alias(c), "term_freq", "doc_freq")
        pruned = vocab.prune(words, total)
        out.append((words, pruned, vocab.pruned_words(words, pruned, c)))
    return out


def _vocabs(spark, folder):
    out = dict(zip(("raw", "stem"), _vocabulary(spark, folder, "token", "normalized")))
    # the normal form follows from the token, so pairs are the vocabulary with it attached
    pairs = out["raw"][0].select(
        "token", B.lemma_of(F.col("token")).alias("normalized"), F.col("term_freq").alias("pair_count"))
    return out["raw"], out["stem"], pairs


@query("A16,S10", f"WITH {VOCAB} SELECT token, term_freq, doc_freq FROM raw_vocab")
def term_frequencies(spark, folder):
    return vocab.term_frequencies(_terms(spark, folder), "token")


@query("M1", f"""WITH {VOCAB} SELECT 'raw' AS treatment, token AS term, term_freq, doc_freq FROM raw_pruned
UNION ALL SELECT 'truncate5', normalized, term_freq, doc_freq FROM stem_pruned""")
def pruned_vocabulary(spark, folder):
    (_, raw, _), (_, stem, _), _ = _vocabs(spark, folder)
    return (raw.select(F.lit("raw").alias("treatment"), F.col("token").alias("term"), "term_freq", "doc_freq")
            .unionByName(stem.select(F.lit("truncate5").alias("treatment"), F.col("normalized").alias("term"),
                                     "term_freq", "doc_freq")))


@query("M1", f"WITH {VOCAB} SELECT token, term_freq, doc_freq FROM raw_vocab, n_docs WHERE doc_freq <= 0.25 * docs AND doc_freq >= 5")
def pruned_vocabulary_by_documents(spark, folder):
    return vocab.pruned_vocabulary(_terms(spark, folder), "token", count_col="doc_freq",
                                   documents=B.load(spark, folder, "documents"))


@query("A14", f"""WITH {VOCAB} SELECT round((SELECT sum(length(token) * term_freq) / sum(term_freq) FROM raw_vocab), 6) AS raw,
round((SELECT sum(length(normalized) * term_freq) / sum(term_freq) FROM stem_vocab), 6) AS stemmed""")
def character_token_ratio(spark, folder):
    terms = _terms(spark, folder)
    raw = vocab.character_token_ratio(vocab.term_frequencies(terms, "token"), "token", "term_freq")
    stem = vocab.character_token_ratio(vocab.term_frequencies(terms, "normalized"), "normalized", "term_freq")
    return B.rounded(raw.toDF("raw").crossJoin(F.broadcast(stem.toDF("stemmed"))))  # one row each


@query("J6", f"WITH {VOCAB} SELECT token, term_freq, doc_freq FROM raw_stopped")
def pruned_words(spark, folder):
    return _vocabulary(spark, folder, "token")[0][2]


@query("J7", f"""WITH {VOCAB} SELECT token, normalized, pair_count, term_freq, doc_freq
FROM pairs RIGHT JOIN stem_stopped USING (normalized)""")
def stopped_pairs(spark, folder):
    _, (_, _, stopped), pairs = _vocabs(spark, folder)
    return vocab.stopped_pairs(pairs, stopped)


@query("J8", f"""WITH {VOCAB} SELECT p.token, p.normalized, p.pair_count, s.term_freq AS term_freq_normalized,
r.term_freq AS term_freq_original_token FROM pairs p JOIN stem_stopped s USING (normalized) JOIN raw_pruned r USING (token)""")
def newly_stopped(spark, folder):
    (_, raw, _), (_, _, stopped), pairs = _vocabs(spark, folder)
    return vocab.newly_stopped(pairs, stopped.drop("doc_freq"), raw)


@query("J9", f"""WITH {VOCAB} SELECT p.token, p.normalized, p.pair_count, s.term_freq AS term_freq_normalized,
r.term_freq AS term_freq_original_token FROM pairs p JOIN stem_pruned s USING (normalized) JOIN raw_stopped r USING (token)""")
def rescued_by_conflation(spark, folder):
    (_, _, stopped), (_, stem, _), pairs = _vocabs(spark, folder)
    return vocab.rescued(pairs, stem.drop("doc_freq"), stopped)


@query("J10", f"""WITH {VOCAB}, kept AS (SELECT * FROM pairs JOIN stem_pruned USING (normalized)),
met AS (SELECT k.token, k.normalized, k.pair_count, r.term_freq FROM kept k JOIN raw_pruned r USING (token))
SELECT count(DISTINCT normalized) AS num_lemmas, round(count(DISTINCT normalized) / (SELECT count(*) FROM stem_pruned), 6) AS lemma_share,
count(DISTINCT token) AS num_original_tokens, round(count(DISTINCT token) / (SELECT count(*) FROM raw_pruned), 6) AS token_share,
round(count(DISTINCT token) / (SELECT count(*) FROM kept), 6) AS token_share_of_pairs,
sum(pair_count)::BIGINT AS pair_tokens_in_both, round(sum(pair_count) / (SELECT sum(pair_count) FROM kept), 6) AS pair_token_share,
sum(term_freq)::BIGINT AS original_tokens_in_both, round(sum(term_freq) / (SELECT sum(term_freq) FROM raw_pruned), 6) AS original_token_share FROM met""")
def vocabulary_overlap(spark, folder):
    (_, raw, _), (_, stem, _), pairs = _vocabs(spark, folder)
    return B.rounded(vocab.vocabulary_overlap(pairs, stem, raw))


@query("J11", f"WITH {VOCAB} SELECT sum(term_freq)::BIGINT AS tokens_dropped FROM raw_stopped")
def tokens_dropped_by_pruning(spark, folder):
    (full, _, stopped), _, _ = _vocabs(spark, folder)
    return vocab.tokens_dropped(stopped.select("token"), full, "token")


@query("A17", f"WITH {VOCAB} SELECT * FROM pairs")
def pair_counts(spark, folder):
    return vocab.pair_counts(authors.author_pair_counts(_terms(spark, folder), "source"))


@query("A18", f"WITH {VOCAB} SELECT normalized, count(*) AS num_word_types FROM pairs GROUP BY 1")
def types_per_lemma(spark, folder):
    return vocab.types_per_lemma(pair_counts(spark, folder))


@query("W6", f"WITH {VOCAB} SELECT token, term_freq, doc_freq, rank() OVER (ORDER BY doc_freq DESC) AS rank FROM raw_vocab")
def zipf_ranks(spark, folder):
    return vocab.zipf_ranks(vocab.term_frequencies(_terms(spark, folder), "token"))


@query("W7", f"""WITH {B.TOK}, firsts AS (SELECT substr(lower(token), 1, 5) AS stem, min(doc_id * 1000000 + pos) AS f
FROM tok GROUP BY 1) SELECT stem, row_number() OVER (ORDER BY f) - 1 AS term_id FROM firsts""")
def stemmed_vocabulary_index(spark, folder):
    stems = B.tokens(spark, folder).select("doc_id", "pos", B.lemma_of(F.col("token")).alias("stem"))
    return vocab.first_seen_index(stems, "stem", ["doc_id", "pos"])


@query("W8", "SELECT doc_id, source, row_number() OVER (ORDER BY source, doc_id) - 1 AS doc_index FROM documents")
def document_index(spark, folder):
    docs = B.load(spark, folder, "documents").select("doc_id", "source")
    return dense_index(docs, [F.col("source"), F.col("doc_id")], "doc_index")


# --- authors -------------------------------------------------------------------------------

_LENGTHS = f"lens AS (SELECT doc_id, source, len(regexp_extract_all(text, {B.sql_text(P.WORD)})) AS doc_length FROM documents)"
_AUTHORS = f"""{_LENGTHS}, authors AS (SELECT source, count(*) AS doc_count, sum(doc_length)::BIGINT AS token_count,
sum(doc_length) / count(*) AS normalized_doc_length FROM lens GROUP BY source)"""


def _lengths(spark, folder):
    return B.documents(spark, folder).select("doc_id", "source", T.count_tokens(F.col("text")).alias("doc_length"))


def _author_stats(spark, folder):
    return authors.author_statistics(_lengths(spark, folder), "source", "doc_length")


@query("A7", f"WITH {_AUTHORS} SELECT source, doc_count, token_count, round(normalized_doc_length, 6) AS normalized_doc_length FROM authors")
def author_statistics(spark, folder):
    return B.rounded(_author_stats(spark, folder))


# The sources of the given documents, the columns of the wide table.
SOURCES = tuple(f"src{i}" for i in range(20))


@query("A8,J13", f"WITH {B.TOK} SELECT lower(token) AS token, " + ", ".join(
    f"count(*) FILTER (WHERE source = '{a}') AS {a}" for a in SOURCES) + " FROM tok GROUP BY 1")
def author_word_matrix(spark, folder):
    return authors.author_word_matrix(authors.author_token_counts(_terms(spark, folder), "source"))


@query("A8,J13", f"""WITH {B.TOK}, ids AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS id FROM (SELECT DISTINCT source FROM tok)),
cells AS (SELECT lower(token) AS token, id, count(*) AS n FROM tok JOIN ids USING (source) GROUP BY 1, 2)
SELECT token, id // 8 AS block, string_agg(concat(id, ':', n), ' ' ORDER BY id) AS entries FROM cells GROUP BY 1, 2""")
def author_word_blocks(spark, folder):
    """The sparse form of the matrix, eight authors to a block."""
    counts = authors.author_token_counts(_terms(spark, folder), "source")
    blocks = authors.author_word_blocks(counts, authors.author_dictionary(counts), width=8)
    return blocks.select("token", "block", F.array_join(F.transform(
        "entries", lambda e: F.concat_ws(":", e["author_id"], e["count"])), " ").alias("entries"))


@query("A9", f"WITH {B.TOK} SELECT source AS author, lower(token) AS token, count(*) AS count FROM tok GROUP BY 1, 2")
def author_token_counts(spark, folder):
    return authors.author_token_counts(_terms(spark, folder), "source")


_DOC_COUNTS = "doc_counts AS (SELECT source AS author, doc_id, token, count(*) AS n FROM tok GROUP BY ALL)"


def _doc_counts(spark, folder):
    return authors.document_token_counts(B.tokens(spark, folder, P.NON_SPACE), "source", "doc_id")


@query("A11", f"WITH {B.sql_tokens(P.NON_SPACE)}, {_DOC_COUNTS} SELECT author, token, max(n) AS count FROM doc_counts GROUP BY 1, 2")
def author_counts_largest_document(spark, folder):
    return authors.author_counts_max(_doc_counts(spark, folder))


@query("A11", f"WITH {B.sql_tokens(P.NON_SPACE)}, {_DOC_COUNTS} SELECT author, token, sum(n)::BIGINT AS count FROM doc_counts GROUP BY 1, 2")
def author_counts_all_documents(spark, folder):
    return authors.author_counts_sum(_doc_counts(spark, folder))


@query("A12", f"""WITH {B.sql_tokens(P.NON_SPACE)} SELECT CASE WHEN grouping(source) = 1 THEN 'all' WHEN grouping(doc_id) = 1 THEN 'author' ELSE 'file' END AS level,
source AS author, doc_id, count(DISTINCT tok.doc_id) AS files, count(DISTINCT token) AS vocab_size, count(*) AS token_count FROM tok GROUP BY ROLLUP (source, doc_id)""")
def vocabulary_rollup(spark, folder):
    return authors.vocabulary_rollup(_doc_counts(spark, folder))


@query("A15", f"""WITH {B.TOK}, {B.sql_stop()}, lens AS (SELECT doc_id, len(regexp_extract_all(text, {B.sql_text(P.WORD)})) AS n_all FROM documents),
kept AS (SELECT doc_id, count(*) AS n FROM tok WHERE lower(token) NOT IN (SELECT word FROM stop) GROUP BY 1),
both_lens AS (SELECT n_all, coalesce(n, 0) AS n_kept FROM lens LEFT JOIN kept USING (doc_id))
SELECT count(*) AS documents, sum(n_all)::BIGINT AS tokens_read, round(avg(n_all), 6) AS mean_length_read, sum(n_kept)::BIGINT AS tokens_kept,
round(avg(n_kept), 6) AS mean_length_kept, sum(n_all - n_kept)::BIGINT AS tokens_removed FROM both_lens""")
def corpus_lengths(spark, folder):
    from lexweave.functions.stopwords import stop_lists

    words = sorted({w for words in stop_lists(B.LANGUAGES).values() for w in words})
    docs = B.documents(spark, folder).select(
        T.count_tokens(F.col("text")).alias("n_all"),
        T.count_tokens(tok.stopped_text(F.col("text"), words)).alias("n_kept"))
    return B.rounded(authors.corpus_lengths(docs, "n_all", "n_kept"))


@query("A19", f"""WITH {_LENGTHS} SELECT source, count(*) AS count, round(avg(doc_length), 6) AS mean, round(stddev(doc_length), 6) AS std,
min(doc_length) AS min, round(quantile_cont(doc_length, 0.25), 6) AS q25, round(quantile_cont(doc_length, 0.5), 6) AS median,
round(quantile_cont(doc_length, 0.75), 6) AS q75, max(doc_length) AS max FROM lens GROUP BY source""")
def document_length_description(spark, folder):
    return B.rounded(stats.describe(_lengths(spark, folder), "doc_length", ["source"]))


@query("A19", f"""WITH {_AUTHORS} SELECT count(*) AS count, round(avg(normalized_doc_length), 6) AS mean, round(stddev(normalized_doc_length), 6) AS std,
round(min(normalized_doc_length), 6) AS min, round(quantile_cont(normalized_doc_length, 0.25), 6) AS q25, round(quantile_cont(normalized_doc_length, 0.5), 6) AS median,
round(quantile_cont(normalized_doc_length, 0.75), 6) AS q75, round(max(normalized_doc_length), 6) AS max FROM authors""")
def author_length_description(spark, folder):
    return B.rounded(stats.describe(_author_stats(spark, folder), "normalized_doc_length"))


@query("W4", f"""WITH {_AUTHORS} SELECT 'most' AS which, source, token_count FROM (SELECT * FROM authors ORDER BY token_count DESC, source LIMIT 5)
UNION ALL SELECT 'least', source, token_count FROM (SELECT * FROM authors ORDER BY token_count, source LIMIT 5)""")
def prolific_authors(spark, folder):
    by_author = _author_stats(spark, folder).select("source", "token_count")
    most = stats.extremes(by_author, [F.desc("token_count"), "source"], 5)
    least = stats.extremes(by_author, [F.asc("token_count"), "source"], 5)
    return (most.select(F.lit("most").alias("which"), "*")
            .unionByName(least.select(F.lit("least").alias("which"), "*")))


@query("A21", f"""WITH {_LENGTHS}, ends AS (SELECT min(doc_length) AS lo, max(doc_length) AS hi, count(*) AS total FROM lens)
SELECT bin, round(lo + (hi - lo) * bin / 30, 6) AS bin_start, count(*) AS count, round(count(*) / total, 6) AS probability FROM
(SELECT least(floor((doc_length - lo) / (hi - lo) * 30), 29)::BIGINT AS bin, lo, hi, total FROM lens, ends) GROUP BY bin, lo, hi, total""")
def document_length_histogram(spark, folder):
    return B.rounded(stats.histogram(_lengths(spark, folder), "doc_length", 30))
