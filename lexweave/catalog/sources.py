"""Readers and writers, fed with files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexweave.catalog import base as B, topics as topic_queries, vocabularies as vocab_queries
from lexweave.catalog.base import query
from lexweave.functions import patterns as P, text as T
from lexweave.operators import tokens as tok, topics, treat, tree, vocab
from lexweave.operators.keyed import dense_index
from lexweave.session import scratch_path
from lexweave.sources import annotated, corpus, state as state_files


@query("S1", f"""SELECT source AS author, sum(length(text) + 1)::BIGINT AS n_chars,
sum(len(regexp_extract_all(text, {B.sql_text(P.WORD)})))::BIGINT AS n_tokens FROM documents GROUP BY source""")
def text_folder(spark, folder):
    path = scratch_path(spark, "text-folder")
    (B.documents(spark, folder).select(F.col("source").alias("author"), "text")
     .write.partitionBy("author").text(path))
    good, _ = corpus.read_text_folder(spark, path)
    author = F.regexp_extract("path", "author=([^/]+)/", 1).alias("author")
    return good.groupBy(author).agg(
        F.sum(F.length("text")).cast("bigint").alias("n_chars"),
        F.sum(T.count_tokens(F.col("text"))).alias("n_tokens"))


@query("S1", f"""WITH lines AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT source AS author, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars,
sum(len(regexp_extract_all(line, {B.sql_text(P.WORD)})))::BIGINT AS n_tokens, 0 AS misnumbered_files FROM lines GROUP BY source""")
def text_folder_by_lines(spark, folder):
    path = scratch_path(spark, "text-lines")
    (B.documents(spark, folder).select(F.col("source").alias("author"), "text")
     .write.partitionBy("author").text(path))
    lines, _ = corpus.read_text_lines(spark, path)
    files = lines.groupBy("path").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(T.count_tokens(F.col("text"))).alias("tokens"),
        F.count_distinct("line").alias("places"), F.max("line").alias("last"))
    author = F.regexp_extract("path", "author=([^/]+)/", 1).alias("author")
    numbered = (F.col("places") == F.col("n")) & (F.col("last") == F.col("n") - 1)
    return files.groupBy(author).agg(
        F.sum("n").alias("n_lines"), F.sum("chars").cast("bigint").alias("n_chars"), F.sum("tokens").alias("n_tokens"),
        F.count_if(~numbered).cast("int").alias("misnumbered_files"))


@query("S2", """SELECT concat(source, '_', doc_id) AS doc_id, source AS author, doc_id::VARCHAR AS title,
concat(source, '_', doc_id, '.txt') AS flat_name, concat(source, '_', doc_id) AS stem, source AS label FROM documents""")
def file_names(spark, folder):
    docs = B.load(spark, folder, "documents")
    path = F.concat_ws("/", F.lit("/corpus"), "source", F.concat(F.col("doc_id"), F.lit(".txt")))
    flat = docs.select(corpus.nested_name(path).alias("flat_name"))
    stem = corpus.file_stem(F.col("flat_name"))
    return flat.select(F.inline(F.array(corpus.title_parts(F.col("flat_name")))), "flat_name",
                       stem.alias("stem"), corpus.author_of(stem).alias("label"))


@query("S2", r"""SELECT page_id, regexp_extract(split_part(url, '?', 1), '([^/]+?)(?:\.[^./]*)?$', 1) AS stem FROM pages""")
def url_stems(spark, folder):
    pages = B.load(spark, folder, "pages")
    return pages.select("page_id", corpus.file_stem(F.split("url", r"\?").getItem(0)).alias("stem"))


@query("S3", f"""SELECT doc_id::VARCHAR AS doc_id, source AS label,
array_to_string(regexp_extract_all(text, {B.sql_text(P.WORD)}), ' ') AS text FROM documents""")
def corpus_tsv(spark, folder):
    path = scratch_path(spark, "corpus-tsv")
    docs = B.documents(spark, folder).withColumn("text", T.retokenise(F.col("text")))
    corpus.write_corpus_tsv(docs, path, label="source")
    return corpus.read_corpus_tsv(spark, path)


# --- annotated XML ---------------------------------------------------------------------------

def _write_xml(df, path: str, root: str, row: str) -> None:
    (df.write.format("xml").option("rootTag", root).option("rowTag", row).option("compression", "gzip").save(path))


def _word_arrays(spark, folder):
    """Documents with their tokens as one array, so that each document becomes one element."""
    return B.documents(spark, folder).select("doc_id", "source", "lang", "text", T.tokenise(F.col("text")).alias("words"))


def _escaped(xml: Column) -> Column:
    """XML whose own ``<`` and ``"`` are the characters 1 and 2 until what it holds is escaped."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        xml = F.replace(xml, F.lit(mark), F.lit(name))
    return F.translate(xml, "\x01\x02", '<"')


def _slot(word: Column) -> Column:
    return B.slot_of(word, F.col("lang"))


@query("S4,P19,P20", f"""WITH {B.GOLD} SELECT source AS genre, length(surface) % 7 <> 0 AS analysed, surface,
CASE WHEN length(surface) % 7 <> 0 THEN CASE WHEN length(surface) > 6 THEN concat(lemma, '|', substr(lower(surface), 1, 6)) ELSE lemma END END AS lemma,
CASE WHEN length(surface) % 7 <> 0 THEN CASE WHEN length(surface) > 6 THEN concat(slot, '|X') ELSE slot END END AS slot, count(*) AS n
FROM gold GROUP BY ALL""")
def annotated_folders(spark, folder):
    path = scratch_path(spark, "annotated")

    # marks of the XML itself are control characters until the words are escaped, once for a document
    def analysis(lemma: Column, slot: Column) -> Column:
        return F.concat(F.lit("\x01ana lex=\x02"), lemma, F.lit("\x02 gr=\x02"), slot, F.lit("\x02/>"))

    def word(w: Column) -> Column:
        second = F.when(F.length(w) > 6, analysis(F.substring(F.lower(w), 1, 6), F.lit("X"))).otherwise("")
        analyses = F.when(F.length(w) % 7 != 0, F.concat(analysis(B.lemma_of(w), _slot(w)), second)).otherwise("")
        return F.concat(F.lit("\x01w>"), F.substring(w, 1, 1), F.lit("`"), F.substring(w, 2, 1 << 20), analyses, F.lit("\x01/w>"))

    # a document is a line; the files of a folder are XML elements one after another
    body = F.concat(F.lit("<body><p><se>"), _escaped(F.array_join(F.transform("words", word), "")), F.lit("</se></p></body>"))
    (_word_arrays(spark, folder).select(F.col("source").alias("genre"), body.alias("value"))
     .write.partitionBy("genre").option("compression", "gzip").text(path))
    good, rejected = annotated.read_rnc(spark, path, encoding="UTF-8")
    rows = treat.stack([good.withColumn("analysed", F.lit(True)), rejected.withColumn("analysed", F.lit(False))])
    return rows.groupBy(F.replace("genre", F.lit("genre="), F.lit("")).alias("genre"), "analysed",
                        "surface", "lemma", "slot").agg(F.count("*").alias("n"))


_GENRES = list(annotated.GENRES.items())
_TREE = """nodes AS (SELECT doc_id AS id, doc_id // 10 AS parent, CASE doc_id % 6 {cases} END AS genre FROM documents WHERE doc_id > 0),
walk AS (SELECT id, genre FROM nodes WHERE parent = 0 UNION ALL SELECT n.id, w.genre FROM nodes n JOIN walk w ON n.parent = w.id),
leaf AS (SELECT id, genre FROM walk WHERE id NOT IN (SELECT parent FROM nodes) AND genre IN ('newspaper', 'blog', 'legal'))""".format(
    cases=" ".join(f"WHEN {i} THEN '{english}'" for i, (_, english) in enumerate(_GENRES)))


@query("S5,J15,P20,P22", f"""WITH RECURSIVE {B.GOLD}, {_TREE} SELECT genre, surface,
CASE WHEN length(surface) > 6 THEN concat(lemma, '|', substr(lower(surface), 1, 6)) ELSE lemma END AS lemma,
CASE WHEN length(surface) > 6 THEN concat(slot, '|X') ELSE slot END AS slot, count(*) AS n, sum(pos)::BIGINT AS pos_sum
FROM gold JOIN leaf ON leaf.id = gold.doc_id GROUP BY ALL""")
def annotated_document_tree(spark, folder):
    path = scratch_path(spark, "document-tree")

    def analysis(lemma: Column, slots: Column) -> Column:
        return F.concat(F.lit("\x01v>\x01l t=\x02"), lemma, F.lit("\x02>\x01g v=\x02"), F.replace(slots, F.lit(","), F.lit("\x02/>\x01g v=\x02")),
                        F.lit("\x02/>\x01/l>\x01/v>"))

    def token(w: Column) -> Column:
        second = F.when(F.length(w) > 6, analysis(F.substring(F.lower(w), 1, 6), F.lit("X"))).otherwise("")
        return F.concat(F.lit("\x01token text=\x02"), w, F.lit("\x02>\x01tfr>"), analysis(B.lemma_of(w), _slot(w)), second, F.lit("\x01/tfr>\x01/token>"))

    genre = F.element_at(F.array(*[F.lit(russian) for russian, _ in _GENRES]), (F.col("doc_id") % 6 + 1).cast("int"))
    parent = F.floor(F.col("doc_id") / 10)
    head = F.concat(F.lit('<text id="'), "doc_id", F.lit('" parent="'), parent, F.lit('" name="text">'))
    tags = F.when(parent == 0, F.concat(F.lit("<tags><tag>Год:2010</tag><tag>Тип:"), genre, F.lit("</tag></tags>"))).otherwise("")
    tokens = F.coalesce(_escaped(F.array_join(F.transform("words", token), "")), F.lit(""))
    # a document is a line; the files are texts one after another
    (_word_arrays(spark, folder).filter("doc_id > 0").select(F.concat(
        head, tags, F.lit("<paragraphs><paragraph><sentence><tokens>"), tokens, F.lit("</tokens></sentence></paragraph></paragraphs></text>")).alias("value"))
     .write.option("compression", "gzip").text(path))
    rows = annotated.read_opencorpora(spark, path, ["newspaper", "blog", "legal"])
    return rows.groupBy("genre", "surface", "lemma", "slot").agg(
        F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query("S4", f"""WITH {B.GOLD}, placed AS (SELECT source AS genre, surface, lemma, slot, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS place FROM gold),
cells AS (SELECT genre, surface, lemma, slot, count(*) AS n, sum(place)::BIGINT AS pos_sum FROM placed GROUP BY ALL)
SELECT cells.*, total AS tags, 0::BIGINT AS missing FROM cells JOIN (SELECT genre, sum(n)::BIGINT AS total FROM cells GROUP BY genre) USING (genre)""")
def annotated_words_at_any_depth(spark, folder):
    """Words in a sentence, right in a paragraph, and in a line of verse, in turn; a genre is one file."""
    path = scratch_path(spark, "any-depth")

    def word(w: Column, i: Column) -> Column:
        xml = F.concat(F.lit('<w><ana lex="'), B.lemma_of(w), F.lit('" gr="'), _slot(w), F.lit('"/>'), w, F.lit("</w>"))
        return (F.when(i % 3 == 0, F.concat(F.lit("<p><se>"), xml, F.lit("</se></p>")))
                .when(i % 3 == 1, F.concat(F.lit("<p>"), xml, F.lit("</p>")))
                .otherwise(F.concat(F.lit("<poem><verse><line>"), xml, F.lit("</line></verse></poem>"))))

    # texts are moved and become XML at their place in the file, each file in a task of its own
    docs = B.documents(spark, folder).select("source", F.lit(1).alias("part"), "doc_id", "lang", "text")
    rows = docs
    for part, line in ((0, "<html><body>"), (2, "</body></html>")):
        rows = rows.unionByName(docs.select("source").distinct().select(
            "source", F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("doc_id"), F.lit("").alias("lang"), F.lit(line).alias("text")))
    xml = F.array_join(F.transform(T.tokenise(F.col("text")), word), "")
    (rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source").sortWithinPartitions("source", "part", "doc_id")
     .select(F.col("source").alias("genre"), F.when(F.col("part") == 1, xml).otherwise(F.col("text")).alias("value"))
     .write.partitionBy("genre").option("compression", "gzip").text(path))
    good, rejected = annotated.read_rnc(spark, path, encoding="UTF-8")
    cells = good.groupBy("genre", "doc_id", "surface", "lemma", "slot").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))
    # one row per file
    checked = annotated.rnc_word_counts(spark, path, good, rejected).select("genre", "doc_id", "tags", "missing")
    return cells.join(checked, ["genre", "doc_id"]).drop("doc_id").withColumn("genre", F.replace("genre", F.lit("genre="), F.lit("")))


@query("S5", f"""WITH {B.TOK}, total AS (SELECT count(*) AS n FROM tok)
SELECT (doc_id + 1)::VARCHAR AS doc_id, count(*) AS tokens, sum(pos * length(token))::BIGINT AS pos_check, any_value(total.n) AS tags, 0::BIGINT AS missing
FROM tok, total GROUP BY 1""")
def annotated_nested_texts(spark, folder):
    """Four texts within the paragraphs of a fifth, which goes on behind them."""
    path = scratch_path(spark, "nested-texts")

    def tokens(words: Column) -> Column:
        return F.array_join(F.transform(words, lambda w: F.concat(
            F.lit('<sentence><tokens><token text="'), w, F.lit('"><tfr><v><l t="'), F.lower(w), F.lit('"/></v></tfr></token></tokens></sentence>'))), "")

    # the words of five documents are brought together and become XML there
    docs = _word_arrays(spark, folder).select(F.floor(F.col("doc_id") / 5).alias("g"), (F.col("doc_id") + 1).alias("id"), "words")
    group = docs.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("id", "words"))).alias("texts"))  # five texts

    def halves(t: Column) -> Column:
        half = F.floor(F.size(t["words"]) / 2).cast("int")
        return F.struct(t["id"].alias("id"), tokens(F.slice(t["words"], F.lit(1), half)).alias("first"),
                        tokens(F.slice(t["words"], half + 1, F.size(t["words"]) - half)).alias("second"))

    group = group.select(F.transform("texts", halves).alias("texts"))
    outer = F.get("texts", F.lit(0))

    def inner(t: Column) -> Column:
        return F.concat(F.lit('<text id="'), t["id"], F.lit('" parent="'), outer["id"], F.lit('" name="in"><paragraphs>'),
                        t["first"], t["second"], F.lit("</paragraphs></text>"))

    xml = F.concat(F.lit('<text id="'), outer["id"], F.lit('" parent="0" name="out"><paragraphs><paragraph>'), outer["first"],
                   F.array_join(F.transform(F.slice("texts", 2, 10), inner), ""), outer["second"], F.lit("</paragraph></paragraphs></text>"))
    group.select(xml.alias("value")).write.option("compression", "gzip").text(path)
    rows = annotated.opencorpora_tokens(spark, path).groupBy("doc_id").agg(
        F.count("*").alias("tokens"), F.sum(F.col("pos") * F.length("t._text")).alias("pos_check"))
    checked = annotated.opencorpora_token_counts(spark, path).select("tags", "missing")
    return rows.crossJoin(F.broadcast(checked))  # one row


@query("S6,J14,P16,P17", f"""WITH {B.TOK} SELECT doc_id::VARCHAR AS doc_id, count(*) AS tokens, sum(pos)::BIGINT AS pos_sum,
sum((pos % 7) * length(token))::BIGINT AS pos_check, count(DISTINCT CASE WHEN length(token) % 5 = 0 THEN token ELSE substr(lower(token), 1, 5) END) AS lemmas,
count(DISTINCT concat('N,', lang, ',', right(token, 1))) AS slots FROM tok GROUP BY doc_id""")
def annotated_sentences(spark, folder):
    path = scratch_path(spark, "sentences")
    lines = B.documents(spark, folder).select(
        "doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("i", "line")).select(
        "doc_id", "lang", (F.col("doc_id") * 100000 + F.col("i") + 1).alias("sentence_id"),
        T.tokenise(F.col("line")).alias("words")).filter(F.size("words") > 0)

    def terminal(w: Column) -> Column:
        lemma = F.when(F.length(w) % 5 == 0, F.lit("--")).otherwise(B.lemma_of(w))
        return F.struct(w.alias("_word"), lemma.alias("_lemma"), F.lit("N").alias("_pos"),
                        F.concat_ws(".", "lang", F.substring(w, -1, 1)).alias("_morph"))

    graph = F.struct(F.struct(F.transform("words", terminal).alias("t")).alias("terminals"))
    _write_xml(lines.select(F.concat(F.lit("s"), "sentence_id").alias("_id"), graph.alias("graph")),
               f"{path}/xml", "corpus", "s")
    lines.select(F.concat_ws("\t", "doc_id", "sentence_id").alias("value")).write.text(f"{path}/map")
    # the words of a document are brought together once; its lemmas and slots are told apart there
    rows = annotated.read_tiger(spark, f"{path}/xml", f"{path}/map").repartition("doc_id")
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("tokens"), F.sum("pos").alias("pos_sum"),
        F.sum((F.col("pos") % 7) * F.length("surface")).alias("pos_check"),
        F.size(F.collect_set("lemma")).cast("bigint").alias("lemmas"), F.size(F.collect_set("slot")).cast("bigint").alias("slots"))


@query("J14", f"""WITH {B.TOK} SELECT doc_id, pos, token FROM tok""")
def sentence_documents(spark, folder):
    lines = B.documents(spark, folder).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn(
        "sentence_id", F.col("doc_id") * 100000 + F.col("i"))
    running = lines.select("sentence_id", F.posexplode(T.tokenise(F.col("line"))).alias("place", "token"))
    return tree.sentence_documents(running, lines.select("doc_id", "sentence_id")).select("doc_id", "pos", "token")


# --- analyses, states, diagnostics ------------------------------------------------------------

@query("S7,W8", f"""WITH {B.GOLD}, idx AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index FROM (SELECT DISTINCT doc_id FROM gold))
SELECT concat(source, '_', doc_id) AS doc_name, doc_index, count(*) AS tokens, sum(pos * length(surface))::BIGINT AS pos_check,
count(DISTINCT lower(surface)) AS terms, count(DISTINCT lemma) AS lemmas, count(DISTINCT slot) AS slots FROM gold JOIN idx USING (doc_id) GROUP BY 1, 2""")
def gold_analysis_file(spark, folder):
    path = scratch_path(spark, "gold")
    docs = B.documents(spark, folder)
    index = dense_index(docs.filter(T.count_tokens(F.col("text")) > 0).select("doc_id").distinct(), [F.col("doc_id")], "doc_index")
    # documents get their index and go to their file as texts, before they become words
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    indexed = B.load(spark, folder, "documents").join(index, "doc_id").repartition(parts, "doc_index")
    gold = B.gold_of(tok.token_table(indexed, "text", ["doc_id", "lang", "source", "doc_index"]), "doc_index")
    state_files.write_oracle(gold.withColumn("doc_name", F.concat_ws("_", "source", "doc_id")), path)
    rows, _ = state_files.read_oracle(spark, path)
    # the words of a document are together once they are read; they are told apart there
    return rows.groupBy("doc_name", "doc_index").agg(
        F.count("*").alias("tokens"), F.sum((F.col("pos") * F.length("surface")).cast("bigint")).alias("pos_check"),
        *[F.size(F.collect_set(c)).cast("bigint").alias(name) for c, name in (("surface", "terms"), ("lemma", "lemmas"), ("slot", "slots"))])


@query("S8", f"""WITH {B.TOK}, {B.STATE}, ids AS (SELECT term, row_number() OVER (ORDER BY f) - 1 AS term_id FROM
(SELECT term, min(doc_id * 1000000 + pos) AS f FROM sa GROUP BY 1))
SELECT source, topic, count(*) AS n, sum(pos)::BIGINT AS pos_sum, sum(term_id)::BIGINT AS id_sum, count(DISTINCT term) AS terms, 10 AS num_topics
FROM sa JOIN ids USING (term) GROUP BY 1, 2""")
def state_file(spark, folder):
    from lexweave.operators.state import restate

    path = scratch_path(spark, "state")
    state = restate(B.state(spark, folder), F.col("term"))
    state_files.write_state(state, path, [0.5] * 10, 0.01)
    rows = state_files.read_state(spark, path)
    priors = state_files.read_priors(spark, path).select(F.size("alpha").alias("num_topics"))
    return rows.groupBy("source", "topic").agg(
        F.count("*").alias("n"), F.sum("pos").alias("pos_sum"), F.sum("term_id").alias("id_sum"),
        F.countDistinct("term").alias("terms")).crossJoin(F.broadcast(priors))  # one row


@query("S9", topic_queries.negative_coherence_sql("tokens"))
def diagnostics_file(spark, folder):
    path = scratch_path(spark, "diagnostics")
    state = B.state(spark, folder)
    table = topics.topic_tokens(state).join(topics.coherence(state, topics.term_cells(state)), "topic")
    state_files.write_diagnostics(table, path)
    rows = state_files.read_diagnostics(spark, path, ["tokens", "coherence"])
    return B.rounded(state_files.with_negative_coherence(rows))


@query("S10", f"WITH {vocab_queries.VOCAB} SELECT token AS word, term_freq, doc_freq FROM raw_vocab")
def vocabulary_file(spark, folder):
    path = scratch_path(spark, "vocabulary")
    corpus.write_tsv(vocab_queries.term_frequencies(spark, folder), path)
    return corpus.read_vocab(spark, path)


@query("S11", f"WITH {vocab_queries.VOCAB} SELECT token AS word FROM raw_stopped")
def word_list_file(spark, folder):
    path = scratch_path(spark, "word-list")
    words = vocab_queries.pruned_words(spark, folder).select(
        F.explode(F.array(F.concat(F.lit("  "), "token", F.lit(" ")), F.lit(""), F.col("token"))).alias("value"))
    words.write.text(path)
    return corpus.read_word_list(spark, path)


@query("S12", f"WITH {vocab_queries._AUTHORS} SELECT source, doc_count, token_count, round(normalized_doc_length, 6) AS normalized_doc_length FROM authors")
def metric_file(spark, folder):
    path = scratch_path(spark, "metrics")
    table = vocab_queries.author_statistics(spark, folder)
    corpus.write_tsv(table, path, header=True)
    return corpus.read_tsv(spark, path, "source string, doc_count bigint, token_count bigint, normalized_doc_length double")


@query("S13,A13", f"""WITH {B.TOK}, long AS (SELECT doc_id, 'raw' AS treatment, token AS term FROM tok
 UNION ALL SELECT doc_id, 'truncate5', substr(token, 1, 5) FROM tok UNION ALL SELECT doc_id, 'truncate6', substr(token, 1, 6) FROM tok)
SELECT treatment, count(*) AS token_count, count(DISTINCT lower(term)) AS word_type_count, round(count(DISTINCT lower(term)) / count(*), 6) AS type_to_token_ratio,
round(sum(length(term)) / count(*), 6) AS char_to_token_ratio FROM long GROUP BY treatment""")
def treatment_folders(spark, folder):
    path = scratch_path(spark, "treatments")
    long = treat.long_treatments(B.tokens(spark, folder), treat.column_treatments())
    corpus.write_treatments(long.select("doc_id", "pos", "treatment", "term"), path)
    back = spark.read.parquet(path)
    return B.rounded(vocab.treatment_statistics(back))


@query("S14,T4,A20", f"""WITH {topic_queries._RUN_H} SELECT 'documents' AS corpus, treatment, num_topics, run, count(*) AS topics,
round(avg(document_entropy), 5) AS document_entropy FROM run_h GROUP BY ALL""")
def run_folders(spark, folder):
    path = scratch_path(spark, "runs")
    table = topic_queries._run_entropies(spark, folder).withColumn("corpus", F.lit("documents"))
    table.write.partitionBy("corpus", "treatment", "num_topics", "run").parquet(path)
    rows = corpus.read_runs(spark, path, "topic int, document_entropy double")
    return rows.groupBy("corpus", "treatment", "num_topics", "run").agg(
        F.count("*").alias("topics"), F.round(F.avg("document_entropy"), 5).alias("document_entropy"))


@query("T4", f"""WITH {B.TOK}, {B.STATE}, {B.STATE_B} SELECT 'documents' AS corpus, 'raw' AS treatment, 10 AS num_topics, 0 AS run, topic, count(*) AS tokens FROM sa GROUP BY topic
UNION ALL SELECT 'documents', 'raw', 10, 1, topic, count(*) FROM sb GROUP BY topic""")
def stacked_runs(spark, folder):
    runs = {("documents", "raw", 10, r): topics.topic_tokens(B.state(spark, folder, with_position=r == 0)) for r in (0, 1)}
    return corpus.stack_runs(runs)
