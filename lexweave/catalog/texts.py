"""Tokens, text functions, treatments of tokens, and document splitters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.catalog import base as B
from lexweave.catalog.base import query
from lexweave.functions import patterns as P, snowball as S, text as T
from lexweave.functions.stopwords import stop_lists, stopword_table
from lexweave.operators import split, tokens as tok, treat, vocab
from lexweave.operators.keyed import lookup_join
from lexweave.plans import prepare
from lexweave.session import WHOLE_JOIN_KEYS, materialised, setting


def _tokenised(pattern):
    def run(spark, folder):
        text = F.col("text")
        return B.documents(spark, folder).select(
            "doc_id", T.count_tokens(text, pattern).alias("n_tokens"),
            T.retokenise(text, pattern).alias("tokens"))
    sql = (f"SELECT doc_id, len(a)::BIGINT AS n_tokens, array_to_string(a, ' ') AS tokens FROM "
           f"(SELECT doc_id, regexp_extract_all(text, {B.sql_text(pattern)}) AS a FROM documents)")
    return run, sql


for _id, _name in [("P1", "word"), ("P2", "letters_punct"), ("P3", "word_digits"),
                   ("P4", "keep_punct"), ("P5", "non_space"), ("P6", "non_separator")]:
    _run, _sql = _tokenised(P.TOKEN_PATTERNS[_name])
    _run.__name__ = f"tokenise_{_name}"
    query(_id, _sql)(_run)


@query("P7", f"SELECT doc_id, translate(text, {B.sql_text(P.PUNCTUATION)}, '') AS text FROM documents")
def strip_punctuation(spark, folder):
    return B.documents(spark, folder).select("doc_id", T.strip_punctuation(F.col("text")).alias("text"))


@query("P8", f"""WITH {B.TOK}, {B.sql_stop()}
SELECT d.doc_id, coalesce(s.text, '') AS stopped_text FROM documents d LEFT JOIN
(SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM tok
 WHERE lower(token) NOT IN (SELECT word FROM stop) GROUP BY doc_id) s USING (doc_id)""")
def remove_stop_words(spark, folder):
    docs = B.documents(spark, folder).select("doc_id", "text")
    words = sorted({w for words in stop_lists(B.LANGUAGES).values() for w in words})
    return tok.remove_stopwords(docs, words).select("doc_id", "stopped_text")


@query("P8", f"""WITH {B.TOK}, common AS (SELECT lower(token) AS w FROM tok GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3)
SELECT d.doc_id, coalesce(s.text, '') AS stopped_text FROM documents d LEFT JOIN
(SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM tok
 WHERE lower(token) NOT IN (SELECT w FROM common) GROUP BY doc_id) s USING (doc_id)""")
def remove_corpus_words(spark, folder):
    """The words that at least three documents share go: a stop table that grows with the corpus."""
    docs = B.documents(spark, folder).select("doc_id", "text")
    pairs = B.tokens_by_document(spark, folder).groupBy("doc_id", F.lower("token").alias("word")).agg(F.count("*").alias("n"))
    with setting(spark, WHOLE_JOIN_KEYS, "false", "true"):      # words are counted where their documents lie
        common = materialised(pairs.groupBy("word").agg(F.count("*").alias("n_docs")).filter("n_docs >= 3"), "common")
    return tok.remove_stopwords(docs, common).select("doc_id", "stopped_text")


@query("P9", f"""WITH {B.TOK}, keep AS (SELECT lower(token) AS w FROM tok GROUP BY 1 HAVING count(*) >= 5),
clean AS (SELECT doc_id, pos, lower(translate(token, {B.sql_text(P.PUNCTUATION)}, '')) AS w FROM tok)
SELECT d.doc_id, coalesce(s.text, '') AS clean_text FROM documents d LEFT JOIN
(SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS text FROM clean WHERE w IN (SELECT w FROM keep)
 GROUP BY doc_id) s USING (doc_id)""")
def keep_listed_words(spark, folder):
    docs = B.documents(spark, folder).select("doc_id", "text")
    frequent = (B.tokens(spark, folder).groupBy(F.lower("token").alias("word"))
                .agg(F.count("*").alias("n")).filter("n >= 5"))
    return tok.keep_vocabulary(docs, frequent).select("doc_id", "clean_text")


@query("P10", f"SELECT doc_id, len(regexp_extract_all(text, {B.sql_text(P.WORD)}))::BIGINT AS num_tokens FROM documents")
def count_tokens(spark, folder):
    return B.documents(spark, folder).select("doc_id", T.count_tokens(F.col("text")).alias("num_tokens"))


@query("P11", f"SELECT conv_id, turn, array_to_string(regexp_extract_all(text, {B.sql_text(P.WORD)}), ' ') AS text FROM conversations")
def retokenise_conversations(spark, folder):
    return B.load(spark, folder, "conversations").select(
        "conv_id", "turn", T.retokenise(F.col("text")).alias("text"))


@query("P12", f"""WITH {B.sql_tokens(P.KEEP_PUNCT)}, {B.sql_stop()}
SELECT doc_id, count(*) AS kept, string_agg(token, ' ' ORDER BY pos) AS tokens FROM tok
WHERE regexp_full_match(token, {B.sql_text(P.WORD)})
AND NOT EXISTS (SELECT 1 FROM stop s WHERE s.lang = tok.lang AND s.word = lower(tok.token)) GROUP BY doc_id""")
def usable_tokens(spark, folder):
    kept = tok.usable_tokens(B.tokens(spark, folder, P.KEEP_PUNCT), stop_lists(B.LANGUAGES))
    texts = tok.regroup(kept.withColumn("n", F.lit(1)), ["doc_id"], out_col="tokens")
    return texts.select("doc_id", F.size(F.split("tokens", " ")).cast("bigint").alias("kept"), "tokens")


@query("P13", f"""WITH {B.TOK}, {B.sql_stop()}
SELECT s.lang, s.word, count(t.token) AS n FROM stop s LEFT JOIN tok t
ON t.lang = s.lang AND lower(t.token) = s.word GROUP BY ALL""")
def stop_word_usage(spark, folder):
    table = stopword_table(spark, B.LANGUAGES)
    counts = B.tokens(spark, folder).groupBy("lang", F.lower("token").alias("word")).agg(
        F.count("*").alias("n"))
    return table.join(counts, ["lang", "word"], "left").select(
        "lang", "word", F.coalesce("n", F.lit(0)).alias("n"))


def _vocabulary(spark, folder):
    """Distinct tokens with their counts: expensive expressions then run once per word."""
    return B.tokens(spark, folder).groupBy("lang", "token").agg(F.count("*").alias("n"))


_WORDS = f"WITH {B.TOK}, words AS (SELECT lang, token, count(*) AS n FROM tok GROUP BY ALL) "


@query("P14", _WORDS + "SELECT lang, token, n, substr(token, 1, 5) AS truncate5, substr(token, 1, 6) AS truncate6 FROM words")
def truncate_words(spark, folder):
    token = F.col("token")
    return _vocabulary(spark, folder).select(
        "lang", "token", "n", T.truncate(token, 5).alias("truncate5"), T.truncate(token, 6).alias("truncate6"))


@query("P15", _WORDS + """SELECT lang, token, n, coalesce(nullif(trim(CASE WHEN length(token) % 4 = 0 THEN '  '
ELSE concat(' ', lower(token), ' ') END), ''), token) AS normalized FROM words""")
def lemma_or_token(spark, folder):
    token = F.col("token")
    lemma = F.when(F.length(token) % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.lower(token), F.lit(" ")))
    return _vocabulary(spark, folder).select(
        "lang", "token", "n", T.lemma_or_token(lemma, token).alias("normalized"))


@query("P16", _WORDS + """SELECT lang, token, n, CASE WHEN length(token) % 5 = 0 OR length(token) % 7 = 0 THEN token
ELSE lower(token) END AS lemma FROM words""")
def dash_lemmas(spark, folder):
    token = F.col("token")
    lemma = (F.when(F.length(token) % 5 == 0, F.lit("--")).when(F.length(token) % 7 == 0, F.lit("---"))
             .otherwise(F.lower(token)))
    return _vocabulary(spark, folder).select(
        "lang", "token", "n", T.lemma_unless_dashes(lemma, token).alias("lemma"))


@query("P17", _WORDS + "SELECT lang, token, n, concat('N,', lang, ',', right(token, 1), ',Sg') AS slot FROM words")
def morph_strings(spark, folder):
    morph = F.concat_ws(".", "lang", F.substring("token", -1, 1), F.lit("Sg"))
    return _vocabulary(spark, folder).select(
        "lang", "token", "n", T.morph_string(F.lit("N"), morph).alias("slot"))


@query("P18", _WORDS + """SELECT pos_tag, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN length(token) <= 3 THEN 'F'
WHEN length(token) <= 6 THEN 'N' ELSE 'V' END AS pos_tag, n FROM words) GROUP BY pos_tag""")
def pos_tags(spark, folder):
    slot = B.slot_of(F.col("token"), F.col("lang"))
    mixed = F.when(F.length("token") % 2 == 0, F.regexp_replace(slot, "^([^,]*),", "$1=")).otherwise(slot)
    return (_vocabulary(spark, folder).select("n", T.pos_tag(mixed).alias("pos_tag"))
            .groupBy("pos_tag").agg(F.sum("n").alias("n")))


@query("P19", _WORDS + "SELECT lang, token AS surface, n FROM words")
def drop_stress_marks(spark, folder):
    token = F.col("token")
    marked = F.concat(F.substring(token, 1, 1), F.lit("`"), F.substring(token, 2, 1 << 20))
    return _vocabulary(spark, folder).select("lang", T.drop_stress(marked).alias("surface"), "n")


@query("P20", f"""WITH {B.TOK} SELECT term, string_agg(lemma, '|' ORDER BY lemma) AS lemmas FROM
(SELECT DISTINCT substr(lower(token), 1, 6) AS term, lower(token) AS lemma FROM tok) GROUP BY term""")
def join_ambiguous_lemmas(spark, folder):
    forms = (B.tokens(spark, folder)
             .select(F.substring(F.lower("token"), 1, 6).alias("term"), F.lower("token").alias("lemma")).distinct())
    return forms.groupBy("term").agg(T.join_analyses(F.array_sort(F.collect_list("lemma"))).alias("lemmas"))


@query("P21", _WORDS + "SELECT lower(token) AS term, sum(n)::BIGINT AS n FROM words GROUP BY 1")
def downcase_words(spark, folder):
    return (_vocabulary(spark, folder).groupBy(T.downcase(F.col("token")).alias("term"))
            .agg(F.sum("n").alias("n")))


@query("P22", """SELECT d.doc_id, d.source, d.lang FROM documents d WHERE d.source IN ('src1', 'src2', 'src3')
AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def select_genres(spark, folder):
    docs = B.load(spark, folder, "documents").filter(F.col("source").isin("src1", "src2", "src3"))
    good = B.load(spark, folder, "labels").filter("quality = 1").select("doc_id")
    return docs.select("doc_id", "source", "lang").join(good, "doc_id", "left_semi")


@query("P23", f"""WITH {B.TOK}, {B.sql_stop()}, kept AS (SELECT doc_id FROM tok WHERE
NOT EXISTS (SELECT 1 FROM stop s WHERE s.lang = tok.lang AND s.word = lower(tok.token)))
SELECT doc_id, count(*) AS n_kept FROM kept GROUP BY doc_id HAVING count(*) >= 100""")
def long_documents(spark, folder):
    kept = tok.usable_tokens(B.tokens(spark, folder), stop_lists(B.LANGUAGES))
    return tok.long_documents(kept, 100).groupBy("doc_id").agg(F.count("*").alias("n_kept"))


@query("P25", _WORDS + """, lexicon AS (SELECT DISTINCT lang, token, substr(lower(token), 1, 5) AS lemma
FROM words WHERE length(token) > 3)
SELECT w.lang, coalesce(x.lemma, w.token) AS normalized, sum(w.n)::BIGINT AS n
FROM words w LEFT JOIN lexicon x USING (lang, token) GROUP BY ALL""")
def lexicon_lemmas(spark, folder):
    running = B.tokens(spark, folder)
    lexicon = (running.filter(F.length("token") > 3).select("lang", "token").distinct()
               .withColumn("lemma", B.lemma_of(F.col("token"))))
    lemmas = treat.lexicon_lemmas(running, lexicon, ["lang", "token"], spread_by=["doc_id", "pos"])
    return lemmas.groupBy("lang", "normalized").agg(F.count("*").alias("n"))


_V = "aeiouyäöü"


def _sql_stems(words: str) -> str:
    """CTEs that stem the ``token`` column of table ``words`` into ``stems(token, stem)``.

    RE2 has no look-ahead, so the u/y step works on a text with every letter written twice: a match
    uses up one copy of its neighbours and leaves the other to the next match.
    """
    cut = "substr(w, 1, length(w) - length(s){})"
    return f"""g0 AS (SELECT DISTINCT token, replace(lower(token), 'ß', 'ss') AS w FROM {words}),
g1 AS (SELECT token, replace(replace(regexp_replace(regexp_replace(regexp_replace(w, '(.)', '\\1¦\\1¬', 'g'),
 '([{_V}])¬([uy])¦[uy]¬([{_V}])¦', '\\1¬¤\\2¦\\2¬\\3¦', 'g'), '(.)¦.¬', '\\1', 'g'), '¤u', 'U'), '¤y', 'Y') AS w FROM g0),
g2 AS (SELECT token, w, regexp_extract(w, '^.*?[{_V}][^{_V}]') AS a, regexp_extract(w, '^.*?[{_V}][^{_V}].*?[{_V}][^{_V}]') AS b FROM g1),
g3 AS (SELECT token, w, least(greatest(CASE WHEN a = '' THEN length(w) ELSE length(a) END, 3), length(w)) AS p1,
 CASE WHEN b = '' THEN length(w) ELSE length(b) END AS p2 FROM g2),
g4 AS (SELECT *, regexp_extract(substr(w, p1 + 1), '(?:ern|em|er|en|es|e|s)$') AS s FROM g3),
g5 AS (SELECT token, p1, p2, CASE WHEN s IN ('en', 'es', 'e') AND regexp_matches(w, 'niss(?:en|es|e)$') THEN {cut.format(' - 1')}
 WHEN s = 's' AND NOT regexp_matches(w, '[bdfghklmnrt]s$') THEN w ELSE {cut.format('')} END AS w FROM g4),
g6 AS (SELECT *, regexp_extract(substr(w, p1 + 1), '(?:est|en|er|st)$') AS s FROM g5),
g7 AS (SELECT token, p1, p2, CASE WHEN s = 'st' AND NOT regexp_matches(w, '^.{{3,}}[bdfghklmnt]st$') THEN w ELSE {cut.format('')} END AS w FROM g6),
g8 AS (SELECT *, substr(w, p2 + 1) AS r, regexp_extract(substr(w, p2 + 1), '(?:isch|lich|heit|keit|end|ung|ig|ik)$') AS s FROM g7),
g9 AS (SELECT token, CASE WHEN s IN ('end', 'ung') AND regexp_matches(r, '(?:^|[^e])ig(?:end|ung)$') THEN {cut.format(' - 2')}
 WHEN s IN ('ig', 'ik', 'isch') AND regexp_matches(r, 'e(?:ig|ik|isch)$') THEN w
 WHEN s IN ('lich', 'heit') AND regexp_matches(substr(w, p1 + 1), '(?:er|en)(?:lich|heit)$') THEN {cut.format(' - 2')}
 WHEN s = 'keit' AND regexp_matches(r, 'lichkeit$') THEN {cut.format(' - 4')}
 WHEN s = 'keit' AND regexp_matches(r, 'igkeit$') THEN {cut.format(' - 2')} ELSE {cut.format('')} END AS w FROM g8),
stems AS (SELECT token, translate(w, 'äöüUY', 'aouuy') AS stem FROM g9)"""


@query("P26", f"""WITH {B.TOK}, {_sql_stems('tok')} SELECT token, stem AS normalized, count(*) AS n
FROM tok JOIN stems USING (token) GROUP BY ALL""")
def snowball_vocabulary(spark, folder):
    words = B.tokens(spark, folder).groupBy("token").agg(F.count("*").alias("n"))
    return treat.snowball_words(words, "de").select("token", "normalized", "n")


@query("P26", f"""WITH {B.TOK}, {_sql_stems('tok')} SELECT source, stem AS normalized, count(*) AS n
FROM tok JOIN stems USING (token) GROUP BY ALL""")
def snowball_tokens(spark, folder):
    stemmed = treat.stem_vocabulary(B.tokens(spark, folder), "de", spread_by=["doc_id", "pos"])
    return stemmed.groupBy("source", "normalized").agg(F.count("*").alias("n"))


# the corpus is in Latin script: its words written letter by letter in Cyrillic are the Russian stemmer's input
_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyzé", "абцдефгхийклмнопярстувшьызё"


def _sql_russian_stems(words: str) -> str:
    """CTEs that stem the ``token`` column of table ``words`` into ``russian(token, stem)``."""
    v, gerund = S.RUSSIAN_VOWELS, f"(?:{S.RUSSIAN_GERUND})$"
    adjectival = f"(?:{S.RUSSIAN_PARTICIPLE})?(?:{S.RUSSIAN_ADJECTIVE})$"
    verb = f"(?:([ая])(?:{S.RUSSIAN_VERB_AFTER_A})|(?:{S.RUSSIAN_VERB}))$"
    return f"""r0 AS (SELECT DISTINCT token, replace(lower(token), 'ё', 'е') AS w FROM {words}),
r1 AS (SELECT token, w, regexp_extract(w, '^.*?[{v}]') AS head, regexp_extract(w, '^.*?[{v}][^{v}].*?[{v}][^{v}]') AS b FROM r0),
r2 AS (SELECT token, CASE WHEN head = '' THEN w ELSE head END AS head, CASE WHEN head = '' THEN '' ELSE substr(w, length(head) + 1) END AS r,
 CASE WHEN b = '' THEN length(w) ELSE length(b) END AS p2 FROM r1),
r3 AS (SELECT *, regexp_replace(r, '(?:{S.RUSSIAN_REFLEXIVE})$', '') AS bare FROM r2),
r4 AS (SELECT token, head, p2, regexp_replace(CASE WHEN regexp_matches(r, '{gerund}') THEN regexp_replace(r, '{gerund}', '\\1')
 WHEN regexp_matches(bare, '{adjectival}') THEN regexp_replace(bare, '{adjectival}', '\\1')
 WHEN regexp_matches(bare, '{verb}') THEN regexp_replace(bare, '{verb}', '\\1')
 ELSE regexp_replace(bare, '(?:{S.RUSSIAN_NOUN})$', '') END, 'и$', '') AS r FROM r3),
r5 AS (SELECT token, head, CASE WHEN regexp_matches(substr(head || r, p2 + 1), 'ость?$') THEN regexp_replace(r, 'ость?$', '') ELSE r END AS r FROM r4),
r6 AS (SELECT token, head, CASE WHEN regexp_matches(r, 'ейше?$') THEN regexp_replace(regexp_replace(r, 'ейше?$', ''), 'нн$', 'н')
 WHEN regexp_matches(r, 'нн$') THEN regexp_replace(r, 'нн$', 'н') ELSE regexp_replace(r, 'ь$', '') END AS r FROM r5),
russian AS (SELECT token, CASE WHEN regexp_matches(token, '\\p{{Cyrillic}}') THEN head || r ELSE token END AS stem FROM r6)"""


@query("P26", f"""WITH {B.TOK}, written AS (SELECT source, translate(lower(token), '{_LATIN}', '{_CYRILLIC}') AS token FROM tok),
{_sql_russian_stems('written')} SELECT source, stem AS normalized, count(*) AS n FROM written JOIN russian USING (token) GROUP BY ALL""")
def russian_snowball_tokens(spark, folder):
    written = B.tokens(spark, folder).select(
        "doc_id", "pos", "source", F.translate(F.lower("token"), _LATIN, _CYRILLIC).alias("token"))
    stemmed = treat.stem_vocabulary(written, "ru", spread_by=["doc_id", "pos"])
    return stemmed.groupBy("source", "normalized").agg(F.count("*").alias("n"))


_CONFIG = [("de", "raw"), ("de", "truncate5"), ("de", "truncate6"), ("fr", "raw"), ("fr", "truncate5"), ("es", "raw"), ("en", "raw"), ("en", "truncate6")]


@query("P27", f"""WITH {B.TOK}, config(lang, treatment) AS (VALUES {', '.join(str(c) for c in _CONFIG)})
SELECT lang, treatment, count(*) AS tokens, count(DISTINCT term) AS types FROM
(SELECT lang, treatment, CASE treatment WHEN 'raw' THEN token WHEN 'truncate5' THEN substr(token, 1, 5)
 ELSE substr(token, 1, 6) END AS term FROM tok JOIN config USING (lang)) GROUP BY ALL""")
def treatments_by_language(spark, folder):
    config = spark.createDataFrame(_CONFIG, "lang string, treatment string")
    words = _vocabulary(spark, folder)
    rows = treat.long_treatments(words, treat.column_treatments()).join(
        F.broadcast(config), ["lang", "treatment"])  # the fixed configuration table
    types = rows.groupBy("lang", "treatment", "term").agg(F.sum("n").alias("n"))
    return types.groupBy("lang", "treatment").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))


@query("P28", f"""SELECT doc_id, source, array_to_string(list_transform(
regexp_extract_all(text, {B.sql_text(P.WORD)}), lambda t: substr(t, 1, 6)), ' ') AS text FROM documents""")
def normalise_column_text(spark, folder):
    docs = B.documents(spark, folder).select("doc_id", "source", "text")
    return treat.normalise_column(docs, "text", "source", treat.truncation(6))[0]


@query("P28,A10", f"""WITH {B.TOK} SELECT source AS author, lower(token) AS token, lower(substr(token, 1, 6)) AS normalized,
count(*) AS count FROM tok GROUP BY 1, 2, 3""")
def normalise_column_counts(spark, folder):
    docs = B.documents(spark, folder).select("doc_id", "source", "text")
    return treat.normalise_column(docs, "text", "source", treat.truncation(6))[1]


@query("P28,A10", f"""WITH {B.TOK}, {_sql_stems('tok')} SELECT source AS author, lower(token) AS token, lower(stem) AS normalized, count(*) AS count
FROM tok JOIN stems USING (token) WHERE trim(stem) <> '' GROUP BY source, lower(token), lower(stem)""")
def snowball_column_counts(spark, folder):
    docs = B.documents(spark, folder).select("doc_id", "source", "text")
    return treat.snowball_column(docs, "text", "source", "doc_id", "de")[1]


@query("P28", f"""WITH {B.TOK}, {_sql_stems('tok')}, texts AS (SELECT doc_id, string_agg(stem, ' ' ORDER BY pos) AS text
FROM tok JOIN stems USING (token) WHERE trim(stem) <> '' GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(t.text, '') AS text FROM documents d LEFT JOIN texts t USING (doc_id)
WHERE d.text IS NOT NULL AND d.source IS NOT NULL""")
def snowball_column_text(spark, folder):
    docs = B.documents(spark, folder).select("doc_id", "source", "text")
    return treat.snowball_column(docs, "text", "source", "doc_id", "de")[0]


@query("P29", _WORDS + "SELECT token, substr(token, 1, 5) AS normalized, sum(n)::BIGINT AS n FROM words GROUP BY ALL")
def token_normal_pairs(spark, folder):
    pairs = B.documents(spark, folder).select(
        F.inline(T.token_pairs(F.col("text"), treat.truncation(5))))
    return pairs.groupBy("token", "normalized").agg(F.count("*").alias("n"))


# --- splitters -----------------------------------------------------------------------------

def _split(spark, folder, how, text=None, **kw):
    docs = B.documents(spark, folder).select("doc_id", F.col("source").alias("label"), (text if text is not None else F.col("text")).alias("text"))
    return split.split_documents(docs, how, **kw)


@query("D1,D4", f"""WITH {B.sql_tokens(P.NON_SPACE)}
SELECT concat(doc_id, '_', pos // 500) AS doc_id, source AS label, string_agg(token, ' ' ORDER BY pos) AS text
FROM tok GROUP BY tok.doc_id, tok.pos // 500, source""")
def split_by_word_count(spark, folder):
    return _split(spark, folder, "word_count", word_count=500)


_LINES = """lines AS (SELECT doc_id, source, unnest(range(len(a))) AS i, unnest(a) AS line
FROM (SELECT doc_id, source, string_split({text}, chr(10)) AS a FROM documents))"""
_BLANK = f"regexp_full_match(line, {B.sql_text(P.BLANK + '*')})"
_DOUBLED = "replace(text, chr(10), chr(10) || chr(10))"


@query("D2,D4", f"""WITH {_LINES.format(text=_DOUBLED)},
grouped AS (SELECT *, sum(CASE WHEN {_BLANK} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM lines),
passages AS (SELECT doc_id, source, g, string_agg(array_to_string(regexp_extract_all(line, {B.sql_text(P.NON_SPACE)}), ' '), ' ' ORDER BY i) AS text
 FROM grouped WHERE NOT {_BLANK} GROUP BY doc_id, source, g
 UNION ALL SELECT doc_id, source, 1000000000, '' FROM documents WHERE text = '' OR text LIKE '%' || chr(10))
SELECT concat(doc_id, '_', row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1) AS doc_id, source AS label, text FROM passages""")
def split_at_blank_lines(spark, folder):
    return _split(spark, folder, "line_break", F.replace("text", F.lit("\n"), F.lit("\n\n")))


@query("D3,D4", f"""WITH RECURSIVE {_LINES.format(text='text')},
sized AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, a, len(a) AS n FROM
 (SELECT doc_id, source, i, regexp_extract_all(line, {B.sql_text(P.NON_SPACE)}) AS a FROM lines WHERE NOT {_BLANK})),
walk AS (SELECT doc_id, i, 0 AS g, 1 AS rows, n AS words FROM sized WHERE i = 1
 UNION ALL SELECT s.doc_id, s.i, CASE WHEN w.rows >= 3 AND w.words >= 60 THEN w.g + 1 ELSE w.g END,
 CASE WHEN w.rows >= 3 AND w.words >= 60 THEN 1 ELSE w.rows + 1 END,
 CASE WHEN w.rows >= 3 AND w.words >= 60 THEN s.n ELSE w.words + s.n END
 FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.i = w.i + 1)
SELECT concat(s.doc_id, '_', w.g) AS doc_id, s.source AS label, string_agg(array_to_string(s.a, ' '), ' ' ORDER BY s.i) AS text
FROM sized s JOIN walk w ON w.doc_id = s.doc_id AND w.i = s.i GROUP BY s.doc_id, w.g, s.source""")
def split_by_line_count(spark, folder):
    return _split(spark, folder, "line_count", line_count=3, word_count=60)


# --- corpus preparation ---------------------------------------------------------------------

_PREPARED = f"""{B.TOK}, {B.sql_stop()}, usable AS (SELECT doc_id, pos, token FROM tok WHERE
NOT EXISTS (SELECT 1 FROM stop s WHERE s.lang = tok.lang AND s.word = lower(tok.token))),
prepared AS (SELECT * FROM usable WHERE doc_id IN (SELECT doc_id FROM usable GROUP BY doc_id HAVING count(*) >= 100))"""


def _prepared_documents(spark, folder):
    docs = B.documents(spark, folder).select("doc_id", "lang", "text")
    return prepare.prepare_documents(docs, stop_lists(B.LANGUAGES))


def _prepare(spark, folder):
    return prepare.prepare_corpus(B.tokens(spark, folder), stop_lists(B.LANGUAGES))


@query("S13,P12,P14,P23", f"""WITH {_PREPARED}
SELECT treatment, doc_id, string_agg(term, ' ' ORDER BY pos) AS text FROM (
 SELECT 'raw' AS treatment, doc_id, pos, token AS term FROM prepared
 UNION ALL SELECT 'truncate5', doc_id, pos, substr(token, 1, 5) FROM prepared
 UNION ALL SELECT 'truncate6', doc_id, pos, substr(token, 1, 6) FROM prepared) GROUP BY 1, 2""")
def prepare_treated_documents(spark, folder):
    texts = prepare.document_texts(_prepared_documents(spark, folder), treat.column_treatments())
    return texts.select("treatment", "doc_id", "text")


@query("S13,P12,P14,P23", f"""WITH {_PREPARED}
SELECT treatment, doc_id, string_agg(term, ' ' ORDER BY pos) AS text FROM (
 SELECT 'raw' AS treatment, doc_id, pos, token AS term FROM prepared
 UNION ALL SELECT 'truncate5', doc_id, pos, substr(token, 1, 5) FROM prepared
 UNION ALL SELECT 'truncate6', doc_id, pos, substr(token, 1, 6) FROM prepared) GROUP BY 1, 2""")
def prepare_treated_tokens(spark, folder):
    """The same from a token table, as an annotated corpus gives it."""
    return prepare.treatment_texts(_prepare(spark, folder).tokens, ["raw", "truncate5", "truncate6"])


@query("A15", f"""WITH {_PREPARED}, sizes AS (SELECT t.doc_id, t.n AS n_all, coalesce(u.n, 0) AS n_kept FROM
 (SELECT doc_id, count(*) AS n FROM tok GROUP BY 1) t LEFT JOIN (SELECT doc_id, count(*) AS n FROM usable GROUP BY 1) u USING (doc_id))
SELECT count(*) AS documents_read, sum((n_kept >= 100)::INT)::BIGINT AS documents_written, sum(n_all)::BIGINT AS tokens_read,
sum(n_kept)::BIGINT AS tokens_after_stopping, sum(CASE WHEN n_kept >= 100 THEN n_kept ELSE 0 END)::BIGINT AS tokens_written FROM sizes""")
def prepared_corpus_sizes(spark, folder):
    return _prepare(spark, folder).sizes


@query("A13,M17,P1,P12,P14", f"""WITH {_PREPARED}, long AS (
 SELECT 'raw' AS treatment, token AS term FROM prepared UNION ALL SELECT 'truncate5', substr(token, 1, 5) FROM prepared
 UNION ALL SELECT 'truncate6', substr(token, 1, 6) FROM prepared)
SELECT treatment, count(*) AS token_count, count(DISTINCT lower(term)) AS word_type_count,
round(count(DISTINCT lower(term)) / count(*), 6) AS type_to_token_ratio, round(sum(length(term)) / count(*), 6) AS char_to_token_ratio
FROM long GROUP BY treatment""")
def treatment_statistics(spark, folder):
    """Tokens, types and conflation strength per treatment of the prepared corpus."""
    words = prepare.document_tokens(_prepared_documents(spark, folder)).groupBy("token").agg(F.count("*").alias("n"))
    long = treat.long_treatments(words, treat.column_treatments())
    return B.rounded(vocab.treatment_statistics(long, count_col="n"))


@query("A13,M17,P26", f"""WITH {B.TOK}, {_sql_stems('tok')}, long AS (SELECT 'raw' AS treatment, token AS term FROM tok
UNION ALL SELECT 'snowball', CASE WHEN trim(stem) = '' THEN token ELSE trim(stem) END FROM tok JOIN stems USING (token))
SELECT treatment, count(*) AS token_count, count(DISTINCT lower(term)) AS word_type_count,
round(count(DISTINCT lower(term)) / count(*), 6) AS type_to_token_ratio, round(sum(length(term)) / count(*), 6) AS char_to_token_ratio
FROM long GROUP BY treatment""")
def treatment_statistics_snowball(spark, folder):
    """Adds the Snowball treatment, stemmed once per distinct word."""
    words = B.tokens(spark, folder).groupBy("token").agg(F.count("*").alias("n"))
    rows = treat.snowball_words(words, "de", out_col="stem").select(
        "n", F.inline(F.array(
            F.struct(F.lit("raw").alias("treatment"), F.col("token").alias("term")),
            F.struct(F.lit("snowball").alias("treatment"), T.lemma_or_token(F.col("stem"), F.col("token")).alias("term")))))
    return B.rounded(vocab.treatment_statistics(rows, count_col="n"))


@query("A25", f"""WITH {B.TOK}, long AS (SELECT doc_id, 'raw' AS treatment, token AS term FROM tok
 UNION ALL SELECT doc_id, 'truncate5', substr(token, 1, 5) FROM tok UNION ALL SELECT doc_id, 'truncate6', substr(token, 1, 6) FROM tok),
sizes AS (SELECT doc_id, treatment, count(*) AS n FROM long GROUP BY ALL),
docs AS (SELECT doc_id, count(*) AS treatments, min(n) AS lo, max(n) AS hi FROM sizes GROUP BY doc_id),
pair_sums AS (SELECT normalized, sum(n) AS n FROM (SELECT token, substr(token, 1, 5) AS normalized, count(*) AS n FROM tok GROUP BY ALL) GROUP BY 1),
terms AS (SELECT term AS normalized, count(*) AS n FROM long WHERE treatment = 'truncate5' GROUP BY 1)
SELECT 'length differs between treatments' AS check_name, count(*) AS violations FROM docs WHERE lo <> hi
UNION ALL SELECT 'pair counts differ from term counts', count(*) FROM pair_sums p FULL JOIN terms t USING (normalized) WHERE p.n IS DISTINCT FROM t.n
UNION ALL SELECT 'document missing under a treatment', count(*) FROM docs WHERE treatments <> 3""")
def consistency_checks(spark, folder):
    tokens = B.tokens(spark, folder)
    treatments = treat.column_treatments()
    long = treat.long_treatments(tokens, treatments)
    violations = prepare.length_violations(long, len(treatments))
    words = tokens.groupBy("token").agg(F.count("*").alias("pair_count")).withColumn(
        "normalized", F.substring("token", 1, 5))
    terms = (tokens.groupBy(F.substring("token", 1, 5).alias("normalized"))
             .agg(F.count("*").alias("term_freq")))
    sums = words.groupBy("normalized").agg(F.sum("pair_count").alias("pair_sum"))
    differing = sums.join(terms, "normalized", "full_outer").filter(
        ~F.col("pair_sum").eqNullSafe(F.col("term_freq")))
    checks = [
        ("length differs between treatments", violations.filter("shortest != longest")),
        ("pair counts differ from term counts", differing),
        ("document missing under a treatment", violations.filter(F.col("treatments") != len(treatments))),
    ]
    return treat.stack([
        df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
        for name, df in checks])
