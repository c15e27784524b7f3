"""Tokens, text functions, stop words and treatments on literal cases."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import patterns as P, text as T
from lexweave.functions.stopwords import RUSSIAN_EXTRAS, stop_lists, stopword_table, stopwords
from lexweave.operators.keyed import lookup_join
from lexweave.operators import authors, tokens as tok, treat, vocab
from lexweave.plans import prepare

FAIR = ("--  Паничи! паничи! сюды! сюды! -- говорили они со всех сторон. -- Ось бублики, мак овники, "
        "вертычки, буханци хороши! ей-богу, хороши! на меду! сама пекла! 01234.2345, example@example.ru")
WORDS = ("Паничи паничи сюды сюды говорили они со всех сторон Ось бублики мак овники вертычки буханци "
         "хороши ей-богу хороши на меду сама пекла example@example.ru").split()

EVENING = ("Однажды весною, в час небывало жаркого заката, в Москве, на Патриарших прудах, появились два "
           "гражданина. Первый из них, одетый в летнюю серенькую пару, был маленького роста, упитан, лыс, "
           "свою приличную шляпу пирожком нес в руке")
STEMS = ("однажд весн в час небыва жарк закат в москв на патриарш пруд появ два гражданин перв из них одет в "
         "летн сереньк пар был маленьк рост упита лыс сво приличн шляп пирожк нес в рук").split()
FIRST_SIX = ("Однажд весною в час небыва жарког заката в Москве на Патриа прудах появил два гражда Первый из них "
             "одетый в летнюю серень пару был малень роста упитан лыс свою прилич шляпу пирожк нес в руке").split()

# published sample of the German algorithm
GERMAN = {
    "aufeinanderfolge": "aufeinanderfolg", "aufeinanderfolgenden": "aufeinanderfolg", "auffallen": "auffall",
    "aufgeschlossen": "aufgeschloss", "aufgeregtesten": "aufgeregt", "häuser": "haus", "kategorischen": "kategor",
    "kategorie": "kategori", "jugendlichkeit": "jugend", "erkenntnisse": "erkenntnis", "abenteuer": "abenteu",
    "straße": "strass", "käufer": "kauf", "freundlichkeit": "freundlich", "Hoffnungen": "hoffnung",
    "Übungen": "ubung", "mayer": "may", "es": "es", "bayuan": "bayuan", "ayuer": "ayu",
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def tokenise(spark, text, pattern):
    return one(spark, T.tokenise(F.lit(text), pattern))


def test_word_pattern(spark):
    assert tokenise(spark, FAIR, P.WORD) == WORDS


def test_letters_and_punctuation_pattern_needs_three_characters(spark):
    assert tokenise(spark, FAIR, P.LETTERS_PUNCT) == [w for w in WORDS if w not in ("со", "на")]


def test_punctuation_tokens_are_kept(spark):
    got = tokenise(spark, FAIR, P.KEEP_PUNCT)
    assert got[:8] == ["-", "-", "Паничи", "!", "паничи", "!", "сюды", "!"]
    assert got[-3:] == ["01234.2345", ",", "example@example.ru"]
    assert [t for t in got if len(t) > 1] == [*WORDS[:-1], "01234.2345", WORDS[-1]]


def test_digits_and_white_space_patterns(spark):
    assert tokenise(spark, "a1 2b. 3", P.WORD_DIGITS) == ["a1", "2b", "3"]
    assert tokenise(spark, "a b\tc d\n\x85e", P.NON_SPACE) == list("abcde")
    assert tokenise(spark, "a\tb c", P.NON_SEPARATOR) == ["a\tb", "c"]


def test_column_functions(spark):
    lit = F.lit
    assert one(spark, T.strip_punctuation(lit("«Ей-богу», сказал – он!"))) == "Ей-богу сказал  он"
    assert one(spark, T.lemma_or_token(lit("  "), lit("Tok"))) == "Tok"
    assert one(spark, T.lemma_or_token(lit(" lem "), lit("Tok"))) == "lem"
    assert one(spark, T.lemma_unless_dashes(lit("---"), lit("Tok"))) == "Tok"
    assert one(spark, T.lemma_unless_dashes(lit("-a"), lit("Tok"))) == "-a"
    assert one(spark, T.morph_string(lit("ADJA"), lit("Pos.Nom.Sg.Masc"))) == "ADJA,Pos,Nom,Sg,Masc"
    assert one(spark, T.pos_tag(lit("A=n,sg,brev"))) == "A"
    assert one(spark, T.pos_tag(lit("V,ipf,tran=f,sg|S,m"))) == "V"
    assert one(spark, T.drop_stress(lit("за`мок"))) == "замок"
    assert one(spark, T.is_word(lit("ab1"))) is False
    assert one(spark, T.is_word(lit("e-mail"))) is True
    assert one(spark, T.count_tokens(lit("a b, c"))) == 3


def test_stop_lists(spark):
    assert stopwords("xx") == []
    assert set(RUSSIAN_EXTRAS) <= set(stopwords("Russian")) == set(stopwords("ru"))
    assert len(RUSSIAN_EXTRAS) == 36
    assert stopword_table(spark, ["de", "xx"]).select("lang").distinct().collect()[0]["lang"] == "de"


def test_stop_and_keep_words_agree_between_lists_and_tables(spark):
    # repeated ids, repeated texts, a null id, a null text and an empty one
    docs = spark.createDataFrame(
        [(1, "The cat, the DOG and e-mail"), (2, "the the"), (3, ""), (1, "and another cat"), (None, "dog the dog"),
         (4, None), (5, "The cat, the DOG and e-mail")], "doc_id bigint, text string")
    stop, keep = ["the", "and"], ["cat", "e-mail", "dog"]

    def both(form):
        return (sorted(tok.remove_stopwords(docs, form(stop)).select("doc_id", "stopped_text").collect(), key=str),
                sorted(tok.keep_vocabulary(docs, form(keep)).select("doc_id", "clean_text").collect(), key=str))

    listed = both(lambda words: words)
    assert sorted(r[1] for r in listed[0]) == ["", "", "", "another cat", "cat DOG e-mail", "cat DOG e-mail", "dog dog"]
    assert sorted(r[1] for r in listed[1]) == ["", "", "", "cat", "cat dog e-mail", "cat dog e-mail", "dog dog"]
    table = lambda words: spark.createDataFrame([(w,) for w in [*words, words[0], None]], "word string")
    assert both(table) == listed


def test_word_tables_of_any_size(spark):
    words = spark.range(100_000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    letters = words.select(F.translate("word", "0123456789", "abcdefghij").alias("word"))
    docs = spark.createDataFrame([(1, "wa keep wjjjjj wbaaaaa Wb"), (2, "keep")], "doc_id int, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for bytes_ in (limit, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bytes_)
        try:
            stopped = {r["doc_id"]: r["stopped_text"] for r in tok.remove_stopwords(docs, letters).collect()}
            kept = {r["doc_id"]: r["clean_text"] for r in tok.keep_vocabulary(docs, letters).collect()}
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        assert stopped == {1: "keep wbaaaaa", 2: "keep"} and kept == {1: "wa wjjjjj wb", 2: ""}


@pytest.mark.parametrize("form", ["lists", "table"])
def test_usable_tokens_test_the_whole_token(spark, form):
    stop = stop_lists(["de", "en"]) if form == "lists" else stopword_table(spark, ["de", "en"])
    rows = [(i, "de", t) for i, t in enumerate(["und", "Und", "Haus", "x1", "!", "Haus-Tür", "the"])] + [(9, None, "und")]
    tokens = spark.createDataFrame(rows, "pos int, lang string, token string")
    kept = tok.usable_tokens(tokens, stop)
    assert [r["token"] for r in kept.orderBy("pos").collect()] == ["Haus", "Haus-Tür", "the", "und"]


def test_prepared_documents_agree_between_lists_and_tables(spark):
    docs = spark.createDataFrame(
        [(1, "de", "und das Haus steht"), (1, "en", "und the house stands"), (2, "de", "und das Haus steht"),
         (3, None, "und das Haus"), (4, "de", "und"), (5, "de", None), (6, "en", "")], "doc_id int, lang string, text string")

    def rows(stop):
        return sorted(prepare.prepare_documents(docs, stop, min_tokens=2).collect(), key=str)

    listed = rows(stop_lists(["de", "en"]))
    assert rows(stopword_table(spark, ["de", "en"])) == listed
    assert sorted((r["doc_id"], len(r["words"])) for r in listed) == [(1, 2), (1, 3), (2, 2), (3, 3)]


def test_russian_stems(spark):
    words = tokenise(spark, EVENING, P.WORD)
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, token string")
    got = treat.snowball_words(df, "russian").orderBy("i").collect()
    assert [r["normalized"] for r in got] == STEMS
    latin = treat.snowball_words(spark.createDataFrame([("Houses",)], "token string"), "ru").first()
    assert latin["normalized"] == "Houses"


def test_german_stems(spark):
    df = spark.createDataFrame([(w,) for w in GERMAN], "token string")
    got = {r["token"]: r["normalized"] for r in treat.snowball_words(df, "de").collect()}
    assert got == GERMAN


def test_truncation(spark):
    got = one(spark, F.transform(T.tokenise(F.lit(EVENING)), treat.truncation(6)))
    assert got == FIRST_SIX


def test_filter_on_stems_stays_above_the_vocabulary(spark):
    tokens = spark.createDataFrame([(1, 0, "Häuser")], "doc_id bigint, pos int, token string")
    stems = treat.snowball_words(tokens.select("token").distinct(), "de").filter("trim(normalized) != ''")
    plan = stems._jdf.queryExecution().optimizedPlan().toString()
    generate, aggregate = plan.index("Generate"), plan.index("Aggregate")
    assert generate < aggregate
    assert "regexp_extract" not in plan[aggregate:]


def test_stemming_by_vocabulary_equals_stemming_each_token(spark):
    rows = [(d, p, w) for d in range(3) for p, w in enumerate(GERMAN)]
    tokens = spark.createDataFrame(rows, "doc_id bigint, pos int, token string")
    joined = treat.stem_vocabulary(tokens, "de").select("doc_id", "pos", "normalized")
    direct = treat.snowball_words(tokens, "de").select("doc_id", "pos", "normalized")
    assert sorted(joined.collect()) == sorted(direct.collect())


def test_language_treatments():
    assert treat.language_treatments("Russian") == ["pymystem3", "stanza", "snowball"]
    assert len(treat.language_treatments("de")) == 3
    with pytest.raises(ValueError):
        treat.language_treatments("en")


def test_treatments_by_name(spark):
    tokens = spark.createDataFrame([(0, "Häuser"), (1, "ging")], "pos int, token string")
    lexicon = spark.createDataFrame([("ging", "gehen")], "token string, lemma string")

    def run(name, **kw):
        rows = treat.apply_treatment(tokens, name, "de", **kw).orderBy("pos").collect()
        return [r["normalized"] for r in rows]

    assert run("raw") == ["Häuser", "ging"]
    assert run("truncate") == ["Häuse", "ging"] and run("truncate3") == ["Häu", "gin"]
    assert run("snowball") == ["haus", "ging"]
    assert run("stanza", lexicons={"stanza": lexicon}) == ["Häuser", "gehen"]
    for name in ("stanza", "porter"):
        with pytest.raises(ValueError):
            run(name)


def test_lexicon_lemmas_never_multiply_tokens(spark):
    text = "Wikipedia ist ein Projekt aus freien Inhalten"
    tokens = spark.createDataFrame([(i, w) for i, w in enumerate(text.split())], "pos int, token string")
    lexicon = spark.createDataFrame(
        [("ist", "sein"), ("freien", "frei"), ("freien", "freie"), ("Inhalten", "Inhalt"), ("aus", " ")],
        "token string, lemma string")
    got = treat.lexicon_lemmas(tokens, lexicon, ["token"]).orderBy("pos").collect()
    assert [r["normalized"] for r in got] == "Wikipedia sein ein Projekt aus frei Inhalt".split()


def test_pair_counts_by_author_are_downcased(spark):
    rows = [("Bulgakov", "жаркого", "жаркий"), ("Bulgakov", "Москве", "Москва")] * 2 + [
        ("Tolstoy", "жаркого", "жаркий"), ("Tolstoy", "Москве", "Москва")]
    pairs = spark.createDataFrame(rows, "author string, token string, normalized string")
    got = {(r["author"], r["token"], r["normalized"]): r["count"] for r in authors.author_pair_counts(pairs).collect()}
    assert got == {("Bulgakov", "жаркого", "жаркий"): 2, ("Bulgakov", "москве", "москва"): 2,
                   ("Tolstoy", "жаркого", "жаркий"): 1, ("Tolstoy", "москве", "москва"): 1}


def test_author_matrix_is_zero_filled(spark):
    rows = [("b", "x", 2), ("a", "y", 1)]
    wide = authors.author_word_matrix(spark.createDataFrame(rows, "author string, token string, count bigint"))
    assert wide.columns == ["token", "a", "b"]
    assert sorted(wide.collect()) == [("x", 0, 2), ("y", 1, 0)]


def test_normalised_column_rejects_short_rows(spark):
    docs = spark.createDataFrame([("1", "A", "Alpha beta"), ("2", "B", None)], "doc_id string, label string, text string")
    texts, counts, rejected = treat.normalise_column(docs, "text", "label", treat.truncation(3))
    assert [r["text"] for r in texts.collect()] == ["Alp bet"]
    assert sorted(counts.collect()) == [("A", "alpha", "alp", 1), ("A", "beta", "bet", 1)]
    assert [r["doc_id"] for r in rejected.collect()] == ["2"]


def test_snowball_column(spark):
    docs = spark.createDataFrame([("1", "A", "Häuser und Häuser"), ("2", "B", "..."), ("3", None, "Haus"), ("4", "B", None)],
                                 "doc_id string, label string, text string")
    texts, counts, rejected = treat.snowball_column(docs, "text", "label", "doc_id", "de")
    assert sorted((r["doc_id"], r["text"]) for r in texts.collect()) == [("1", "haus und haus"), ("2", "")]
    assert sorted(counts.collect()) == [("A", "häuser", "haus", 2), ("A", "und", "und", 1)]
    assert sorted(r["doc_id"] for r in rejected.collect()) == ["3", "4"]


def test_minimum_length_counts_kept_tokens(spark):
    rows = [(1, p, "de", "Haus") for p in range(100)] + [(1, 100, "de", "und")]
    rows += [(2, p, "de", "Haus") for p in range(99)] + [(2, 99, "de", "und")]
    tokens = spark.createDataFrame(rows, "doc_id bigint, pos int, lang string, token string")
    result = prepare.prepare_corpus(tokens, stopword_table(spark, ["de"]))
    assert {r["doc_id"] for r in result.tokens.select("doc_id").distinct().collect()} == {1}
    assert result.sizes.first().asDict() == {
        "documents_read": 2, "documents_written": 1, "tokens_read": 201,
        "tokens_after_stopping": 199, "tokens_written": 100}
    texts = prepare.treatment_texts(result.tokens, ["raw", "truncate5"])
    assert texts.count() == 2 and texts.first()["text"].count("Haus") == 100


def test_length_violations(spark):
    rows = [(1, "raw", "a"), (1, "raw", "b"), (1, "t", "a"), (2, "raw", "a"), (3, "raw", "a"), (3, "t", "a")]
    long = spark.createDataFrame(rows, "doc_id bigint, treatment string, term string")
    assert sorted(r["doc_id"] for r in prepare.length_violations(long, 2).collect()) == [1, 2]


def test_pruning_reads_both_ways(spark):
    rows = [(d, "common") for d in range(8)] + [(0, "burst")] * 5 + [(0, "rare")]
    tokens = spark.createDataFrame(rows, "doc_id bigint, term string")
    by_count = vocab.pruned_vocabulary(tokens, min_count=5).collect()
    by_docs = vocab.pruned_vocabulary(tokens, min_count=5, count_col="doc_freq").collect()
    assert [r["term"] for r in by_count] == ["burst"] and by_docs == []


def test_author_blocks_hold_the_wide_table(spark):
    rows = [(f"a{i:02d}", f"w{j}", i + j + 1) for i in range(23) for j in range(5) if (i + j) % 3]
    counts = spark.createDataFrame(rows, "author string, token string, count bigint")
    dictionary = authors.author_dictionary(counts)
    names = {r["author_id"]: r["author"] for r in dictionary.collect()}
    assert [names[i] for i in range(23)] == [f"a{i:02d}" for i in range(23)]
    blocks = authors.author_word_blocks(counts, dictionary, width=4).collect()
    assert all(e["author_id"] // 4 == r["block"] for r in blocks for e in r["entries"])
    assert all(len(r["entries"]) <= 4 for r in blocks)
    assert sorted((names[e["author_id"]], r["token"], e["count"]) for r in blocks for e in r["entries"]) == sorted(rows)


def test_quantiles_over_many_partitions(spark):
    import random

    from lexweave.operators import stats
    draw = random.Random(3)
    rows = [(g, round(draw.gauss(0, 5) ** 3, 2)) for g, n in (("a", 3000), ("b", 1), ("c", 2), ("d", 401)) for _ in range(n)]
    rows += [("a", 7.0)] * 900 + [("a", None), ("e", None)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r["g"]: r for r in stats.describe(table, "x", ["g"]).collect()}
    whole = stats.describe(table, "x").first()
    groups = {g: sorted(x for h, x in rows if h == g and x is not None) for g in "abcd"}
    assert set(got) == set(groups)

    def plain(values, p):
        at = (len(values) - 1) * p
        low = int(at)
        return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)

    for row, values in [*((got[g], v) for g, v in groups.items()), (whole, sorted(x for v in groups.values() for x in v))]:
        assert row["count"] == len(values)
        for name, p in stats.QUARTILES.items():
            assert abs(row[name] - plain(values, p)) < 1e-9


def test_word_tables_meet_the_words_of_blocks(spark, monkeypatch):
    """Every token was moved to the word table and back to its text, with the digest of the text."""
    from lexweave.operators import lda

    monkeypatch.setattr(lda, "BLOCK_TOKENS", 5)
    docs = spark.createDataFrame([(i % 7, f"The cat{chr(97 + i % 5)} and the Dog, dog the") for i in range(30)] + [(None, "the"), (9, None)], "doc_id int, text string")
    words = spark.createDataFrame([("the",), ("dog",), ("cata",)], "word string")
    seen = []
    monkeypatch.setattr(tok, "lookup_join", lambda left, *rest, **more: seen.append(left.columns) or lookup_join(left, *rest, **more))
    monkeypatch.setattr(tok, "token_table", None)
    stopped = tok.remove_stopwords(docs, words).select("doc_id", "text", "stopped_text").collect()
    kept = tok.keep_vocabulary(docs, words).select("doc_id", "clean_text").collect()
    assert all("of_block" in columns and "pos" not in columns for columns in seen) and len(seen) == 2
    assert len(stopped) == len(kept) == 32
    assert {(r["text"] or "")[4:8]: r["stopped_text"] for r in stopped} == {"": "", "cata": "and", **{f"cat{c}": f"cat{c} and" for c in "bcde"}}
    assert {r["clean_text"] for r in kept} == {"", "the", "the cata the dog dog the", "the the dog dog the"}
