"""Readers and writers on tiny files."""

import gzip
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from lexweave.sources import annotated, corpus, state as files
from lexweave.session import materialised, scratch_root


def test_text_folder_skips_other_encodings(spark, tmp_path):
    (tmp_path / "Tolstoy_Anna.txt").write_text("мир\nда", encoding="utf-8")
    (tmp_path / "Tolstoy_War.txt").write_bytes("мир".encode("cp1251"))
    (tmp_path / "notes.md").write_text("no")
    good, bad = corpus.read_text_folder(spark, str(tmp_path))
    row = good.first()
    assert (row["doc_id"], row["label"], row["text"]) == ("Tolstoy_Anna", "Tolstoy", "мир\nда")
    assert [r["path"].rsplit("/", 1)[1] for r in bad.collect()] == ["Tolstoy_War.txt"]


def test_lines_of_byte_ranges_equal_the_whole_read(spark, tmp_path):
    texts = {"Tolstoy_Anna": "мир\nда\n\r\nи " + "слово " * 40 + "\nend", "Gogol_Nose": "\n\nодна\n", "Gogol_Empty": "",
             "Gogol_Many": "".join(f"{i} {'x' * (i % 37)}\n" for i in range(300))}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode("utf-8"))
    (tmp_path / "Bad_File.txt").write_bytes(b"good line\n" * 30 + "мир".encode("cp1251") + b"\nmore\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "23"):                      # the second cuts every file into ranges of 23 bytes
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines, bad = corpus.read_text_lines(spark, str(tmp_path))
            got = {}
            for r in lines.orderBy("doc_id", "line").collect():
                got.setdefault(r["doc_id"], []).append((r["line"], r["text"], r["label"]))
            bad_rows = [(r["path"].rsplit("/", 1)[1], r["bad_lines"]) for r in bad.collect()]
            passages = corpus.line_passages(lines, 7).orderBy("doc_id", "passage").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        whole = {name: text.removesuffix("\n").split("\n") for name, text in texts.items() if text}
        assert got == {n: [(i, t, n.split("_")[0]) for i, t in enumerate(parts)] for n, parts in whole.items()}
        assert bad_rows == [("Bad_File.txt", 1)]
        assert [r["text"] for r in passages if r["doc_id"] == "Gogol_Many"] == [
            "\n".join(whole["Gogol_Many"][i:i + 7]) for i in range(0, 300, 7)]


def test_names(spark):
    df = spark.createDataFrame([("/c/Gogol/Nose.txt",)], "path string")
    flat = corpus.nested_name(F.col("path"))
    row = df.select(flat.alias("flat"), corpus.title_parts(flat).alias("p")).first()
    assert row["flat"] == "Gogol_Nose.txt" and tuple(row["p"]) == ("Gogol_Nose", "Gogol", "Nose")


def test_tsv_is_not_quoted(spark, tmp_path):
    docs = spark.createDataFrame([("1", "A", 'say "hi", \\n it\'s'), ("2", "B", "")], "doc_id string, label string, text string")
    corpus.write_corpus_tsv(docs, str(tmp_path / "t"))
    back = {r["doc_id"]: r["text"] for r in corpus.read_corpus_tsv(spark, str(tmp_path / "t")).collect()}
    assert back["1"] == 'say "hi", \\n it\'s' and not back["2"]


def test_short_lines_surface_as_missing_text(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("1\tA\ttext here\n2\tB\n", encoding="utf-8")
    rows = {r["doc_id"]: r["text"] for r in corpus.read_corpus_tsv(spark, str(tmp_path / "c.tsv")).collect()}
    assert rows == {"1": "text here", "2": None}


def test_word_list(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" a \n\nb\na\n", encoding="utf-8")
    assert sorted(r["word"] for r in corpus.read_word_list(spark, str(tmp_path / "w.txt")).collect()) == ["a", "b"]


def test_state_round_trip(spark, tmp_path):
    path = tmp_path / "state.gz"
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("#doc source pos typeindex type topic\n#alpha : 0.5 0.25 0.1\n#beta : 0.01\n0 s1 0 0 дом 2\n0 s1 1 1 #tag 0\n")
    state = files.read_state(spark, str(path))
    assert sorted(map(tuple, state.collect())) == [(0, "s1", 0, 0, "дом", 2), (0, "s1", 1, 1, "#tag", 0)]
    priors = files.read_priors(spark, str(path)).first()
    assert priors["alpha"] == [0.5, 0.25, 0.1] and priors["beta"] == 0.01
    files.write_state(state, str(tmp_path / "out"), priors["alpha"], priors["beta"])
    assert sorted(files.read_state(spark, str(tmp_path / "out")).collect()) == sorted(state.collect())


def test_gold_file_positions_and_rejects(spark, tmp_path):
    with gzip.open(tmp_path / "o.gz", "wt", encoding="utf-8") as f:
        f.write("d1\t0\tДома\tДом\tS,m=nom\nbroken line\nd1\t0\tесть\tбыть\tV\nd2\t1\tA\tB\tC,d\n")
    good, bad = files.read_oracle(spark, str(tmp_path / "o.gz"))
    rows = sorted((r["doc_index"], r["pos"], r["surface"], r["lemma"], r["slot"], r["pos_tag"]) for r in good.collect())
    assert rows == [(0, 0, "дома", "дом", "S,m=nom", "S"), (0, 2, "есть", "быть", "V", "V"), (1, 0, "a", "b", "C,d", "C")]
    assert bad.first()["value"] == "broken line"
    kept, _ = files.read_oracle(spark, str(tmp_path / "o.gz"), use_downcase=False)
    assert kept.filter("pos = 0 and doc_index = 0").first()["surface"] == "Дома"


def test_gold_lines_rejected_inside_a_document_leave_gaps(spark, tmp_path):
    with gzip.open(tmp_path / "o.gz", "wt", encoding="utf-8") as f:
        f.write("d1\t0\ta\ta\tS\nd1\t0\tfour fields\nd1\tx\tb\tb\tS\nd1\t0\tc\tc\tS\nd2\t1\td\td\tS\n")
    good, bad = files.read_oracle(spark, str(tmp_path / "o.gz"))
    assert sorted((r["doc_index"], r["pos"], r["surface"]) for r in good.collect()) == [(0, 0, "a"), (0, 3, "c"), (1, 0, "d")]
    assert bad.filter("value like '%x%'").count() == 1


def test_gold_document_in_two_files_fails(spark, tmp_path):
    many = "".join(f"d1\t0\tw{i}\tw\tS\n" for i in range(5))
    for name in "ab":
        with gzip.open(tmp_path / f"{name}.gz", "wt", encoding="utf-8") as f:
            f.write(many)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1")    # a partition for each file
    try:
        with pytest.raises(Exception, match="document 0 lie in several"):
            files.read_oracle(spark, str(tmp_path))[0].collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_diagnostics_keep_every_attribute(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<model>\n<topic id="0" tokens="12" brand-new="2.5"></topic>\n'
                                    '<topic id="1" tokens="7" other="1"></topic>\n</model>')
    rows = files.read_diagnostics(spark, str(tmp_path / "d.xml"))
    assert {r["topic"]: (r["tokens"], r["brand_new"], r["other"]) for r in rows.collect()} == {
        0: (12.0, 2.5, None), 1: (7.0, None, 1.0)}


def test_diagnostics_xml(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        '<?xml version="1.0"?>\n<model>\n<topic id="0" tokens="12" coherence="-3.5" word-length="4.5">'
        '<word rank="1" count="3">a</word></topic>\n<topic id="1" tokens="7" coherence="-1" word-length="5"></topic>\n</model>')
    rows = files.with_negative_coherence(
        files.read_diagnostics(spark, str(tmp_path / "d.xml"), ["tokens", "coherence", "word-length"]))
    got = {r["topic"]: (r["tokens"], r["negative_coherence"], r["word_length"]) for r in rows.collect()}
    assert got == {0: (12.0, 3.5, 4.5), 1: (7.0, 1.0, 5.0)}


RNC = """<?xml version="1.0" encoding="windows-1251"?>
<html><head><title>t</title></head><body>
<p class="a"><se><w><ana lex="дом" gr="S,m=nom"></ana>До`м</w> , <w><ana lex="стать" gr="V"></ana><ana lex="сталь" gr="S"></ana>стали</w></se></p>
<p><se><w>безразбора</w> <w><ana lex="и" gr="CONJ"></ana>и</w></se></p>
</body></html>"""


def test_folder_corpus(spark, tmp_path):
    for genre, name in [("public", "one.xml"), ("speech", "two.xml"), ("fiction", "three.xml")]:
        (tmp_path / genre).mkdir()
        (tmp_path / genre / name).write_bytes(RNC.encode("cp1251"))
    good, bad = annotated.read_rnc(spark, str(tmp_path), ["public", "speech"])
    rows = sorted(tuple(r) for r in good.filter("doc_id = 'one'").select("genre", "pos", "surface", "lemma", "slot").collect())
    assert rows == [("public", 0, "Дом", "дом", "S,m=nom"), ("public", 1, "стали", "стать|сталь", "V|S"), ("public", 3, "и", "и", "CONJ")]
    assert {(r["doc_id"], r["surface"]) for r in bad.collect()} == {("one", "безразбора"), ("two", "безразбора")}
    everything, _ = annotated.read_rnc(spark, str(tmp_path))
    assert {r["genre"] for r in everything.collect()} == {"public", "speech", "fiction"}


def _opencorpora(doc_id, parent, tag, words):
    tags = f"<tags><tag>Год:2010</tag><tag>{tag}</tag></tags>" if tag else "<tags/>"
    tokens = "".join(
        f'<token id="1" text="{w}"><tfr t="{w}"><v><l t="{lemma}"><g v="NOUN"/><g v="sing"/></l></v>{more}</tfr></token>'
        for w, lemma, more in words)
    body = f"<paragraphs><paragraph><sentence><source>s</source><tokens>{tokens}</tokens></sentence></paragraph></paragraphs>" if words else "<paragraphs/>"
    return f'<text id="{doc_id}" parent="{parent}" name="n">{tags}{body}</text>'


def test_document_tree_corpus(spark, tmp_path):
    extra = '<v><l t="стать"><g v="VERB"/></l></v>'
    parts = [
        _opencorpora(3, 2, "", [("стали", "сталь", extra), ("Дом", "дом", "")]),  # child before its parent
        _opencorpora(1, 0, "Тип:Газета", []), _opencorpora(2, 1, "", []),
        _opencorpora(4, 0, "Автор:X", []), _opencorpora(5, 4, "", [("да", "да", "")]),
        _opencorpora(6, 0, "Тип:Блог", [("ну", "ну", "")]),
    ]
    (tmp_path / "c.xml").write_text(
        '<?xml version="1.0" encoding="utf-8"?>\n<annotation version="1">\n' + "\n".join(parts) + "\n</annotation>", encoding="utf-8")
    rows = annotated.read_opencorpora(spark, str(tmp_path / "c.xml"))
    got = sorted((r["doc_id"], r["pos"], r["surface"], r["lemma"], r["slot"], r["genre"]) for r in rows.collect())
    assert got == [("3", 0, "стали", "сталь|стать", "NOUN,sing|VERB", "newspaper"),
                   ("3", 1, "Дом", "дом", "NOUN,sing", "newspaper"), ("6", 0, "ну", "ну", "NOUN,sing", "blog")]
    news = annotated.read_opencorpora(spark, str(tmp_path / "c.xml"), ["Newspaper", "unknown"])
    assert {r["doc_id"] for r in news.collect()} == {"3"}


def test_sentence_corpus(spark, tmp_path):
    def sentence(n, words):
        terminals = "".join(f'<t id="s{n}_{i}" word="{w}" lemma="{lemma}" pos="{p}" morph="{m}"/>' for i, (w, lemma, p, m) in enumerate(words))
        return f'<s id="s{n}"><graph root="s{n}_V"><terminals>{terminals}</terminals></graph></s>'

    xml = ('<?xml version="1.0" encoding="utf-8"?><corpus><body>'
           + sentence(1, [("Ross", "Ross", "NE", "Nom.Sg.Masc"), ("''", "--", "$(", "--")])
           + sentence(2, [("geht", "gehen", "VVFIN", "3.Sg.Pres.Ind")])
           + sentence(3, [("Foo-Bar", "---", "FM", "--")]) + "</body></corpus>")
    (tmp_path / "t.xml").write_text(xml, encoding="utf-8")
    (tmp_path / "d.tsv").write_text("a\t1\na\t2\nb\t3\n")
    rows = annotated.read_tiger(spark, str(tmp_path / "t.xml"), str(tmp_path / "d.tsv"))
    got = sorted((r["doc_id"], r["pos"], r["surface"], r["lemma"], r["slot"]) for r in rows.collect())
    assert got == [("a", 0, "Ross", "Ross", "NE,Nom,Sg,Masc"), ("a", 1, "''", "''", "$(,--"),
                   ("a", 2, "geht", "gehen", "VVFIN,3,Sg,Pres,Ind"), ("b", 0, "Foo-Bar", "Foo-Bar", "FM,--")]


def test_run_folders_become_columns(spark, tmp_path):
    one = spark.createDataFrame([(0, 1.5)], "topic int, m double")
    stacked = corpus.stack_runs({("c", "raw", 50, 0): one, ("c", "oracle", 100, 3): one})
    stacked.write.partitionBy("corpus", "treatment", "num_topics", "run").parquet(str(tmp_path / "r"))
    rows = corpus.read_runs(spark, str(tmp_path / "r"), "topic int, m double")
    assert {(r["treatment"], r["num_topics"], r["run"]) for r in rows.collect()} == {("raw", 50, 0), ("oracle", 100, 3)}


def test_materialised_tables_live_in_the_scratch_folder(spark):
    table = materialised(spark.range(5), "five")
    assert table.count() == 5
    assert table.inputFiles()[0].replace("file://", "").startswith(scratch_root(spark).replace("file://", ""))


def test_words_at_any_depth_in_order_and_counted(spark, tmp_path):
    folder = tmp_path / "verse"
    folder.mkdir()
    (folder / "poem.xml").write_text(
        '<html><head/><body><w><ana lex="a" gr="N"/>a</w><p><w><ana lex="b" gr="N"/>b</w><se><w><ana lex="c" gr="N"/>c</w>'
        '<w>bare</w></se></p><poem><verse><line><w><ana lex="d" gr="V"/>d</w></line></verse></poem></body></html>', encoding="cp1251")
    good, bad = annotated.read_rnc(spark, str(tmp_path))
    assert sorted((r["pos"], r["surface"]) for r in good.collect()) == [(0, "a"), (1, "b"), (2, "c"), (4, "d")]
    assert [(r["pos"], r["surface"]) for r in bad.collect()] == [(3, "bare")]
    assert annotated.rnc_word_counts(spark, str(tmp_path), good, bad).collect() == [("verse", "poem", 5, 5, 0)]
    assert annotated.rnc_word_counts(spark, str(tmp_path), good, bad.limit(0)).first()["missing"] == 1


def test_words_of_byte_ranges_and_of_odd_forms(spark, tmp_path):
    (tmp_path / "g").mkdir()
    odd = ('<w><ana lex="a&amp;b" gr="N"/>x &lt; y</w><w/><w>both<ana lex="a" gr="N"/>ends</w><w>\n t\n <ana lex="q" gr="W"/>\n</w>'
           '<w><ana gr="S" lex="z"/>z</w ><wx>no</wx><w><ana lex=" s " gr=""></ana>s</w><w><!-- c --><ana lex="c" gr="d"/>c</w><w>  </w>')
    plain = "".join(f'<w><ana lex="l{i}" gr="G"/>ж{i}</w> ' for i in range(40))
    (tmp_path / "g" / "f.xml").write_text(f"<html><body>{odd}<p>{plain}</p></body></html>", encoding="cp1251")
    want = [(0, "x < y", "a&b", "N"), (2, "ends", "a", "N"), (3, "t", "q", "W"), (4, "z", "z", "S"), (5, "s", "s", ""),
            (6, "c", "c", "d"), *[(8 + i, f"ж{i}", f"l{i}", "G") for i in range(40)]]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (before, "700"):      # the second cuts the file into ranges of 700 bytes
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            good, bad = annotated.read_rnc(spark, str(tmp_path))
            assert [tuple(r) for r in good.select("pos", "surface", "lemma", "slot").orderBy("pos").collect()] == want
            assert sorted(r["pos"] for r in bad.collect()) == [1, 7]
            assert annotated.rnc_word_counts(spark, str(tmp_path), good, bad).first()["missing"] == 0
            # words are numbered without bringing a file's words into one task
            assert "Window" not in good._jdf.queryExecution().optimizedPlan().toString()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_texts_within_texts(spark, tmp_path):
    def token(w):
        return f'<token text="{w}"><tfr><v><l t="{w}"><g v="N"/></l></v></tfr></token>'
    path = tmp_path / "c.xml"
    path.write_text(
        '<annotation><text id="1" parent="0"><tags><tag>Тип:Газета</tag></tags>' + token("a")
        + '<text id="2" parent="1"><paragraphs><x>' + token("b") + '</x></paragraphs>'
        + '<text id="3" parent="2">' + token("c") + '<token text="bare"/></text>' + token("d") + '</text>' + token("e")
        + '</text><text id="4" parent="1">' + token("f") + '</text></annotation>', encoding="utf-8")
    for size in ("128m", "64"):       # one split, and many
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = annotated.opencorpora_tokens(spark, str(path)).collect()
            counts = annotated.opencorpora_token_counts(spark, str(path)).first()
            leaves = annotated.read_opencorpora(spark, str(path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted((r["doc_id"], r["pos"], r["t"]["_text"]) for r in rows) == [
            ("1", 0, "a"), ("1", 1, "e"), ("2", 0, "b"), ("2", 1, "d"), ("3", 0, "c"), ("3", 1, "bare"), ("4", 0, "f")]
        assert tuple(counts) == (7, 7, 0)
        assert sorted((r["doc_id"], r["surface"], r["genre"]) for r in leaves if r["lemma"]) == [
            ("3", "c", "newspaper"), ("4", "f", "newspaper")]


def test_state_rows_with_nulls_and_spaces_read_back(spark, tmp_path):
    from lexweave.sources import state as files
    rows = [(2, None, 0, 5, "a", 1), (1, "two words", 1, None, "b c", 0), (1, "", 0, 7, "d", 2)]
    state = spark.createDataFrame(rows, "doc_id bigint, source string, pos int, term_id bigint, term string, topic int")
    files.write_state(state, str(tmp_path / "s"), [0.5, 0.5], 0.01)
    back = sorted((tuple(r) for r in files.read_state(spark, str(tmp_path / "s")).collect()), key=str)
    assert back == [(1, "two_words", 1, None, "b_c", 0), (1, None, 0, 7, "d", 2), (2, None, 0, 5, "a", 1)]
    (tmp_path / "bad").write_text("#doc\n1 s 0 4 term\n1 s x 4 term 2\n1 s 0 4 term 2\n")
    assert files.read_state(spark, str(tmp_path / "bad")).count() == 1
    assert sorted(r["value"] for r in files.rejected_state_lines(spark, str(tmp_path / "bad")).collect()) == [
        "1 s 0 4 term", "1 s x 4 term 2"]


def test_annotated_tokens_become_rows_behind_the_shuffles(spark, tmp_path):
    token = '<token text="{0}"><tfr><v><l t="{0}"/></v></tfr></token>'
    (tmp_path / "c.xml").write_text(
        '<annotation><text id="1" parent="0"><p>' + token.format("a") + '<text id="2" parent="1">' + token.format("b") + token.format("c")
        + "</text>" + token.format("d") + '</p></text><text id="2" parent="0">' + token.format("e") + "</text></annotation>", encoding="utf-8")
    tokens = annotated.opencorpora_tokens(spark, str(tmp_path / "c.xml"))
    # pieces of texts are moved and put in order, not their tokens; a repeated id goes on where it was left
    plan = tokens._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Exchange")
    assert sorted((r["doc_id"], r["pos"], r["t"]["_text"]) for r in tokens.collect()) == [
        ("1", 0, "a"), ("1", 1, "d"), ("2", 0, "b"), ("2", 1, "c"), ("2", 2, "e")]
    (tmp_path / "s.xml").write_text('<corpus><s id="s1"><graph><terminals><t word="x" lemma="x" pos="N" morph="--"/></terminals></graph></s></corpus>')
    (tmp_path / "d.tsv").write_text("a\t1\n")
    plan = annotated.read_tiger(spark, str(tmp_path / "s.xml"), str(tmp_path / "d.tsv"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate posexplode") < min(plan.index(x) for x in ("Exchange", "Join"))


def test_derived_xml_is_written_compressed(spark, tmp_path):
    from lexweave.catalog import sources

    sources._write_xml(spark.createDataFrame([(1, "x")], "_id int, w string"), str(tmp_path / "x"), "corpus", "s")
    assert {p.suffix for p in (tmp_path / "x").glob("part-*")} == {".gz"}


def test_tokens_of_the_usual_form_and_others_are_read_alike(spark, tmp_path):
    tokens = [
        '<token id="1" text="Дом"><tfr rev_id="5" t="Дом"><v><l id="9" t="дом"><g v="NOUN"/><g v="a,b"/></l></v><v><l t="дома"><g v="ADV"/></l></v></tfr></token>',
        '<token text="x&amp;y"><tfr><v><l t="&quot;q"><g v="N"/></l></v></tfr></token>',                # references
        '<token text=" z "><tfr>\n<v><l t="z"><g v="N"/><g v="sg"/></l></v>\n<v><l t="w"/></v></tfr></token>',  # blanks, no grammemes
        '<token text="b"/>', '<token text="c"><tfr/></token>',
        '<token text="d"><tfr><v><l t=""><g v="N"/></l></v></tfr></token>',
        "<token text='e'><tfr><v><l t='e'><g v='N'/></l></v></tfr></token>",
    ]
    (tmp_path / "c.xml").write_text(
        '<annotation><text id="1" parent="0"><tags><tag>Тип:Блог</tag></tags><p>' + "".join(tokens) + "</p></text></annotation>", encoding="utf-8")
    rows = annotated.read_opencorpora(spark, str(tmp_path / "c.xml"))
    # the files are read once, into pieces; what is read of these are words, not XML
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "from_xml" not in plan and "FileScan parquet" in plan
    got = sorted(tuple(r) for r in rows.select("pos", "surface", "lemma", "slot").collect())
    parsed = annotated.opencorpora_tokens(spark, str(tmp_path / "c.xml")).collect()     # each token through the XML parser
    assert got == sorted((r["pos"], r["t"]["_text"], "|".join(v["l"]["_t"] for v in (r["t"]["tfr"] or {"v": None})["v"] or []), "|".join(
        ",".join(g["_v"] for g in v["l"]["g"]) for v in (r["t"]["tfr"] or {"v": None})["v"] or [] if v["l"]["g"] is not None)) for r in parsed)
    assert got[0][1:] == ("Дом", "дом|дома", "NOUN,a,b|ADV") and got[1][1:] == ("x&y", '"q', "N") and len(got) == 7


def test_state_rows_are_made_once_and_leave_nothing_behind(spark, tmp_path, monkeypatch):
    from lexweave.sources import state as files
    tables = []

    def recorded(df, name):
        tables.append(materialised(df, name))
        return tables[-1]

    monkeypatch.setattr(files, "materialised", recorded)
    state = spark.range(50).select("id", F.lit("s").alias("source"), F.lit(0).alias("pos"), F.col("id").alias("term_id"), F.lit("t").alias("term"), F.lit(1).alias("topic"))
    files.write_state(state.withColumnRenamed("id", "doc_id"), str(tmp_path / "s"), [0.5], 0.01)
    assert len(tables) == 1 and not Path(tables[0].inputFiles()[0].replace("file://", "")).exists()     # the rows were joined for the ranges and again for the file
    assert files.read_state(spark, str(tmp_path / "s")).count() == 50
