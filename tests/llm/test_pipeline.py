"""The pipeline's stages: columns unchanged, decisions in effect, clean documents kept."""

import corpus_pipeline
from lexweave.llm import decontaminate, jaccard_join

FOLDER = "/root/testdata/sf0.001"


def test_stages_filter_and_keep_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "mixture", "shards"]
    odd = spark.createDataFrame([(900001, None, "en", "s", 0), (900002, "12 34 !!", "en", "s", 8),
                                 (None, "the and of that is", "en", "s", 3)], docs.schema)
    now, sizes = docs.unionByName(odd), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = now
        stage(spark, now, FOLDER).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.columns == docs.columns
        assert now.exceptAll(before).count() == 0
        sizes.append(now.count())
        gone = before.exceptAll(now)
        if name == "language":
            assert sorted(r["doc_id"] for r in gone.collect()) == [900001, 900002]
        if name == "near_duplicates":
            groups = jaccard_join.jaccard_components(now.filter("doc_id IS NOT NULL"))
            assert groups.filter("doc_id <> component_id").count() == 0
        if name == "decontamination":
            bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
            marked = decontaminate.mark_contaminated(before, bench, ["doc_id"]).filter("contaminated")
            assert {r["doc_id"] for r in gone.collect()} == {r["doc_id"] for r in marked.collect()} != set()
    placed = corpus_pipeline.STAGES[-1][1](spark, now, FOLDER)
    assert placed.count() == sizes[-1] > 0
    assert sizes == sorted(sizes, reverse=True)


def test_near_duplicates_keep_one_of_repeated_rows(spark):
    same = "a b c d e f"
    docs = spark.createDataFrame([(1, same, "en", "s", 1), (1, same, "en", "s", 1), (1, "quite another text", "en", "s", 1),
                                  (2, same, "en", "s", 1), (3, "", "en", "s", 0), (4, None, "en", "s", 0), (4, None, "en", "s", 0),
                                  (None, same, "en", "s", 1), (None, "without id", "en", "s", 1), (None, "without id", "en", "s", 1)],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [
        ("1", same), ("1", "quite another text"), ("3", ""), ("4", "None"), ("None", "without id")]


def test_short_clean_texts_keep_their_language_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    short = spark.createDataFrame([(900001, "A.", "en", "s", 2), (900002, "Oui", "fr", "s", 3), (900003, "9 9", "en", "s", 3)], docs.schema)
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(short), FOLDER).filter("doc_id > 900000")
    assert sorted(r["doc_id"] for r in kept.collect()) == [900001, 900002]
