"""The stream gives what the batch gives."""

from pyspark.sql import functions as F

from lexweave.functions.stopwords import stop_lists
from lexweave.operators import treat
from lexweave.plans import prepare
from lexweave.sources import corpus
from lexweave.streaming import treated


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.tsv").write_text("1\tde\tDas Haus und die Haustür\n2\tde\tund\n", encoding="utf-8")
    (source / "b.tsv").write_text("3\tde\tGarten\n4\tde\t\n", encoding="utf-8")
    stop, table = stop_lists(["de"]), treat.column_treatments()
    stream = treated.read_corpus_stream(spark, str(source)).withColumn("lang", F.col("label"))
    query = treated.write_treated(treated.treated_stream(stream, stop, table, 1), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert query.awaitTermination(60)
    batch = corpus.read_corpus_tsv(spark, str(source)).withColumn("lang", F.col("label"))
    expected = prepare.document_texts(prepare.prepare_documents(batch, stop, 1), table)
    cols = ["treatment", "doc_id", "text"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(cols).collect()))
    assert got == sorted(map(tuple, expected.select(cols).collect())) and len(got) == 6
    assert ("truncate5", "1", "Haus Haust") in got


def test_empty_text_is_alike_in_stream_and_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("1\tde\t\n", encoding="utf-8")
    stream = treated.read_corpus_stream(spark, str(tmp_path / "in"))
    query = treated.write_treated(stream.withColumn("treatment", F.lit("raw")), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert query.awaitTermination(60)
    batch = corpus.read_corpus_tsv(spark, str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "out")).first()["text"] is batch.first()["text"] is None
