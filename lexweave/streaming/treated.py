"""Treating documents as they arrive.

Preparation and normalisation of plain text are settled inside each row, so the batch functions
apply to a stream unchanged; there is no state and no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexweave.operators.tokens import StopLists
from lexweave.plans.prepare import document_texts, prepare_documents
from lexweave.session import scratch_path
from lexweave.sources.corpus import CORPUS_SCHEMA, tsv_reader


def read_corpus_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New corpus TSV files of a folder as ``doc_id, label, text`` rows."""
    return tsv_reader(spark.readStream, CORPUS_SCHEMA).csv(folder)


def treated_stream(docs: DataFrame, stop_lists: StopLists, treatments: dict,
                   min_tokens: int = 100, lang_col: str = "lang") -> DataFrame:
    """Texts under every treatment; stop words are lists by language, as a joined table would need state."""
    return document_texts(prepare_documents(docs, stop_lists, min_tokens, lang_col=lang_col), treatments)


def write_treated(stream: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append to Parquet by treatment, once per input file; drains what is there and stops."""
    location = checkpoint or scratch_path(stream.sparkSession, "stream")
    return (stream.writeStream.format("parquet").partitionBy("treatment")
            .option("checkpointLocation", location).trigger(availableNow=True).start(path))
