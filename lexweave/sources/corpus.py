"""Raw text files, corpus TSV, word lists, term counts and metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window, functions as F
from pyspark.sql.streaming import DataStreamReader

from lexweave.operators.treat import stack
from lexweave.session import materialised, setting

CORPUS_SCHEMA = "doc_id string, label string, text string"
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
VOCAB_SCHEMA = "word string, term_freq bigint, doc_freq bigint"


def tsv_reader(reader: DataFrameReader | DataStreamReader, schema: str):
    """Plain tab split without quoting or escaping, for ``spark.read`` and ``spark.readStream``.

    Blanks are kept; an empty field is null, like one that a short line lacks.
    """
    return (reader.schema(schema).option("sep", "\t").option("quote", "").option("escape", "")
            .option("encoding", "UTF-8").option("emptyValue", "").option("nullValue", "\x00"))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def author_of(doc_id: Column) -> Column:
    return F.split(doc_id, "_").getItem(0)


def title_parts(file_name: Column) -> Column:
    """``doc_id, author, title`` of a file named ``Author_Title.ext``."""
    parts = F.split(file_name, "[_.]")
    author, title = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.struct(F.concat_ws("_", author, title).alias("doc_id"),
                    author.alias("author"), title.alias("title"))


def nested_name(path: Column) -> Column:
    """``…/Author/title.txt`` as the flat name ``Author_title.txt``."""
    return F.concat_ws("_", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1),
                       F.regexp_extract(path, r"([^/]+)$", 1))


def read_text_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, label, text, path)`` of the UTF-8 ``*.txt`` files, and the files that are not UTF-8.

    Files of a corpus laid out as ``Author/title.txt`` are found too; one file is one row.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.txt")
             .option("recursiveFileLookup", "true").load(folder))
    stem = file_stem(F.col("path"))
    good = files.filter(F.is_valid_utf8(F.col("content").cast("string"))).select(
        stem.alias("doc_id"), author_of(stem).alias("label"),
        F.col("content").cast("string").alias("text"), "path")
    bad = files.filter(~F.is_valid_utf8(F.col("content").cast("string"))).select("path", "length")
    return good, bad


def read_text_lines(spark: SparkSession, folder: str, suffix: str = "*.txt") -> tuple[DataFrame, DataFrame]:
    """``(doc_id, label, line, text, path)`` of UTF-8 files of any size, and the files that are not UTF-8.

    Spark cuts the files into byte ranges at line ends, so one large file is read by many tasks; lines are numbered
    from 0 within their file from one count per range.  Lines end in a line feed, which is left out; a carriage
    return stays.  An empty file has no lines.  A file with a line that is not UTF-8 is left out whole and reported
    as ``(path, bad_lines)``.
    """
    place = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    # ranges depend on the cluster's size at the moment of the scan, so they and the places in them are fixed once
    rows = materialised(
        spark.read.option("lineSep", "\n").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true")
        .text(folder).select(*place, "value", F.monotonically_increasing_id().alias("row"),
                             F.is_valid_utf8("value").alias("valid")), "lines")
    ranges = rows.groupBy("path", "start").agg(
        F.min("row").alias("first"), F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("bad"))
    whole = Window.partitionBy("path")
    ranges = ranges.select(
        "path", "start", "first", (F.sum("n").over(whole.orderBy("start")) - F.col("n")).alias("before"),
        F.sum("bad").over(whole).alias("bad_lines"))
    stem = file_stem(F.col("path"))
    # one row for each range of 128 MB: Spark may broadcast them, or split the longer side where a file is hot
    lines = (rows.join(ranges.filter("bad_lines = 0"), ["path", "start"])
             .select(stem.alias("doc_id"), author_of(stem).alias("label"),
                     (F.col("before") + F.col("row") - F.col("first")).alias("line"), F.col("value").alias("text"), "path"))
    return lines, ranges.filter("bad_lines > 0").select("path", "bad_lines").distinct()


def line_passages(lines: DataFrame, line_count: int) -> DataFrame:
    """``(doc_id, label, passage, text, path)``: every ``line_count`` lines of a file as one text."""
    passage = F.floor(F.col("line") / line_count).alias("passage")
    ordered = F.array_sort(F.collect_list(F.struct("line", "text")))
    return (lines.groupBy("path", "doc_id", "label", passage).agg(ordered.alias("t"))
            .select("doc_id", "label", "passage", F.array_join(F.col("t.text"), "\n").alias("text"), "path"))


def read_corpus_tsv(spark: SparkSession, path: str) -> DataFrame:
    return tsv_reader(spark.read, CORPUS_SCHEMA).csv(path)


def write_corpus_tsv(docs: DataFrame, path: str, doc_id: str = "doc_id", label: str = "label",
                     text: str = "text", compression: str = "none") -> None:
    """Lines ``doc_id<TAB>label<TAB>text``; the text must hold neither tabs nor line feeds."""
    (docs.select(F.concat_ws("\t", F.col(doc_id).cast("string"), label, text).alias("value"))
         .write.option("compression", compression).text(path))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return tsv_reader(spark.read, VOCAB_SCHEMA).csv(path)


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    (df.write.option("sep", "\t").option("header", str(header).lower()).option("quote", "")
       .option("emptyValue", "").csv(path))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return tsv_reader(spark.read, schema).option("header", "true").csv(path)


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, trimmed, blanks dropped, each word once."""
    return (spark.read.text(path).select(F.trim("value").alias("word"))
            .filter(F.col("word") != "").distinct())


def write_treatments(long_tokens: DataFrame, path: str) -> None:
    """One folder per treatment from a single pass over the tokens, with a file open for each treatment instead of a sort."""
    spark = long_tokens.sparkSession
    with setting(spark, OPEN_FILES, str(max(int(spark.conf.get(OPEN_FILES, "0")), 50)), "0"):  # with more treatments a task sorts the rest
        long_tokens.write.partitionBy("treatment").parquet(path)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tables of many runs below ``corpus=/treatment=/num_topics=/run=``; folders become columns."""
    full = f"{schema}, corpus string, treatment string, num_topics int, run int"
    return spark.read.schema(full).parquet(path)


def stack_runs(runs: dict[tuple[str, str, int, int], DataFrame]) -> DataFrame:
    """Stack per-run tables, turning ``(corpus, treatment, num_topics, run)`` into columns."""
    return stack([
        df.select(F.lit(c).alias("corpus"), F.lit(t).alias("treatment"),
                  F.lit(k).alias("num_topics"), F.lit(r).alias("run"), "*")
        for (c, t, k, r), df in runs.items()])
