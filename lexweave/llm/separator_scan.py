"""Token counts from flat token files: a vectorised scan for end-of-document identifiers.

A stream is a flat sequence of token ids, each document closed by the separator, cut into blocks without regard
to documents and without an index.  Each block is searched on its own: tokens before its first separator, between
separators, and behind the last.  Documents that cross blocks are stitched by a prefix scan over the blocks'
summaries: the open tail before a block is a running sum that starts anew at each block with a separator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexweave.llm.batches import bounded_batches
from lexweave.llm.token_ids import Encoder, public_vocabulary, shared_vocabulary
from lexweave.session import materialised

SEPARATOR = 50256
BLOCK_TOKENS = 1 << 16
RANGE_BYTES = 1 << 27     # of a flat file, read by one task


def _flattener(vocabulary, block: int, separator: int):
    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        stream, number = TaskContext.get().partitionId(), 0
        room, held, ids = np.empty(block, dtype=np.uint16), 0, []       # the block being filled

        def cut():
            return pa.RecordBatch.from_arrays(
                [pa.array([stream], pa.int64()), pa.array([number], pa.int64()), pa.array([room[:held].tobytes()], pa.binary()),
                 pa.array([ids], pa.list_(pa.int64()))], ["stream", "block", "payload", "ids"])

        end = np.array([separator], dtype=np.uint16)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for tokens, closes in [*((t, False) for t in encoder.pieces(text.as_py() or "")), (end, True)]:
                    at = 0
                    while at < len(tokens):
                        n = min(block - held, len(tokens) - at)
                        room[held:held + n] = tokens[at:at + n]
                        held, at = held + n, at + n
                        if closes:
                            ids.append(doc_id)
                        if held == block:
                            yield cut()
                            number, held, ids = number + 1, 0, []
        if held:
            yield cut()
    return flatten


def token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                 block: int = BLOCK_TOKENS, separator: int = SEPARATOR) -> DataFrame:
    """``stream, block, payload, ids``: documents as flat streams, one per task; ``ids`` name the documents that end
    in a block and serve only to label the scan's result.  Ids are 16 bits wide."""
    bounded_batches(docs.sparkSession)
    shared = shared_vocabulary(docs.sparkSession, vocabulary or public_vocabulary())
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(
        _flattener(shared, block, separator), "stream bigint, block bigint, payload binary, ids array<bigint>")


def open_file(path: str) -> pa.NativeFile:
    """A file for reading at any place: local and mounted paths, or a store that pyarrow knows (hdfs, s3, gs)."""
    from urllib.parse import quote

    from pyarrow import fs
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pa.OSFile("/" + rest.lstrip("/"))
    system, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_file(name)


def _range_reader(block: int, opener: Callable[[str], pa.NativeFile]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, stream, number, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                with opener(path) as file:
                    for at in range(start, end, 2 * block):
                        part = file.read_at(min(2 * block, end - at), at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([stream], pa.int64()), pa.array([(number << 40) + at // (2 * block)], pa.int64()),
                             pa.array([part], pa.binary()), pa.array([None], pa.list_(pa.int64()))],
                            ["stream", "block", "payload", "ids"])
    return read


def read_blocks(spark: SparkSession, path: str, block: int = BLOCK_TOKENS, range_bytes: int = RANGE_BYTES,
                opener: Callable[[str], pa.NativeFile] = open_file) -> DataFrame:
    """Blocks of flat files of 16-bit ids: a folder is a stream, its files follow each other in order of name.

    Spark lists the files and deals byte ranges of them over the tasks, which read block by block at the range's
    place; a file may have any size, and a task holds one block.  A last byte without a partner is no id and is left
    out; an empty file has no blocks.  ``opener`` opens a listed path where tasks run; give your own for a store that
    pyarrow does not know.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .select("path", "length"))       # names and sizes only, contents are not read here
    folder = F.regexp_extract("path", "^(.*)/", 1)
    number = F.row_number().over(Window.partitionBy(folder).orderBy("path")) - 1
    whole = (F.col("length") - F.col("length") % 2).alias("whole")
    step = max(range_bytes // (2 * block), 1) * 2 * block
    ranges = (files.select("path", F.xxhash64(folder).alias("stream"), number.cast("bigint").alias("number"), whole)
              .filter("whole > 0")
              .select("path", "stream", "number", "whole",
                      F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1, F.lit(step).cast("bigint"))).alias("start"))
              .select("path", "stream", "number", "start", F.least(F.col("start") + step, "whole").alias("end")))
    # a stated number of partitions: adaptive execution would join such small rows into one
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return ranges.repartition(spread, "path", "start").mapInArrow(
        _range_reader(block, opener), "stream bigint, block bigint, payload binary, ids array<bigint>")


def _scanner(separator: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for payload in batch.column(2).to_pylist():
                tokens = np.frombuffer(payload, dtype=np.uint16)
                stops = np.flatnonzero(tokens == separator)
                if stops.size:
                    rows.append((int(stops[0]), (np.diff(stops) - 1).tolist(), len(tokens) - int(stops[-1]) - 1, stops.size))
                else:
                    rows.append((len(tokens), [], len(tokens), 0))
            head, inner, tail, n = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(head, pa.int64()),
                 pa.array(inner, pa.list_(pa.int64())), pa.array(tail, pa.int64()), pa.array(n, pa.int64())],
                ["stream", "block", "ids", "head", "inner", "tail", "n"])
    return scan


def count_documents(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """``stream, ordinal, doc_id, n_tokens`` of every document, separators not counted.

    Two separators in a row close an empty document.  Tokens behind a stream's last separator are a document that
    was not closed; it comes last, without an id.  ``doc_id`` is null where the blocks carry no ids.  A stream's
    summaries (not its tokens) are ordered in one task; a stream is what one task or one folder holds.
    """
    # the summaries are read twice, for closed documents and for what is left open
    found = materialised(blocks.select("stream", "block", "payload", "ids").mapInArrow(
        _scanner(separator),
        "stream bigint, block bigint, ids array<bigint>, head bigint, inner array<bigint>, tail bigint, n bigint"), "blocks")
    order = Window.partitionBy("stream").orderBy("block")
    opened = found.withColumn("segment", F.sum((F.col("n") > 0).cast("int")).over(order))
    grown = opened.withColumn("open", F.sum("tail").over(Window.partitionBy("stream", "segment").orderBy("block")))
    carried = (grown.withColumn("carry", F.coalesce(F.lag("open").over(order), F.lit(0)))
               .withColumn("before", F.sum("n").over(order) - F.col("n"))
               .withColumn("last", F.lead("block").over(order).isNull()))
    closed = F.when(F.col("n") > 0, F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner")))
    documents = carried.select("stream", "before", "ids", F.posexplode(closed).alias("k", "n_tokens")).select(
        "stream", (F.col("before") + F.col("k")).alias("ordinal"), F.get("ids", F.col("k")).alias("doc_id"), "n_tokens")
    rest = carried.filter(F.col("last") & (F.col("open") > 0)).select(
        "stream", (F.col("before") + F.col("n")).alias("ordinal"), F.lit(None).cast("bigint").alias("doc_id"),
        F.col("open").alias("n_tokens"))
    return documents.unionByName(rest)
