"""Line deduplication by winnowing over line hashes (DataFrame functions only).

A gram begins at each line: the fewest following lines that hold ``MIN_WORDS`` words, at most ``MAX_LINES``.
A gram of ``MIN_WORDS`` words always is a fingerprint; of every ``WINDOW`` consecutive grams the one of least hash
is one too.  So each repeated passage of at most ``MAX_LINES`` lines with ``MIN_WORDS`` words, or of
``MAX_LINES + WINDOW - 1`` lines, shares a fingerprint with its first occurrence.  A fingerprint is joined to its first position only, never to all;
the match is extended line by line both ways, and the later run is deleted.  A line goes only if an equal line
stands earlier in the order of documents, so the first occurrence of any line always stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexweave.llm.spans import whole_text
from lexweave.session import materialised

MIN_WORDS = 50
MAX_LINES = 3
WINDOW = 2
_LAST = (1 << 63) - 1
RUN = "struct<start:int,end:int>"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _gram(hashes: Column, words: Column, at: Column) -> Column:
    """Length of the gram that begins at line ``at`` (0-based); 0 if too few lines follow or a blank one begins it."""
    size = F.lit(0)
    for k in range(MAX_LINES, 0, -1):
        total = sum((F.coalesce(F.get(words, at + j), F.lit(0)) for j in range(k)), F.lit(0))
        enough = F.lit(True) if k == MAX_LINES else total >= MIN_WORDS
        size = F.when(enough & (at + k <= F.size(hashes)), F.lit(k)).otherwise(size)
    return F.when(F.get(words, at) > 0, size).otherwise(F.lit(0))


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id, text, hashes, words``: a hash and a word count per line; a blank line has 0 words."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                       whole_text(text_col).alias("text"))
    lines = rows.select("*", F.transform(_lines(F.col("text")), lambda x: F.trim(x)).alias("lines"))
    return lines.select("row", "doc_id", "text", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"),
                        F.transform("lines", lambda x: F.when(x == "", 0).otherwise(
                            F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).cast("int")).alias("words"))


def fingerprints(lines: DataFrame) -> DataFrame:
    """``row, doc_id, at, gram``: position and hash of each selected gram."""
    places = F.sequence(F.lit(0), F.size("hashes") - 1)
    # words of the longest gram: a shorter one is taken only if it holds MIN_WORDS by itself
    held = lambda i: sum((F.coalesce(F.get("words", i + j), F.lit(0)) for j in range(MAX_LINES)), F.lit(0))
    sized = lines.select("row", "doc_id", "hashes", F.transform(
        places, lambda i: _gram(F.col("hashes"), F.col("words"), i)).alias("sizes"),
        F.transform(places, lambda i: held(i) >= MIN_WORDS).alias("full"))
    hashed = sized.select("row", "doc_id", "full", F.transform("sizes", lambda k, i: F.when(
        k > 0, F.xxhash64(*[F.when(k > j, F.get("hashes", i + j)) for j in range(MAX_LINES)]))).alias("grams"))
    value = lambda i: F.coalesce(F.get("grams", i), F.lit(_LAST))

    def chosen(i: Column) -> Column:   # least of some window of WINDOW grams that holds it; the first window holds the rest
        least = F.lit(False)
        for back in range(WINDOW):
            start = F.greatest(i - back, F.lit(0))
            window = [value(start + j) for j in range(WINDOW)]
            least = least | (value(i) == F.least(*window))
        return F.get("grams", i).isNotNull() & (least | F.get("full", i))

    picked = hashed.select("row", "doc_id", "grams", F.filter(
        F.sequence(F.lit(0), F.size("grams") - 1), chosen).alias("at"))
    # the outer form adds no filter on the array, which would be computed again below for every line
    return picked.select("row", "doc_id", F.explode_outer("at").alias("at"), "grams").select(
        "row", "doc_id", "at", F.get("grams", F.col("at")).alias("gram")).filter("at IS NOT NULL")


def _equal_runs(mine: Column, other: Column, offset: Column) -> Column:
    """Maximal runs of lines equal to the other document's at a fixed offset."""
    start = F.struct(F.lit(-1).alias("open"), F.array().cast(f"array<{RUN}>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        same = F.when((i + offset >= 0) & (i + offset < F.size(other)) & (i < F.size(mine)),
                      F.get(mine, i) == F.get(other, i + offset)).otherwise(F.lit(False))
        closed = ~same & (acc["open"] >= 0)
        return F.struct(
            F.when(same, F.when(acc["open"] >= 0, acc["open"]).otherwise(i)).otherwise(F.lit(-1)).cast("int").alias("open"),
            F.when(closed, F.concat(acc["out"], F.array(F.struct(acc["open"].alias("start"), i.alias("end")).cast(RUN))))
            .otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.size(mine)), start, step, lambda acc: acc["out"])


def repeated_runs(lines: DataFrame) -> DataFrame:
    """``row, runs``: line ranges (0-based, end exclusive) to delete, one row per document that has any."""
    # a table without text to read: grams and hashes
    grams = materialised(fingerprints(lines), "fingerprints")
    place = F.struct(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("id"), "row", "at")
    first = (grams.groupBy("gram").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
             .select("gram", F.col("first.row").alias("from_row"), F.col("first.at").alias("from_at")))
    matches = (grams.join(first, "gram").filter((F.col("row") != F.col("from_row")) | (F.col("at") != F.col("from_at")))
               .groupBy("row", "from_row", (F.col("from_at") - F.col("at")).cast("int").alias("offset"))
               .agg(F.collect_set("at").alias("seeds")))
    hashes = lines.select("row", "hashes")
    # the match side may be skewed on a document that holds many first occurrences; the other side has unique rows
    both = (matches.join(hashes.hint("merge"), "row")
            .join(hashes.select(F.col("row").alias("from_row"), F.col("hashes").alias("other")).hint("merge"), "from_row"))
    runs = both.select("row", F.filter(
        _equal_runs(F.col("hashes"), F.col("other"), F.col("offset")),
        lambda r: F.exists("seeds", lambda s: (s >= r["start"]) & (s < r["end"]))).alias("runs"))
    return runs.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, removed, text`` of every row: deleted lines (sorted, 0-based) and the text without them.

    Documents are ordered by id (null ids last), then by their place in the table; the later copy of a passage
    goes, also within a text and between repeated rows.  Lines compare without spaces at their ends; blank lines
    begin no passage but go if they lie inside one.  A null text counts as empty: one blank line, never deleted.
    Only the id and text columns are read; an empty table gives no rows.
    """
    lines = materialised(line_table(docs, id_col, text_col), "lines")
    cuts = repeated_runs(lines.select("row", "doc_id", "hashes", "words"))
    none = F.array().cast("array<int>")
    rows = lines.select("row", "doc_id", "text", F.size("hashes").alias("n_lines")).join(cuts, "row", "left")
    removed = F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform(
        "runs", lambda r: F.sequence(r["start"], r["end"] - 1))))), none)
    marked = rows.select("doc_id", "text", "n_lines", removed.alias("removed"))
    kept = F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(F.filter(
        _lines(F.col("text")), lambda x, i: ~F.array_contains("removed", i)), "\n"))
    return marked.select("doc_id", "n_lines", "removed", kept.alias("text"))
