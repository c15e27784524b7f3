"""Personal data: base patterns, and identifiers found by bootstrapped contexts (DataFrame functions only).

Base spans are the seeds.  Every seed, and every other token with digits, is a mention.  The nearest word before it,
the nearest word after it, and both together are its lexical patterns; punctuation and digits between are passed
over.  The graph of distinct patterns and distinct values is scored in rounds: a pattern's confidence is the mean
score of its values, an unlabelled value's score the best confidence among its well supported patterns.  Mentions
with a pattern of high confidence are reported as kind ``id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexweave.llm.spans import joined, tagged, whole_text, with_matches
from lexweave.session import materialised

# The base patterns, as possessive forms with the same matches.  A search starts only where a run
# of its first class starts or where the previous match ended, so a long run is not tried from each character.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
KINDS = (*BASE, "id")

SPACE = r"\x20\x09-\x0D"
TOKEN = rf"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+"
LEAST_DIGITS = 4         # of a token that may be an identifier
ROUNDS = 3
LEAST_SUPPORT = 5.0      # summed score of a pattern's distinct values
LEAST_CONFIDENCE = 0.9


def luhn(body: Column) -> Column:
    """Whether the digits of ``body`` have a valid check sum."""
    digits = F.reverse(F.regexp_replace(body, "[^0-9]", ""))
    values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substr(digits, i, F.lit(1)).cast("int"))
    total = F.aggregate(F.transform(values, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)),
                        F.lit(0), lambda a, d: (a + d).cast("int"))
    return total % 10 == 0


def _digits(body: Column) -> Column:
    return F.length(F.regexp_replace(body, "[^0-9]", ""))


def _octet(part: Column) -> Column:
    value = F.regexp_replace(part, "^0+", "")
    return (F.length(value) < 3) | ((F.length(value) == 3) & (value <= "255"))


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m["body"], r"\."), _octet),
    # the digit count is tested first, so a long run of digits is not summed
    "card": lambda m: F.when(_digits(m["body"]).between(13, 19), luhn(m["body"])).otherwise(F.lit(False)),
    "phone": lambda m: _digits(m["body"]).between(9, 15),
}


def _patterns(m: Column) -> Column:
    """``left|``, ``|right`` and ``left|right`` of the mention, as far as there are words."""
    left = F.lower(F.regexp_extract(m["left"], r"(\p{L}++)[^\p{L}]*+$", 1))
    right = F.lower(F.regexp_extract(m["right"], r"^[^\p{L}]*+(\p{L}++)", 1))
    bar = F.lit("|")
    return F.filter(F.array(F.when(left != "", F.concat(left, bar)), F.when(right != "", F.concat(bar, right)),
                            F.when((left != "") & (right != ""), F.concat(left, bar, right))), lambda p: p.isNotNull())


def _bare(m: Column) -> Column:
    """The match without what is neither letter nor digit at its ends."""
    lead = F.length(m["body"]) - F.length(F.regexp_replace(m["body"], r"^[^\p{L}0-9]+", ""))
    core = F.regexp_replace(m["body"], r"^[^\p{L}0-9]+|[^\p{L}0-9]+$", "")
    start = (m["start"] + lead).cast("int")
    return F.struct(start.alias("start"), (start + F.length(core)).cast("int").alias("end"), core.alias("body"),
                    m["left"].alias("left"), m["right"].alias("right"))


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row, doc_id``, the valid base matches per kind, and ``mentions`` (start, end, value, patterns, seed)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                       whole_text(text_col).alias("text"))
    rows = with_matches(rows, "text", {**BASE, "token": TOKEN}).drop("text")
    rows = rows.select("row", "doc_id", "token", *[F.filter(k, _VALID[k]).alias(k) for k in BASE])
    seeds = F.concat(*BASE)

    def free(m: Column) -> Column:
        return (_digits(m["body"]) >= LEAST_DIGITS) & ~F.exists(
            seeds, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))

    def mention(seed: bool):
        return lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.sha2(m["body"], 256).alias("value"),
                                  _patterns(m).alias("patterns"), F.lit(seed).alias("seed"))

    spans = [F.transform(k, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias(k) for k in BASE]
    return rows.select("row", "doc_id", *spans, F.concat(
        F.transform(seeds, mention(True)), F.transform(F.transform(F.filter("token", free), _bare), mention(False))).alias("mentions"))


def score_patterns(mentions: DataFrame, rounds: int = ROUNDS, least_support: float = LEAST_SUPPORT) -> DataFrame:
    """``pattern, confidence, support`` from ``pattern, value, seed``, after ``rounds`` passes over the graph."""
    # equal edges are merged before anything is joined, so copies of a document count once
    edges = materialised(mentions.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    # a value that is a seed anywhere is a seed everywhere
    scores = edges.groupBy("value").agg(F.max("seed").cast("double").alias("score"))
    labels = materialised(scores, "seeds")
    scores = labels
    for turn in range(rounds):
        patterns = materialised(edges.join(scores, "value").groupBy("pattern").agg(
            F.avg("score").alias("confidence"), F.sum("score").alias("support")), "patterns")
        if turn + 1 < rounds:
            reached = (edges.join(patterns.filter(F.col("support") >= least_support), "pattern")
                       .groupBy("value").agg(F.max("confidence").alias("reach")))
            scores = materialised(labels.join(reached, "value", "left").select(
                "value", F.greatest("score", F.coalesce("reach", F.lit(0.0))).alias("score")), "scores")
    return patterns


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
             least_support: float = LEAST_SUPPORT, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """``doc_id`` and arrays of spans (``start, end``) ``email, ip, card, phone, id`` of every row of ``docs``.

    Repeated rows give a row each, also with equal or null ids.  A null or empty text has empty arrays; a table
    without mentions finds no identifiers.  Only the id and text columns are read.
    """
    rows = materialised(base_spans(docs, id_col, text_col), "mentions")
    mentions = rows.select("row", F.inline("mentions")).withColumn("pattern", F.explode("patterns")).drop("patterns")
    sure = (score_patterns(mentions, rounds, least_support)
            .filter((F.col("confidence") >= least_confidence) & (F.col("support") >= least_support)).select("pattern"))
    found = (mentions.filter(~F.col("seed")).join(sure, "pattern", "left_semi")
             .groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("id")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return rows.drop("mentions").join(found, "row", "left").select("doc_id", *BASE, F.coalesce("id", none).alias("id"))


def all_spans() -> Column:
    """All spans by kind as listed, then start."""
    return F.concat(*[tagged(F.array_sort(F.col(k)), k, i) for i, k in enumerate(KINDS)])


__all__ = ["find_pii", "score_patterns", "base_spans", "all_spans", "joined"]
