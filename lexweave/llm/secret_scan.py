"""Secret scan: assignments, access keys, hexadecimal runs, and windows of high entropy (DataFrame functions only).

The entropy scan slides a window of fixed length over each candidate string.  Counts of the characters in
the window are kept per step, one entering and one leaving, and with them the sum of c*log2(c), from which
the Shannon entropy of the window follows.  Sums are integers (scaled), so nothing drifts on long strings.
Candidates that an allow-list pattern matches are suppressed; spans of the base patterns always stay.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from lexweave.llm.spans import joined, tagged, whole_text, with_matches

# The base patterns.  The minimal lengths of access and hex are part of the pattern, which finds
# the same spans as dropping shorter matches, because a match always extends to the end of its run.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
ASSIGN_LENGTH = 6

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
HEX_BITS = 3.0       # least entropy of a window whose candidate has hexadecimal characters only
MIXED_BITS = 3.6     # of any other candidate
ALLOW_LIST = (       # candidates that look random but are no secrets
    r"(?i)example|sample|dummy|placeholder|changeme",
    r"(?i)0123456789|abcdefgh|(.)\1{7}",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)
SCALE = 1 << 20
KINDS = ("assign", "access", "hex", "entropy")


def _clog(count: int) -> int:
    return round(count * math.log2(count) * SCALE) if count > 1 else 0


def _limit(bits: float, window: int) -> int:
    """Largest scaled sum of c*log2(c) at which the window's entropy still reaches ``bits``."""
    return math.floor((math.log2(window) - bits) * window * SCALE)


def entropy_windows(body: Column, offset: Column, window: int, hex_bits: float, mixed_bits: float) -> Column:
    """Spans covered by windows of high entropy in one candidate: array of ``start, end``, by code point."""
    clog = F.array(*[F.lit(_clog(c)).cast("bigint") for c in range(window + 2)])
    limit = F.when(body.rlike("^[0-9a-fA-F]+$"), F.lit(_limit(hex_bits, window))).otherwise(F.lit(_limit(mixed_bits, window)))

    def place(at: Column) -> Column:   # 1, 2, ... in the alphabet; 0 before the string begins
        return F.when(at >= 1, F.instr(F.lit(ALPHABET), F.substr(body, at, F.lit(1)))).otherwise(F.lit(0)).cast("int")

    def count(counts: Column, which: Column) -> Column:
        return F.coalesce(F.get(counts, which - 1), F.lit(0)).cast("int")

    def step(acc: Column, at: Column) -> Column:
        enters, leaves = place(at), place(at - window)
        counts = F.transform(acc["counts"], lambda c, i: (
            c + (i + 1 == enters).cast("int") - (i + 1 == leaves).cast("int")).cast("int"))
        c_in = count(acc["counts"], enters)
        c_out = (count(acc["counts"], leaves) + (enters == leaves).cast("int")).cast("int")
        total = (acc["total"] + F.get(clog, c_in + 1) - F.get(clog, c_in)
                 + F.when(leaves > 0, F.get(clog, c_out - 1) - F.get(clog, c_out)).otherwise(F.lit(0)))
        hot = (at >= window) & (total <= limit)
        apart = hot & (acc["last"] >= 0) & (at - window > acc["last"])
        fresh = hot & ((acc["last"] < 0) | apart)
        return F.struct(
            counts.alias("counts"), total.cast("bigint").alias("total"),
            F.when(fresh, at - window).otherwise(acc["open"]).cast("int").alias("open"),
            F.when(hot, at).otherwise(acc["last"]).cast("int").alias("last"),
            F.when(apart, F.concat(acc["out"], F.array(F.struct(acc["open"].alias("start"), acc["last"].alias("end")))))
            .otherwise(acc["out"]).cast("array<struct<start:int,end:int>>").alias("out"))

    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("bigint").alias("total"),
        F.lit(-1).alias("open"), F.lit(-1).alias("last"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    found = F.aggregate(F.sequence(F.lit(1), F.length(body)), start, step, lambda acc: F.when(
        acc["last"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["open"].alias("start"), acc["last"].alias("end")))))
        .otherwise(acc["out"]))
    return F.transform(found, lambda s: F.struct((s["start"] + offset).alias("start"), (s["end"] + offset).alias("end")))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 hex_bits: float = HEX_BITS, mixed_bits: float = MIXED_BITS,
                 allow_list: tuple[str, ...] = ALLOW_LIST) -> DataFrame:
    """``doc_id, secrets`` with ``secrets`` an array of ``start, rank, end, kind`` sorted by start, then kind.

    Every row of ``docs`` gives a row, repeated rows too.  A null or empty text has no secrets.  Only the id
    and text columns are read.  Nothing is shuffled: a text's work is its own, linear in its length.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    rows = with_matches(rows, "text", {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidate": CANDIDATE}).drop("text")
    assign = F.filter("assign", lambda m: F.length(F.regexp_extract(m["body"], ASSIGN, 2)) >= ASSIGN_LENGTH)

    def suspicious(m: Column) -> Column:   # letters and digits mixed, and on no allow-list
        good = m["body"].rlike("[0-9]") & m["body"].rlike("[A-Za-z]")
        for allowed in allow_list:
            good = good & ~m["body"].rlike(allowed)
        return good

    windows = F.flatten(F.transform(F.filter("candidate", suspicious), lambda m: entropy_windows(
        m["body"], m["start"], window, hex_bits, mixed_bits)))
    return rows.select("doc_id", F.array_sort(F.concat(
        tagged(assign, "assign", 0), tagged(F.col("access"), "access", 1), tagged(F.col("hex"), "hex", 2),
        tagged(windows, "entropy", 3))).alias("secrets"))
