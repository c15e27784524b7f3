"""Positions of regular-expression matches with DataFrame functions, in code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CHUNK = 128          # matches summed at a time, so that a text of many matches costs little more than linear time
CONTEXT = 64         # characters kept on either side of a match
MATCH = "struct<start:int,end:int,body:string,left:string,right:string>"


def whole_text(col: str) -> Column:
    """The text; null as the empty one."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def with_matches(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Add for each name an array of its leftmost, non-overlapping matches (``MATCH``), in order.

    The text is searched for matches, and cut at them only if there are any.  The pieces between matches and
    the matches' lengths then give the positions.
    """
    first = df.select("*", *[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias(f"__hits_{n}")
                             for n, p in patterns.items()])
    second = first.select("*", *[
        F.when(F.size(f"__hits_{n}") > 0, F.split(F.col(text), p, -1)).alias(f"__cuts_{n}") for n, p in patterns.items()])
    kept = [c for c in second.columns if not c.startswith(("__hits_", "__cuts_"))]
    third = second.select(*kept, *[
        F.when(F.size(f"__hits_{n}") > 0, F.zip_with(
            F.zip_with(F.slice(f"__cuts_{n}", F.lit(1), F.size(f"__hits_{n}")), F.col(f"__hits_{n}"),
                       lambda gap, body: F.struct(F.length(gap).alias("gap"), body.alias("body"),
                                                  F.right(gap, F.lit(CONTEXT)).alias("left"))),
            F.slice(f"__cuts_{n}", F.lit(2), F.size(f"__hits_{n}")),
            lambda pair, after: F.struct(pair["gap"].alias("gap"), F.length(pair["body"]).alias("long"),
                                         pair["body"].alias("body"), pair["left"].alias("left"),
                                         F.left(after, F.lit(CONTEXT)).alias("right")))).alias(f"__pairs_{n}")
        for n in patterns])
    fourth = third.select(*kept, *[
        F.when(F.col(f"__pairs_{n}").isNotNull(), F.transform(
            F.sequence(F.lit(0), F.floor((F.size(f"__pairs_{n}") - 1) / F.lit(CHUNK)).cast("int")),
            lambda c: F.slice(F.col(f"__pairs_{n}"), c * CHUNK + 1, CHUNK))).alias(f"__chunks_{n}") for n in patterns])
    fifth = fourth.select("*", *[
        F.when(F.col(f"__chunks_{n}").isNotNull(), F.aggregate(
            F.transform(f"__chunks_{n}", lambda chunk: F.aggregate(
                chunk, F.lit(0), lambda at, m: (at + m["gap"] + m["long"]).cast("int"))),
            F.array(F.lit(0)),
            lambda done, size: F.concat(done, F.array((F.element_at(done, -1) + size).cast("int"))))).alias(f"__offsets_{n}")
        for n in patterns])

    def located(chunk: Column, offset: Column) -> Column:
        start = F.struct(offset.cast("int").alias("at"), F.array().cast(f"array<{MATCH}>").alias("out"))
        return F.aggregate(chunk, start, lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + m["long"]).cast("int").alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + m["gap"]).cast("int").alias("start"),
                (acc["at"] + m["gap"] + m["long"]).cast("int").alias("end"),
                m["body"].alias("body"), m["left"].alias("left"), m["right"].alias("right"))).cast(f"array<{MATCH}>")
            ).alias("out")), lambda acc: acc["out"])

    none = F.array().cast(f"array<{MATCH}>")
    return fifth.select(*kept, *[
        F.coalesce(F.when(F.col(f"__chunks_{n}").isNotNull(), F.flatten(F.zip_with(
            F.col(f"__chunks_{n}"), F.slice(f"__offsets_{n}", F.lit(1), F.size(f"__chunks_{n}")), located))), none).alias(n)
        for n in patterns])


def tagged(matches: Column, kind: str, rank: int) -> Column:
    """``kind, rank, start, end`` of the matches."""
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"),
                                                   m["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(
        s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
