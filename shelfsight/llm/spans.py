"""Places of regular-expression matches as arrays of spans, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SPANS = "array<struct<start:int,end:int,found:string>>"


def match_spans(text: Column, pattern: Column, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: start and end in code points, and the group's text.

    Splitting by the pattern gives what lies between the matches, so the lengths of the parts and
    of the matches add up to the places. The pattern must not match the empty string.
    """
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    found = whole if not group else F.regexp_extract_all(text, pattern, F.lit(group))
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), found.alias("found"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(NO_SPANS).alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        start = acc["at"] + F.length(piece["gap"])
        end = start + F.coalesce(F.length(piece["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), piece["found"].alias("found"))
        return F.struct(end.alias("at"), F.when(piece["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])


def spans_where(condition: Column, text: Column, pattern: str, group: int = 0) -> Column:
    """The same, evaluated only where a cheap condition says that there may be a match."""
    return F.when(condition, match_spans(text, F.lit(pattern), group)).otherwise(F.array().cast(NO_SPANS))
