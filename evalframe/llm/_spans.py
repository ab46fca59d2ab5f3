"""Spans of regular expressions inside Spark SQL, in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def find_spans(text: Column, kind: str, rank: int, pattern: str, keep, can_match: Column) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` that pass ``keep``.

    ``split`` gives what stands between the matches and ``regexp_extract_all``
    the matches; the running length of both gives the positions.  ``keep``
    maps the matched string to a condition; rejected matches are not retried.
    ``can_match`` is a cheap necessary condition, so that most texts skip the
    pattern.  Null text has no spans.  Result: array of (start, rank, kind,
    end, value), end exclusive, ordered by start.
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    step = F.aggregate(
        F.zip_with(gaps, found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit"))),
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN_TYPE})").alias("spans")),
        lambda acc, x: F.when(x["hit"].isNull(), acc).otherwise(F.struct(
            (acc["at"] + x["gap"] + F.length(x["hit"])).alias("at"),
            F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + x["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                (acc["at"] + x["gap"] + F.length(x["hit"])).alias("end"), x["hit"].alias("value")))).cast(SPAN_TYPE)
            .alias("spans"))),
        lambda acc: acc["spans"])
    return F.when(text.isNotNull() & can_match, F.filter(step, lambda s: keep(s["value"]))).otherwise(
        F.expr(f"cast(array() as {SPAN_TYPE})"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    return F.array_join(F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
