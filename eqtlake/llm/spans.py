"""Spans of regular-expression matches as column expressions.

``split`` gives the gaps between matches and ``regexp_extract_all`` the matches
themselves, both leftmost and non-overlapping, so running sums of their lengths
give positions in code points without leaving the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let, running_sum, sha256_hex

SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,match:string,value:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def match_spans(text: Column, pattern: str, kind: str, rank: int, group: int = 0) -> Column:
    """Spans of ``pattern`` in ``text``; ``value`` is capture ``group``.

    The pattern must not match the empty string.
    """
    gaps = F.transform(F.split(text, pattern), lambda x: F.length(x))
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits

    def on(gaps: Column, hits: Column, values: Column) -> Column:
        steps = F.transform(hits, lambda x, i: F.get(gaps, i) + F.length(x))
        return let(
            running_sum(steps),
            lambda before: F.transform(
                hits,
                lambda x, i: F.struct(
                    (F.get(before, i) + F.get(gaps, i)).cast("long").alias("start"),
                    F.lit(rank).alias("rank"),
                    (F.get(before, i) + F.get(gaps, i) + F.length(x)).cast("long").alias("end"),
                    F.lit(kind).alias("kind"),
                    x.alias("match"),
                    F.get(values, i).alias("value"),
                ),
            ),
        )

    found = let(
        F.struct(gaps.alias("g"), hits.alias("h"), values.alias("v")),
        lambda s: F.when(F.size(s["h"]) > 0, on(s["g"], s["h"], s["v"]).cast(SPAN)).otherwise(no_spans()),
    )
    return F.when(text.rlike(pattern), found).otherwise(no_spans())


#: Code points of a chunk.
CHUNK = 64


def chunks(text: Column) -> Column:
    """The text cut into pieces of CHUNK code points, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(cut: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text that ``chunks`` has cut, so that a
    place far down costs no more than one at the head."""

    def on(first: Column) -> Column:
        last = F.floor((F.greatest(end, start + 1) - 1) / F.lit(CHUNK)).cast("int")
        whole = F.array_join(F.slice(cut, first + 1, last - first + 1), "")
        return F.substr(whole, (start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))

    return let(F.floor(start / F.lit(CHUNK)).cast("int"), on)


def at_end(span: Column) -> Column:
    """A span that is the capture at the end of its match."""
    return F.struct(
        (span["end"] - F.length(span["value"])).cast("long").alias("start"),
        span["rank"].alias("rank"),
        span["end"].alias("end"),
        span["kind"].alias("kind"),
        span["value"].alias("match"),
        span["value"].alias("value"),
    )


def in_order(spans: Column) -> Column:
    """Spans by start, then by the order of the kinds."""
    return F.sort_array(spans)


def digest(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def of_kinds(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def span_digests(spans: Column, kinds: Sequence[str]) -> list[Column]:
    """Counts of the base ``kinds``, ``base_sha256`` and ``spans``."""
    return [
        *[count_kind(spans, k).alias(f"n_{k}") for k in kinds],
        sha256_hex(digest(of_kinds(spans, kinds))).alias("base_sha256"),
        digest(spans).alias("spans"),
    ]
