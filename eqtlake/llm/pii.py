"""Personal data: expressions propose spans, checksums confirm them, context
words near a span adjust its score."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, total
from .spans import between, chunks, in_order, match_spans, no_spans

#: Code points before and after a span in which context words count.
CONTEXT = 60
THRESHOLD = 0.5
BONUS = 0.35


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass the Luhn checksum."""

    def check(d: Column) -> Column:
        places = F.transform(
            F.split(F.reverse(d), ""),
            lambda c, i: let(
                F.coalesce(c.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, F.lit(2)).otherwise(F.lit(1)),
                lambda v: F.when(v > 9, v - 9).otherwise(v),
            ),
        )
        return total(places) % 10 == 0

    return let(digits_of(value), check)


def mod97(value: Column) -> Column:
    """Whether an account number in ISO 13616 form leaves 1 modulo 97."""
    turned = F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))
    step = F.transform(F.split(turned, ""), lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), F.lit(48)).otherwise(F.lit(55)))
    rest = F.aggregate(
        F.filter(step, lambda x: x.between(0, 35)),
        F.lit(0).cast("long"),
        lambda acc, x: (acc * F.when(x > 9, F.lit(100)).otherwise(F.lit(10)) + x) % 97,
    )
    return rest == 1


def whole_account(value: Column) -> Column:
    """The longest run of groups from the head on that is an account number, as
    words after it may look like groups; null if there is none."""

    def on(groups: Column) -> Column:
        heads = F.transform(
            F.reverse(F.sequence(F.lit(1), F.size(groups))), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " ")
        )
        plain = lambda x: F.regexp_replace(x, " ", "")
        return F.get(F.filter(heads, lambda x: F.length(plain(x)).between(15, 34) & mod97(plain(x))), F.lit(0))

    return let(F.split(value, " "), on)


def ip_parts(value: Column) -> Column:
    octet = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return value.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$")


def digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda value: F.length(digits_of(value)).between(low, high)


@dataclass(frozen=True)
class Detector:
    """``needs`` are characters without which a text has no match. With ``ahead``
    the pattern matches a head, looks ahead for the span in group 1, and ``ahead``
    gives the span of that or null, so that candidates may overlap."""

    kind: str
    pattern: str
    valid: Callable[[Column], Column] | None
    score: float
    context: tuple[str, ...]
    needs: str = ""
    ahead: Callable[[Column], Column] | None = None


# Base kinds. The expressions state the asked-for ones with possessive
# repeats and a start at the run's head or the previous match's end (\G), which
# match the same spans in linear time.
BASE = (
    Detector(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        None,
        0.9,
        ("mail", "contact", "write"),
        "@",
    ),
    Detector("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ip_parts, 0.6, ("ip", "host", "server", "address")),
    Detector(
        "card",
        r"[0-9](?:[\x20-]?[0-9])++",
        lambda v: digit_count(14, 19)(v) & luhn(v),
        0.8,
        ("card", "visa", "credit", "payment"),
    ),
    Detector(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", digit_count(10, 15), 0.6, ("phone", "call", "tel", "mobile"), "+"
    ),
)
# Further kinds.
MORE = (
    Detector("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9_])", mod97, 0.8, ("iban", "account", "bank")),
    # What a base match swallows with its neighbours: numbers set apart by blanks.
    Detector(
        "card_run",
        r"(?<![A-Za-z0-9_])[0-9]{14,19}(?![A-Za-z0-9_])",
        luhn,
        0.7,
        ("card", "visa", "credit", "payment"),
    ),
    Detector("phone_nanp", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![A-Za-z0-9_])", None, 0.6, ("phone", "call", "tel"), "+"),
    Detector("ssn", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", None, 0.3, ("ssn", "social", "security")),
    # Printed in groups, with other groups before or after them.
    Detector(
        "card_groups",
        r"(?<![A-Za-z0-9_])(?=([0-9]{4}[\x20-](?:[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}|[0-9]{6}[\x20-][0-9]{5}))(?![A-Za-z0-9_]))[0-9]{4}",
        None,
        0.7,
        ("card", "visa", "credit", "payment"),
        ahead=lambda v: F.when(luhn(v), v),
    ),
    Detector(
        "iban_groups",
        r"(?<![A-Za-z0-9_])(?=([A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}(?![A-Za-z0-9_])){2,7}(?:\x20[A-Z0-9]{1,3}(?![A-Za-z0-9_]))?))[A-Z]{2}[0-9]{2}",
        None,
        0.8,
        ("iban", "account", "bank"),
        ahead=whole_account,
    ),
)
DETECTORS = BASE + MORE


def find_pii(docs: DataFrame, detectors: Sequence[Detector] = DETECTORS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text, pii) for every row of ``docs``.

    ``pii`` is an array of (start, rank, end, kind, match, value, score) by start,
    in code points, end exclusive. Each kind's matches are leftmost and do not
    overlap each other; a match that its validator refuses is dropped. A context
    word within CONTEXT code points raises the score by BONUS; spans below the
    threshold are dropped. Null and empty texts have none. Rows are independent,
    so repeated or null ids, ties and empty tables need no care; columns besides
    doc_id and text are ignored.
    """
    return annotate(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), detectors, threshold)


def annotate(docs: DataFrame, detectors: Sequence[Detector] = DETECTORS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the column ``pii`` added (replaced, if there is one)."""
    text = F.coalesce("text", F.lit(""))
    parts = [_found(text, rank, d, threshold) for rank, d in enumerate(detectors)]
    return docs.withColumn("pii", in_order(F.concat(*parts)))


def _found(text: Column, rank: int, detector: Detector, threshold: float) -> Column:
    spans = match_spans(text, detector.pattern, detector.kind, rank, 1 if detector.ahead else 0)
    if detector.ahead is not None:
        spans = F.filter(F.transform(spans, lambda s: _reaching(s, detector.ahead(s["value"]))), lambda s: s["value"].isNotNull())
    if detector.valid is not None:
        spans = F.filter(spans, lambda s: detector.valid(s["match"]))
    near = r"(?i)(?<![A-Za-z0-9_])(" + "|".join(detector.context) + r")"

    def scored(s: Column, cut: Column) -> Column:
        before = between(cut, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"])
        after = between(cut, s["end"], s["end"] + CONTEXT)
        score = F.when(F.concat_ws(" ", before, after).rlike(near), F.lit(min(1.0, detector.score + BONUS)))
        return _with_score(s, score.otherwise(F.lit(detector.score)))

    none = F.transform(no_spans(), lambda s: _with_score(s, F.lit(0.0)))
    in_context = let(
        F.struct(spans.alias("s"), chunks(text).alias("c")), lambda x: F.transform(x["s"], lambda s: scored(s, x["c"]))
    )
    # Texts are cut only where there is a span.
    kept = F.filter(F.when(F.size(spans) > 0, in_context).otherwise(none), lambda s: s["score"] >= threshold)
    if detector.needs:
        kept = F.when(F.contains(text, F.lit(detector.needs)), kept).otherwise(none)
    return kept


def _reaching(span: Column, value: Column) -> Column:
    return let(
        value,
        lambda v: F.struct(
            span["start"].alias("start"),
            span["rank"].alias("rank"),
            (span["start"] + F.length(v)).cast("long").alias("end"),
            span["kind"].alias("kind"),
            v.alias("match"),
            v.alias("value"),
        ),
    )


def _with_score(span: Column, score: Column) -> Column:
    fields = ("start", "rank", "end", "kind", "match", "value")
    return F.struct(*[span[k].alias(k) for k in fields], score.alias("score"))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by ``[KIND]``; of spans that overlap, the
    first stays and what it covers of the next goes with it.

    One pass: each span yields the text since the farthest earlier end and, if
    anything of it is not yet covered, its label.
    """

    def on(s: Column, cut: Column) -> Column:
        # Spans are by start; the farthest end before span i, by blocks of 64.
        ends = F.transform(s, lambda x: x["end"])

        def reach(e: Column) -> Column:
            blocks = F.transform(
                F.sequence(F.lit(0), F.floor((F.size(e) - 1) / F.lit(64)).cast("int")),
                lambda b: F.array_max(F.slice(e, b * 64 + 1, F.lit(64))),
            )
            heads = let(blocks, lambda m: F.transform(m, lambda x, b: F.coalesce(F.array_max(F.slice(m, F.lit(1), b)), F.lit(0).cast("long"))))
            return let(
                heads,
                lambda h: F.transform(
                    e,
                    lambda x, i: F.greatest(
                        F.get(h, F.floor(i / F.lit(64)).cast("int")),
                        F.coalesce(F.array_max(F.slice(e, i - i % 64 + 1, i % 64)), F.lit(0).cast("long")),
                    ),
                ),
            )

        pieces = let(
            let(ends, reach),
            lambda r: F.transform(
                s,
                lambda x, i: F.when(
                    x["start"] >= F.get(r, i),
                    F.concat(
                        between(cut, F.get(r, i), x["start"]),
                        F.lit("["),
                        F.upper(x["kind"]),
                        F.lit("]"),
                    ),
                ).otherwise(F.lit("")),
            ),
        )
        tail = F.substr(text, (F.array_max(ends) + 1).cast("int"))
        return F.concat(F.array_join(pieces, ""), tail)

    parts = F.struct(spans.alias("s"), chunks(text).alias("c"))
    return F.when(F.size(spans) == 0, text).otherwise(let(parts, lambda x: on(x["s"], x["c"])))
