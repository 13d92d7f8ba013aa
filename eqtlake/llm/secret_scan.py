"""Secret scans with a trigram inverted index.

For each rule a Boolean trigram query is derived from its regular expression.
The index holds, for every trigram that some rule asks for, the rows in which it
occurs. Intersecting postings gives candidate rows for each rule; only their texts
meet them again and are verified by the expression. Rules without mandatory
trigrams scan every row. Rows are named by their id and a hash of their text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_side
from .spans import SPAN, at_end, in_order, match_spans, no_spans
from .trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """``group`` is the capture whose length must reach ``min_length``. With ``scan``
    texts are searched by that expression, which finds in linear time what
    ``pattern`` means, as its capture 1 at the end of the match."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1
    scan: str = ""


# The base rules.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Public formats of further credentials.
MORE_RULES = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abp]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule(
        "jwt",
        r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+",
        # From a run's head to its first eyJ; where that fails, so do later ones in it.
        scan=r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++)",
    ),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
#: Bits of a posting mask kept in one long column.
BITS = 60


def scan_pattern(rule: Rule) -> str:
    """The expression that finds the rule's matches.

    A rule that is one character class repeated can ask for its least length at
    once: a shorter run has no longer run inside. Others are filtered later, as
    a failing match still uses up its text.
    """
    simple = rule.group == 0 and rule.pattern.endswith("]+") and rule.min_length > 1
    if not simple:
        return rule.pattern
    fixed = rule.pattern.index("[")
    return f"{rule.pattern[:-1]}{{{rule.min_length - fixed},}}"


def vocabulary(rules: Sequence[Rule]) -> list[str]:
    """All trigrams that some rule's query mentions."""
    grams: set[str] = set()
    for rule in rules:
        for part in trigram_query(rule.pattern) or []:
            grams |= part
    return sorted(grams)


def postings(docs: DataFrame, grams: Sequence[str]) -> DataFrame:
    """The inverted index (doc_id, text_key, gram), ``gram`` as position in ``grams``."""
    lowered = docs.select("doc_id", "text_key", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return lowered.select("doc_id", "text_key", F.explode(found).alias("gram"))


def candidates(index: DataFrame, rules: Sequence[Rule], grams: Sequence[str]) -> DataFrame:
    """(doc_id, text_key, candidate_rules): rules whose query a row's postings satisfy.

    Postings are intersected as bit masks, combined before the shuffle, so that
    the longest posting list costs one row for each document at most.
    """
    place = {g: i for i, g in enumerate(grams)}
    words = range(-(-max(len(grams), 1) // BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram") % BITS)
    masks = index.groupBy("doc_id", "text_key").agg(
        *[F.bit_or(F.when(F.floor(F.col("gram") / BITS) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in words]
    )

    def holds(part: frozenset[str]) -> Column:
        tests = []
        for w in words:
            need = sum(1 << (place[g] % BITS) for g in part if place[g] // BITS == w)
            if need:
                tests.append(F.col(f"m{w}").bitwiseAND(F.lit(need)) == need)
        return reduce(lambda a, b: a & b, tests)

    hit = [
        F.when(reduce(lambda a, b: a | b, [holds(p) for p in query]), F.lit(rule.kind))
        for rule in rules
        if (query := trigram_query(rule.pattern)) is not None
    ]
    return masks.select("doc_id", "text_key", F.array_compact(F.array(*hit)).alias("candidate_rules")).where(
        F.size("candidate_rules") > 0
    )


def _long_enough(least: int) -> Callable[[Column], Column]:
    return lambda s: F.length(s["value"]) >= least


def _spans(rule: Rule, rank: int) -> Column:
    found = match_spans(F.col("text"), rule.scan or scan_pattern(rule), rule.kind, rank, 1 if rule.scan else rule.group)
    if rule.scan:
        found = F.transform(found, at_end)
    if rule.group and rule.min_length > 1:
        found = F.filter(found, _long_enough(rule.min_length))
    return found


def _joined(spans: list[Column]) -> Column:
    return F.concat(*spans) if spans else no_spans()


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, text_key, secrets) for every row of ``docs``.

    ``secrets`` is an array of (start, rank, end, kind, match, value) by start,
    positions in code points, end exclusive; ``text_key`` hashes the text. A null or
    empty text has none. Rows with a null or repeated doc_id are told apart by their
    text, so each gets its own result, and repeated rows the same one. Columns
    besides doc_id and text are ignored. An empty table gives an empty result.
    """
    grams = vocabulary(rules)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_key"))
    numbered = list(enumerate(rules))
    indexed = [x for x in numbered if trigram_query(x[1].pattern) is not None]
    scanned = rows.select("doc_id", "text_key", _joined([_spans(r, i) for i, r in numbered if (i, r) not in indexed]).alias("scanned"))
    if not indexed:
        return scanned.select("doc_id", "text_key", in_order(F.col("scanned")).cast(SPAN).alias("secrets"))

    def same(df: DataFrame) -> tuple[DataFrame, Column]:
        renamed = df.withColumnsRenamed({"doc_id": "c_id", "text_key": "c_key"})
        return renamed, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key"))

    wanted, on = same(materialize(candidates(postings(rows, grams), rules, grams), "secret-candidates"))
    verified = [F.when(F.array_contains("candidate_rules", r.kind), _spans(r, i)).otherwise(no_spans()) for i, r in indexed]
    texts = rows.join(small_side(wanted), on).select("doc_id", "text_key", _joined(verified).cast(SPAN).alias("verified"))
    # A row that comes twice has the same spans twice; one is enough.
    found = materialize(texts.where(F.size("verified") > 0).dropDuplicates(["doc_id", "text_key"]), "secret-verified")
    side, on = same(found)
    whole = F.concat("scanned", F.coalesce("verified", no_spans()))
    return scanned.join(small_side(side), on, "left").select("doc_id", "text_key", in_order(whole).cast(SPAN).alias("secrets"))
