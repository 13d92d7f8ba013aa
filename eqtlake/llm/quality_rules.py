"""Host-level quality rules.

Rules are judged per document and failures are counted per host, for each rule and
for any of them. Rates are shrunk with an empirical beta prior of the rule, and the
verdicts are joined back: a host where most documents fail some rule goes as a
whole; where a host publishes a kind of junk habitually, its documents of that kind
go, while elsewhere a single failure is let pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, small_side, split_words, total

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Limits of the further rules: symbols for each hundred words, repeated lines in a
# hundred, and the mean length of words.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
WORD_LENGTH = (3, 10)
#: A host goes if the shrunk rate of documents that fail some rule is above this.
MAX_HOST_RATE = 0.5
#: A host where at least so many documents fail a rule does so by habit.
HABIT_RATE = 0.05
#: Bounds of the correlation of failures within a host; the prior counts as many
#: documents as one less than its inverse.
CORRELATION = (1e-6, 0.5)


def _covered(hashes: Column, width: int) -> Column:
    """Words covered by windows whose hash occurs more than once."""

    def from_sorted(s: Column) -> Column:
        twice = F.filter(
            F.transform(
                s,
                lambda x, k: F.when(
                    (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        )
        return let(
            F.sort_array(twice),
            lambda p: total(
                F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
            ),
        )

    pairs = F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    return let(F.sort_array(pairs), from_sorted)


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words in ``width``-word windows found twice or more in the document.

    Windows are compared by a 64-bit hash within one document.
    """

    def on(w: Column) -> Column:
        hashes = F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]),
        )
        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
                _covered(h, width)
            ),
        )

    return let(words, on)


def document_features(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = F.regexp_replace(text, r"[#*$%&|<>]+", "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = split_words(F.col("text"))
    counted = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    lined = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return docs.select(
        "doc_id",
        F.col(host).alias("host"),
        counted.alias("c"),
        (F.length(text) - F.length(plain)).cast("long").alias("n_symbols"),
        lined.alias("l"),
    ).select("doc_id", "host", "c.n_words", "c.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "c.n_repeat_words")


def rules() -> dict[str, Column]:
    """Whether a document fails each rule; the first two condemn it by themselves."""
    words = F.col("n_words")
    return {
        "short": words < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * words,
        "symbols": 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * words,
        "lines": 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"),
        "word_length": (F.col("word_chars") < WORD_LENGTH[0] * words) | (F.col("word_chars") > WORD_LENGTH[1] * words),
    }


BASE = ("short", "repeats")
ANY = "any"


def failures() -> Column:
    """Names of the rules that a document fails, as array."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in rules().items()]))


def host_verdicts(features: DataFrame, max_rate: float = MAX_HOST_RATE, habit: float = HABIT_RATE) -> DataFrame:
    """(host, n, rates, host_ok, habits) from features that have ``failed``.

    ``rates`` maps each rule, and "any", to the host's shrunk rate. A rule's prior
    has the mean m of all documents, and its strength from the hosts' rates by the
    method of moments: the sum of n (rate - m)^2 over hosts, less what binomial noise
    gives, is what failures within a host are correlated by. Hosts of one document
    say nothing of that and are shrunk to the mean; so are all where hosts do not
    differ by more than noise.
    """
    names = [*rules(), ANY]
    hosts = materialize(
        features.groupBy("host").agg(
            F.count("*").alias("n"),
            *[F.count_if(F.array_contains("failed", name)).alias(name) for name in names[:-1]],
            F.count_if(F.size("failed") > 0).alias(ANY),
        ),
        "quality-hosts",
    )
    n = F.col("n").cast("double")
    row = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum(n).alias("n_docs"),
        F.sum(n * n).alias("squares"),
        *[F.sum(F.col(c).cast("double")).alias(f"{c}_failed") for c in names],
        *[F.sum(F.col(c) * F.col(c) / n).alias(f"{c}_spread") for c in names],
    ).first()

    def shrunk(name: str) -> Column:
        docs = row["n_docs"] or 1.0
        m = (row[f"{name}_failed"] or 0.0) / docs
        depth = (docs - row["hosts"]) - ((row["squares"] or 0.0) - docs) / docs
        found = 0.0
        if 0 < m < 1 and depth > 0:
            spread = row[f"{name}_spread"] - row[f"{name}_failed"] * row[f"{name}_failed"] / docs
            found = (spread / (m * (1 - m)) - (row["hosts"] - 1)) / depth
        strength = 1 / min(max(found, CORRELATION[0]), CORRELATION[1]) - 1
        return (F.col(name) + F.lit(m * strength)) / (n + F.lit(strength))

    rates = hosts.select("host", "n", F.create_map(*[x for c in names for x in (F.lit(c), shrunk(c))]).alias("rates"))
    habits = F.array_compact(F.array(*[F.when(F.col("rates")[c] >= habit, F.lit(c)) for c in names[:-1]]))
    return rates.select("host", "n", "rates", (F.col("rates")[ANY] <= max_rate).alias("host_ok"), habits.alias("habits"))


def quality_rules(
    docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE, habit: float = HABIT_RATE
) -> DataFrame:
    """Features, ``failed``, ``base_failed``, ``host_rate`` and ``kept`` for every row.

    ``failed`` names the rules that the document fails. ``kept`` is false if it
    fails a rule of BASE; else it is the host's verdict: false if the host goes as a
    whole, or if the document fails a rule that its host fails by habit. Null texts
    have no words and fail; null hosts form one host. Repeated rows count each, and
    rows that share an id or have none are judged one by one. An empty table gives
    an empty result. Columns besides doc_id, text and the host are ignored.
    """
    judged = document_features(docs, host).withColumn("failed", failures())
    features = materialize(
        judged.withColumn("base_failed", F.arrays_overlap("failed", F.array(*map(F.lit, BASE)))), "quality-features"
    )
    verdicts = host_verdicts(features, max_rate, habit).select(
        F.col("host").alias("v_host"), F.col("rates")[ANY].alias("host_rate"), "host_ok", "habits"
    )
    return (
        features.join(small_side(verdicts), F.col("host").eqNullSafe(F.col("v_host")), "left")
        .withColumn("kept", ~F.col("base_failed") & F.col("host_ok") & ~F.arrays_overlap("failed", "habits"))
        .drop("v_host", "host_ok", "habits", "n_lines")
    )
