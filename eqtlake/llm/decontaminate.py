"""Benchmark decontamination by winnowing.

Documents and items are fingerprinted alike: of each run of w successive k-gram
hashes the least is kept, so that any shared stretch of k + w - 1 words shares a
fingerprint. Documents that share one are read again: their k-grams meet the
fingerprints once more, by hash, which places the hits; around each the hit is
extended to every window of the item's length, and windows are compared word for
word. An item below the window has one fingerprint, of all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, materialize, sha256_hex, small_side, total

WINDOW = 13
K = 5
#: Everything outside letters, digits and non-ASCII characters, after lower-casing.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAKS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A document is contaminated if this share of its words is hit.
MIN_SHARE = 20


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def gram_hashes(words: Column, n: int) -> Column:
    """Hash of each run of ``n`` words of a bound array."""
    return F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, n)]),
    )


def winnowed(words: Column, k: int, span: int) -> Column:
    """Distinct least hashes of the runs of ``span`` k-grams of a bound array."""
    return let(
        gram_hashes(words, k),
        lambda h: F.array_distinct(
            F.transform(
                F.slice(h, F.lit(1), F.greatest(F.size(h) - (span - 1), F.lit(0))),
                lambda x, j: F.array_min(F.slice(h, j + 1, F.lit(span))),
            )
        ),
    )


def fingerprints(words: Column, short: list[int], window: int, k: int) -> Column:
    """array<struct<n, h>>: winnowed k-grams under n = ``window``, and for each
    length in ``short`` (items below the window) all grams of that length."""

    def tagged(n: int, hashes: Column) -> Column:
        return F.transform(hashes, lambda h: F.struct(F.lit(n).alias("n"), h.alias("h")))

    parts = [lambda w: tagged(window, winnowed(w, k, window - k + 1))]
    parts += [lambda w, m=m: tagged(m, F.array_distinct(gram_hashes(w, m))) for m in short]
    return let(words, lambda w: F.concat(*[p(w) for p in parts]))


def item_prints(benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """(n, h): the winnowed k-grams of items under n = ``window``, and of items of
    fewer words the hash of all of them under their number of words."""

    def whole(w: Column) -> Column:
        by_size = [F.when(F.size(w) == m, gram_hashes(w, m)) for m in range(1, window)]
        return F.coalesce(*by_size, winnowed(w, k, window - k + 1))

    words = benchmark.select(item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    prints = words.select(F.least(F.size("w"), F.lit(window)).alias("n"), F.explode(let(F.col("w"), whole)).alias("h"))
    return prints.distinct()


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, n, win): the windows of the items as text; an item of fewer words
    is one window, one without words has none."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), item_words(F.col("text")).alias("w"))
    n = F.least(F.size("w"), F.lit(window))
    return (
        words.where(F.size("w") > 0)
        .select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
        .select("item", "n", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("win"))
        .distinct()
    )


def _placed(words: DataFrame, prints: DataFrame, short: list[int], window: int, k: int) -> DataFrame:
    """(doc_id, text_key, n, s): starts of the windows around grams whose hash is a
    fingerprint, of rows (doc_id, text_key, w)."""

    def tagged(w: Column, n: int, width: int) -> Column:
        return F.transform(gram_hashes(w, width), lambda h, p: F.struct(F.lit(n).alias("n"), h.alias("h"), p.alias("p")))

    sizes = [(window, k), *((m, m) for m in short)]
    grams = words.select(
        "doc_id",
        "text_key",
        F.size("w").alias("size"),
        F.explode(let(F.col("w"), lambda w: F.concat(*[tagged(w, *x) for x in sizes]))).alias("g"),
    ).select("doc_id", "text_key", "size", "g.n", "g.h", "g.p")
    back = F.when(F.col("n") == window, F.lit(window - k)).otherwise(F.lit(0))
    low, high = F.greatest(F.col("p") - back, F.lit(0)), F.least(F.col("p"), F.col("size") - F.col("n"))
    around = grams.join(prints, ["n", "h"], "left_semi").select("doc_id", "text_key", "n", low.alias("low"), high.alias("high"))
    return around.where("low <= high").select("doc_id", "text_key", "n", F.explode(F.sequence("low", "high")).alias("s"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, text_key, spans, n_hit, items): documents with hit words.

    ``spans`` are the windows found, by start: first word and end. ``items`` are the sorted ids, as text, of the items with windows in the
    document. ``text_key`` hashes the text, so that rows which share an id but
    not the text keep their own hits.
    """
    items = materialize(item_windows(benchmark, window), "decon-windows")
    # At most window - 1 numbers: the lengths of items below the window.
    short = sorted(r["n"] for r in items.where(F.col("n") < window).select("n").distinct().collect())
    prints = small_side(materialize(item_prints(benchmark, window, k), "decon-prints"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_key"))
    printed = rows.select("doc_id", "text_key", F.explode(fingerprints(item_words(F.col("text")), short, window, k)).alias("f"))
    found = materialize(
        printed.select("doc_id", "text_key", "f.n", "f.h").join(prints, ["n", "h"], "left_semi").select("doc_id", "text_key").distinct(),
        "decon-candidates",
    ).withColumnsRenamed({"doc_id": "s_id", "text_key": "s_key"})
    # The same row twice would count the same windows twice; one is enough.
    same = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_key") == F.col("s_key"))
    again = rows.join(small_side(found), same).dropDuplicates(["doc_id", "text_key"])
    words = materialize(again.select("doc_id", "text_key", item_words(F.col("text")).alias("w")), "decon-words")
    starts = _placed(words, prints, short, window, k).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("n", "s")).alias("starts"))
    starts = starts.withColumnsRenamed({"doc_id": "s_id", "text_key": "s_key"})
    placed = words.join(starts, same).select(
        "doc_id",
        "text_key",
        F.explode(
            let(
                F.struct("w", "starts"),
                lambda x: F.transform(
                    x["starts"],
                    lambda s: F.struct(
                        s["n"].alias("n"),
                        s["s"].alias("s"),
                        F.array_join(F.slice(x["w"], s["s"] + 1, s["n"]), " ").alias("win"),
                    ),
                ),
            )
        ).alias("p"),
    ).select("doc_id", "text_key", "p.n", "p.s", "p.win")
    matched = placed.join(small_side(items), ["n", "win"])
    spans = F.sort_array(F.collect_set(F.struct(F.col("s"), (F.col("s") + F.col("n")).alias("e"))))
    grouped = matched.groupBy("doc_id", "text_key").agg(spans.alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("e"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["e"], x["e"]).alias("e"),
            (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["e"], x["s"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return grouped.select("doc_id", "text_key", "spans", covered.cast("long").alias("n_hit"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """``docs`` with n_words, n_hit, spans, items and contaminated, a row per input row.

    Words are what ``item_words`` gives of the whole text. A word is hit if it is
    inside any occurrence of a window: ``window`` successive words of an item, or
    all words of a shorter one. A document is contaminated if at least one word in
    MIN_SHARE is hit. Null and empty texts have no words and are not contaminated;
    null and empty items match nothing; repeated rows each get the same result,
    null ids their own. Empty tables give empty results or no hits. Further columns
    stay, but for those named as the ones added (or text_key, h_id, h_key), which go.
    """
    found = materialize(hits(docs, benchmark, window, k), "decon-hits")
    return with_hits(docs, small_side(found.withColumnsRenamed({"doc_id": "h_id", "text_key": "h_key"})))


def with_hits(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``docs`` with n_words, n_hit, spans, items and contaminated; ``found`` is
    what ``hits`` gives, its keys named h_id and h_key."""
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BREAKS_ANY_CASE), "")).cast("long")
    added = ("n_words", "n_hit", "spans", "items", "contaminated", "text_key", "h_id", "h_key")
    names = [c for c in docs.columns if c not in added]
    rows = docs.select(*names, F.xxhash64("text").alias("text_key"), n_words.alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_key") == F.col("h_key"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(found, same, "left").select(
        *names,
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (MIN_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def cut(text: Column, spans: Column) -> Column:
    """``text`` without the words inside ``spans``; what separates words stays."""

    def on(x: Column) -> Column:
        # A text that starts with a separator has an empty first piece.
        head = F.when(x["p"][0] == "", F.lit(1)).otherwise(F.lit(0))
        return F.array_join(
            F.transform(
                x["p"],
                lambda piece, i: F.concat(
                    F.when(F.exists(x["s"], lambda s: (i - head >= s["s"]) & (i - head < s["e"])), F.lit("")).otherwise(piece),
                    F.coalesce(F.get(x["g"], i), F.lit("")),
                ),
            ),
            "",
        )

    parts = F.struct(
        F.split(text, BREAKS_ANY_CASE).alias("p"),
        F.regexp_extract_all(text, F.lit(BREAKS_ANY_CASE), F.lit(0)).alias("g"),
        spans.alias("s"),
    )
    return F.when(F.size(spans) == 0, text).otherwise(let(parts, on))


def digests(found: DataFrame) -> list[Column]:
    return [
        F.col("n_words"),
        F.col("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha256_hex(F.array_join("items", ",")).alias("items_sha256"),
        F.col("contaminated"),
    ]
