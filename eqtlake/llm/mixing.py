"""Mixing sources to target weights.

Every row gets a hash-random key; rows are range-sorted by (source, key); a
distributed prefix sum of sizes over that order is cut at each source's exact
budget. A budget above the source's own size repeats whole epochs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_side, split_words

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.size(split_words(text)).cast("long")


def hash_key(row_id: Column, seed: int) -> Column:
    """Hash-random sort key: 64 bits of an MD5 in hex."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string"))), 1, 16)


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """Targets of a materialized table (source, source_size), one row a source.

    Sources are numbered by code point, null last, and take ``weights`` in turn.
    They share the sum of all sizes by weight. A target stops at ``max_epochs``
    times its source's size; what is above goes to the others by weight, again
    until none is above. Each round is one aggregate; the driver sees only sums.
    """
    ranked = materialize(_numbered(sizes), "mix-sources")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    frame = ranked.select("source", "source_size", pick.alias("weight"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    whole = float(frame.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        # A source once stopped stays so, as the level only rises.
        at_cap = (cap <= F.col("weight") * F.lit(level)) if stopped >= 0 else F.lit(False)
        row = frame.agg(
            F.count(F.when(at_cap, 1)).alias("n"),
            F.sum(F.when(at_cap, cap)).alias("capped"),
            F.sum(F.when(~at_cap, F.col("weight"))).alias("free"),
        ).first()
        if row["n"] == stopped or not row["free"]:
            break
        stopped = row["n"]
        level = (whole - (row["capped"] or 0.0)) / row["free"]
    return frame.select(
        "source", "source_size", F.least(cap, F.col("weight") * F.lit(level)).alias("target")
    )


def _numbered(sizes: DataFrame) -> DataFrame:
    """Add ``rank`` from 0 by (source, null last) without one task for all rows."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = materialize(
        sizes.repartitionByRange(*order).select("*", F.spark_partition_id().alias("pid")), "mix-order"
    )
    counts = ranged.groupBy("pid").agg(F.count("*").alias("n"))
    # One row a partition, so this window is bounded by the partition count.
    before = counts.select(
        "pid",
        F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    return ranged.join(F.broadcast(before), "pid").select(
        "source",
        "source_size",
        (F.col("before") + F.row_number().over(Window.partitionBy("pid").orderBy(*order)) - 1).alias("rank"),
    )


def mix_sources(
    docs: DataFrame,
    size: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 17,
) -> DataFrame:
    """Return (doc_id, source, size, source_size, target, taken), a row per input row.

    ``docs`` has doc_id, source and text; further columns are ignored. ``size``
    defaults to the word count of text (null: 0). ``taken`` counts repeats: whole
    epochs for every row, and one more pass up to the budget in key order, where
    the row at the cut gives only the words that are left. Within a source the
    taken words sum to the rounded target. Equal keys and repeated rows are
    ordered by doc_id and size and count each on its own; a null source is a
    source; rows of size 0 take 0; an empty table gives an empty result. The
    same rows give the same result on any partitioning.
    """
    size = word_count(F.col("text")) if size is None else size
    sized = materialize(
        docs.select(
            "doc_id",
            "source",
            size.alias("size"),
            hash_key(F.col("doc_id"), seed).alias("key"),
        ),
        "mix-sized",  # texts are read once; sampling for the ranges reads this
    )
    rows = materialize(
        sized.repartitionByRange(F.col("source").isNull(), "source", "key", "doc_id", "size")
        .sortWithinPartitions(F.col("source").isNull(), "source", "key", "doc_id", "size")
        .select("*", F.spark_partition_id().alias("pid")),
        "mix-rows",
    )
    parts = materialize(rows.groupBy("source", "pid").agg(F.sum("size").alias("part_size")), "mix-parts")
    sizes = materialize(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), "mix-sizes")
    targets = source_targets(sizes, weights, max_epochs)
    earlier = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "source", "pid", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("offset")
    ).alias("o")
    t = targets.alias("t")
    plan = materialize(
        offsets.join(t, F.col("o.source").eqNullSafe(F.col("t.source"))).select(
            F.col("o.source").alias("p_source"), F.col("o.pid").alias("p_pid"), "offset", "source_size", "target"
        ),
        "mix-plan",
    )
    # A group is one source in one range partition, so no group outgrows a task.
    upto = Window.partitionBy("pid", "source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("inner", F.coalesce(F.sum("size").over(upto), F.lit(0)))
    joined = summed.join(
        small_side(plan), (F.col("pid") == F.col("p_pid")) & F.col("source").eqNullSafe(F.col("p_source"))
    )
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("inner")))
    return joined.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + last).cast("long").alias("taken"),
    )
