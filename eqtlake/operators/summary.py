"""Counts and per-probe collections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset
from .queries import id_table


def threshold_counts(found: DataFrame, pval_below: float) -> DataFrame:
    """One row: rows before and after the p-value threshold."""
    return found.agg(
        F.count("*").alias("n_all"), F.count_if(F.col("pval") < pval_below).alias("n_below")
    )


def id_counts(
    found: DataFrame, ids: Sequence[str], column: str, times: Mapping[str, int] | None = None
) -> DataFrame:
    """(pos, id, n) for each requested id, 0 for one without rows.

    ``found`` holds the rows of each distinct id once, or as often as ``times`` says.
    """
    spark = found.sparkSession
    wanted = id_table(spark, ids, "id")
    counts = found.groupBy(F.col(column).alias("id")).agg(F.count("*").alias("n"))
    if times:
        held = spark.createDataFrame(sorted(times.items()), "id string, times long")
        counts = counts.join(F.broadcast(held), "id").select("id", F.expr("n div times").alias("n"))  # the caller's ids
    return wanted.join(counts, "id", "left").select("pos", "id", F.coalesce("n", F.lit(0)).alias("n"))


def probe_snp_counts(ds: Dataset) -> DataFrame:
    """(probe_idx, probe_id, snp_count), with probes that have no facts."""
    counts = ds.assoc.groupBy("probe_idx").agg(F.count("*").alias("n"))
    probes = ds.probes.select(F.col("row_idx").alias("probe_idx"), "probe_id")
    return probes.join(counts, "probe_idx", "left").select(
        "probe_idx", "probe_id", F.coalesce("n", F.lit(0)).alias("snp_count")
    )


def probe_arrays(ds: Dataset) -> DataFrame:
    """(probe_idx, snp_count, snp_indices, betas, ses): a probe's facts as three
    arrays in storage order; empty arrays for a probe without facts.

    A row holds a whole probe, so this is for export; queries use the long form.
    """
    item = F.struct("ord", "snp_idx", "beta", "se")
    grouped = ds.assoc.groupBy("probe_idx").agg(F.sort_array(F.collect_list(item)).alias("items"))
    probes = ds.probes.select(F.col("row_idx").alias("probe_idx"))
    joined = probes.join(grouped, "probe_idx", "left").withColumn("n", F.greatest(F.size("items"), F.lit(0)))

    def part(name: str, kind: str):
        return F.coalesce(F.col(f"items.{name}"), F.array().cast(f"array<{kind}>"))

    return joined.select(
        "probe_idx",
        F.col("n").alias("snp_count"),
        part("snp_idx", "bigint").alias("snp_indices"),
        part("beta", "float").alias("betas"),
        part("se", "float").alias("ses"),
    )


def from_arrays(arrays: DataFrame) -> DataFrame:
    """The long form (probe_idx, ord, snp_idx, beta, se) of ``probe_arrays``."""
    zipped = F.arrays_zip("snp_indices", "betas", "ses")
    return arrays.select("probe_idx", F.posexplode(zipped).alias("ord", "x")).select(
        "probe_idx",
        "ord",
        F.col("x.snp_indices").alias("snp_idx"),
        F.col("x.betas").alias("beta"),
        F.col("x.ses").alias("se"),
    )


def dataset_counts(ds: Dataset) -> DataFrame:
    """(key, value): numbers of SNPs and probes as text."""
    count = lambda df, key: df.agg(F.count("*").cast("string").alias("value")).select(F.lit(key).alias("key"), "value")
    return count(ds.snps, "n_snps").union(count(ds.probes, "n_probes"))
