"""Queries of a dataset as lazy DataFrames.

All but the range scans return the twelve result columns. Results have no order
unless ``ordered`` is given, which sorts by what the row order of the files means:
the request's place, then the probe, then the place within the probe.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..functions.regions import Region, local_table, region_table
from ..functions.stats import p_value
from ..schemas import RESULT


def snp_range(ds: Dataset, region: Region, ordered: bool = False) -> DataFrame:
    """All columns of the SNPs in ``region``; by (bp, row) if ordered."""
    found = ds.snps.where(region.holds(F.col("chr"), F.col("bp")))
    return found.orderBy("bp", "row_idx") if ordered else found


def probe_range(ds: Dataset, region: Region, ordered: bool = False) -> DataFrame:
    """All columns of the probes in ``region``; by (probe_bp, row) if ordered."""
    found = ds.probes.where(region.holds(F.col("chr"), F.col("probe_bp")))
    return found.orderBy("probe_bp", "row_idx") if ordered else found


def _snp_side(snps: DataFrame, *more: str) -> DataFrame:
    return snps.select(
        F.col("row_idx").alias("snp_idx"),
        "snp_id",
        F.col("chr").alias("snp_chr"),
        F.col("bp").alias("snp_bp"),
        "a1",
        "a2",
        *more,
    )


def _probe_side(probes: DataFrame, *more: str) -> DataFrame:
    return probes.select(
        F.col("row_idx").alias("probe_idx"),
        "probe_id",
        F.col("chr").alias("probe_chr"),
        "probe_bp",
        "gene",
        *more,
    )


def associations(
    assoc: DataFrame,
    snps: DataFrame,
    probes: DataFrame,
    pval_below: float | None = None,
    snps_first: bool = False,
) -> DataFrame:
    """The star join with p-values; ``snps`` and ``probes`` are its filtered sides.

    The side that leaves fewer facts is joined first, which matters where the
    other is too large to broadcast. Facts whose SNP is not in the SNP table are
    dropped. The threshold is strict.
    """
    doubles = [F.col(c).cast("double").alias(c) for c in ("beta", "se")]
    sides = [(probes, "probe_idx"), (snps, "snp_idx")]
    joined = assoc
    for side, key in reversed(sides) if snps_first else sides:
        joined = joined.join(side, key)
    names = [c for c in joined.columns if c not in ("beta", "se")]
    found = joined.select(*names, *doubles, p_value(F.col("beta"), F.col("se")).alias("pval"))
    return found if pval_below is None else found.where(F.col("pval") < pval_below)


def _result(found: DataFrame, order: Sequence[str | Column] | None) -> DataFrame:
    return (found.orderBy(*order) if order else found).select(*RESULT)


def first_rows(dim: DataFrame, key: str) -> DataFrame:
    """The first row of each id, by file order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("row_idx"))
    return dim.withColumn("_place", place).where("_place = 1").drop("_place")


def id_table(spark: SparkSession, ids: Sequence[str], name: str) -> DataFrame:
    """(pos, name): the requested ids with their places; repeats stay."""
    return local_table(spark, list(enumerate(ids)), pa.schema([("pos", pa.int32()), (name, pa.string())]))


def cis_window(
    ds: Dataset, snp_region: Region, probe_region: Region, pval_below: float | None = None, ordered: bool = False
) -> DataFrame:
    """Associations of the SNPs and the probes in two regions."""
    probes = probe_range(ds, probe_region)
    found = associations(
        ds.assoc_of_probes(probes), _snp_side(snp_range(ds, snp_region)), _probe_side(probes), pval_below
    )
    return _result(found, ("probe_bp", "probe_idx", "ord") if ordered else None)


def cis_windows(
    ds: Dataset,
    snp_regions: Sequence[Region],
    probe_regions: Sequence[Region],
    pval_below: float | None = None,
    ordered: bool = False,
) -> DataFrame:
    """One window for each pair of a SNP region and a probe region, all appended:
    a row that several pairs hold comes once for each."""
    spark = ds.snps.sparkSession
    # The lists are the caller's arguments, so they are small enough to broadcast.
    s = F.broadcast(region_table(spark, snp_regions, "s"))
    p = F.broadcast(region_table(spark, probe_regions, "p"))
    snps = ds.snps.join(s, (F.col("chr") == F.col("s_chr")) & F.col("bp").between(F.col("s_start"), F.col("s_end")))
    probes = ds.probes.join(
        p, (F.col("chr") == F.col("p_chr")) & F.col("probe_bp").between(F.col("p_start"), F.col("p_end"))
    )
    found = associations(
        ds.assoc_of_probes(probes), _snp_side(snps, "s_no"), _probe_side(probes, "p_no"), pval_below
    )
    return _result(found, ("s_no", "p_no", "probe_bp", "probe_idx", "ord") if ordered else None)


def by_snp(
    ds: Dataset,
    ids: str | Sequence[str],
    first_only: bool = False,
    pval_below: float | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Associations of SNP ids, for each as often as it is asked for.

    Of SNPs that share an id the first is meant. ``first_only`` keeps the first of
    several facts of the SNP in one probe.
    """
    ids = [ids] if isinstance(ids, str) else list(ids)
    wanted = F.broadcast(id_table(ds.snps.sparkSession, ids, "snp_id"))
    named = first_rows(ds.snps.where(F.col("snp_id").isin(ids)), "snp_id")
    snps = _snp_side(named.join(wanted, "snp_id"), "pos")
    assoc = ds.assoc_of_snps(named)
    if first_only:
        assoc = assoc.join(named.select(F.col("row_idx").alias("snp_idx")), "snp_idx", "left_semi")
        place = F.row_number().over(Window.partitionBy("snp_idx", "probe_idx").orderBy("ord"))
        assoc = assoc.withColumn("_place", place).where("_place = 1").drop("_place")
    found = associations(assoc, snps, _probe_side(ds.probes), pval_below, snps_first=True)
    return _result(found, ("pos", "probe_idx", "ord") if ordered else None)


def by_probe(
    ds: Dataset, ids: str | Sequence[str], pval_below: float | None = None, ordered: bool = False
) -> DataFrame:
    """Associations of probe ids; of probes that share an id the first is meant."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    wanted = F.broadcast(id_table(ds.snps.sparkSession, ids, "probe_id"))
    named = first_rows(ds.probes.where(F.col("probe_id").isin(ids)), "probe_id").join(wanted, "probe_id")
    found = associations(ds.assoc_of_probes(named), _snp_side(ds.snps), _probe_side(named, "pos"), pval_below)
    return _result(found, ("pos", "probe_idx", "ord") if ordered else None)


def by_gene(
    ds: Dataset, genes: str | Sequence[str], pval_below: float | None = None, ordered: bool = False
) -> DataFrame:
    """Associations of all probes of the genes."""
    genes = [genes] if isinstance(genes, str) else list(genes)
    wanted = F.broadcast(id_table(ds.snps.sparkSession, genes, "gene"))
    named = ds.probes.where(F.col("gene").isin(genes)).join(wanted, "gene")
    found = associations(ds.assoc_of_probes(named), _snp_side(ds.snps), _probe_side(named, "pos"), pval_below)
    return _result(found, ("pos", "probe_idx", "ord") if ordered else None)


def probe_associations(ds: Dataset, probe_idx: int) -> DataFrame:
    """(snp_idx, beta, se) of one probe in storage order; none for a number that
    no probe has."""
    own = ds.assoc_of_probe(probe_idx)
    return own.orderBy("ord").select("snp_idx", F.col("beta").cast("double"), F.col("se").cast("double"))


def dangling(ds: Dataset) -> DataFrame:
    """(snp_idx, n) of facts whose SNP is not in the SNP table."""
    known = ds.snps.select(F.col("row_idx").alias("snp_idx"))
    return ds.assoc.join(known, "snp_idx", "left_anti").groupBy("snp_idx").agg(F.count("*").alias("n"))


def check_snps(ds: Dataset) -> None:
    """Raise ``KeyError`` if a fact's SNP is not in the SNP table."""
    row = dangling(ds).limit(1).collect()
    if row:
        raise KeyError(f"SNP row {row[0].snp_idx} is not in the SNP table")
