"""Schemas of the star: two dimensions, one fact, one result."""

from __future__ import annotations

from pyspark.sql import types as T

SNPS = T.StructType(
    [
        T.StructField("row_idx", T.LongType()),
        T.StructField("chr", T.StringType()),
        T.StructField("snp_id", T.StringType()),
        T.StructField("genetic_dist", T.DoubleType()),
        T.StructField("bp", T.LongType()),
        T.StructField("a1", T.StringType()),
        T.StructField("a2", T.StringType()),
        T.StructField("freq", T.DoubleType()),
    ]
)

PROBES = T.StructType(
    [
        T.StructField("row_idx", T.LongType()),
        T.StructField("chr", T.StringType()),
        T.StructField("probe_id", T.StringType()),
        T.StructField("genetic_dist", T.DoubleType()),
        T.StructField("probe_bp", T.LongType()),
        T.StructField("gene", T.StringType()),
        T.StructField("orientation", T.StringType()),
    ]
)

#: ``ord`` is the place within the probe, as Spark rows have no order.
ASSOC = T.StructType(
    [
        T.StructField("probe_idx", T.LongType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("snp_idx", T.LongType()),
        T.StructField("beta", T.FloatType()),
        T.StructField("se", T.FloatType()),
    ]
)

META = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])

RESULT = (
    "snp_id",
    "snp_chr",
    "snp_bp",
    "a1",
    "a2",
    "probe_id",
    "probe_chr",
    "probe_bp",
    "gene",
    "beta",
    "se",
    "pval",
)
