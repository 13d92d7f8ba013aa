"""The Parquet store of a dataset.

``assoc`` is partitioned by the probe's chromosome and sorted by (probe, place),
so a probe's rows are in few row groups; ``assoc_by_snp`` is an optional second
projection sorted by SNP for the opposite lookup. ``snps`` and ``probes`` are
sorted by position and have bloom filters on their ids. Schemas are given on
reading, so a chromosome named X stays text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ASSOC, META, PROBES, SNPS

STORED_ASSOC = T.StructType([*ASSOC.fields, T.StructField("probe_chr", T.StringType())])


def _path(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(folder)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, folder: str) -> bool:
    where, system = _path(spark, folder)
    return system.exists(where)


def write_store(
    snps: DataFrame,
    probes: DataFrame,
    assoc: DataFrame,
    folder: str,
    force: bool = False,
    by_snp: bool = False,
    extra: dict[str, str] | None = None,
) -> None:
    """Write a store; ``FileExistsError`` if there is one, unless ``force``.

    Counts in ``meta`` are text, like all its values. Probes without associations
    are in ``probes`` and simply have no rows in ``assoc``.
    """
    spark = snps.sparkSession
    if exists(spark, folder):
        if not force:
            raise FileExistsError(f"Store already exists: {folder}")
        where, system = _path(spark, folder)
        system.delete(where, True)

    def bloom(df: DataFrame, *columns: str):
        writer = df.write
        for c in columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        return writer

    bloom(snps.repartitionByRange("chr", "bp").sortWithinPartitions("chr", "bp"), "snp_id").parquet(f"{folder}/snps")
    bloom(probes.repartitionByRange("chr", "probe_bp").sortWithinPartitions("chr", "probe_bp"), "probe_id", "gene").parquet(
        f"{folder}/probes"
    )
    chroms = probes.select(F.col("row_idx").alias("probe_idx"), F.col("chr").alias("probe_chr"))
    placed = assoc.join(chroms, "probe_idx").select(*[f.name for f in STORED_ASSOC.fields])
    (
        placed.repartitionByRange("probe_chr", "probe_idx")
        .sortWithinPartitions("probe_chr", "probe_idx", "ord")
        .write.partitionBy("probe_chr")
        .parquet(f"{folder}/assoc")
    )
    if by_snp:
        bloom(placed.repartitionByRange("snp_idx").sortWithinPartitions("snp_idx", "probe_idx", "ord"), "snp_idx").parquet(
            f"{folder}/assoc_by_snp"
        )
    values = {"format_type": "parquet", "n_snps": str(snps.count()), "n_probes": str(probes.count()), **(extra or {})}
    spark.createDataFrame(sorted(values.items()), META).coalesce(1).write.parquet(f"{folder}/meta")


def read_store(spark: SparkSession, folder: str) -> dict[str, DataFrame | None]:
    """The tables of a store; ``FileNotFoundError`` if there is none."""
    if not exists(spark, f"{folder}/meta"):
        raise FileNotFoundError(f"Store not found: {folder}")

    def table(name: str, schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    assoc = table("assoc", STORED_ASSOC) if exists(spark, f"{folder}/assoc") else spark.createDataFrame([], STORED_ASSOC)
    by_snp = table("assoc_by_snp", STORED_ASSOC) if exists(spark, f"{folder}/assoc_by_snp") else None
    return {
        "snps": table("snps", SNPS),
        "probes": table("probes", PROBES),
        "assoc": assoc,
        "assoc_by_snp": by_snp,
        "meta": table("meta", META),
    }
