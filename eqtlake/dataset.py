"""A dataset: two dimensions and a fact, wherever they come from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import META
from .sources import besd, sqlite_index, store, text

#: Dimension rows that are looked up ahead so that their numbers reach the scan
#: of a stored fact as literals, at most; more are joined.
LOOKUP_ROWS = 1000


@dataclass(frozen=True)
class Dataset:
    """``assoc`` of a store also has probe_chr, by which it is partitioned."""

    snps: DataFrame
    probes: DataFrame
    assoc: DataFrame
    meta: DataFrame | None = None
    assoc_by_snp: DataFrame | None = None
    #: Gives the fact of some probe rows, where ``assoc`` reads a file that is
    #: laid out by probe.
    slices: Callable[..., DataFrame] | None = None

    @classmethod
    def from_frames(cls, snps: DataFrame, probes: DataFrame, assoc: DataFrame) -> Dataset:
        return cls(snps, probes, assoc)

    @classmethod
    def from_files(cls, spark: SparkSession, prefix: str) -> Dataset:
        """``prefix``.esi, .epi and .besd."""
        snps = text.read_snps(spark, f"{prefix}.esi")
        probes = text.read_probes(spark, f"{prefix}.epi")
        n_probes = probes.count()
        assoc = besd.read_assoc(spark, f"{prefix}.besd", n_probes)
        values = {
            "format_type": besd.read_layout(f"{prefix}.besd", n_probes).kind,
            "n_snps": str(snps.count()),
            "n_probes": str(n_probes),
            **{f"{e}_path": f"{prefix}.{e}" for e in ("besd", "esi", "epi")},
        }
        meta = spark.createDataFrame(sorted(values.items()), META)
        return cls(snps, probes, assoc, meta, slices=partial(besd.read_assoc, spark, f"{prefix}.besd", n_probes))

    @classmethod
    def from_store(cls, spark: SparkSession, folder: str) -> Dataset:
        return cls(**store.read_store(spark, folder))

    @classmethod
    def from_sqlite(cls, spark: SparkSession, path: str) -> Dataset:
        """An index in one SQLite file that every task can open."""
        if not sqlite_index.is_sqlite(path):
            sqlite_index.connect(path).close()  # a missing file has its own error
            raise ValueError(f"{path} is not a SQLite file")
        snps, probes, meta = (sqlite_index.read_table(spark, path, t) for t in ("esi", "epi", "besd_meta"))
        slices = partial(sqlite_index.read_assoc, spark, path)
        return cls(snps, probes, slices(), meta, slices=slices)

    @classmethod
    def from_index(cls, spark: SparkSession, path: str) -> Dataset:
        """A SQLite file or the folder of a store."""
        return cls.from_sqlite(spark, path) if sqlite_index.is_sqlite(path) else cls.from_store(spark, path)

    def __enter__(self) -> Dataset:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Nothing to do: the session is the caller's."""

    def save(self, folder: str, force: bool = False, by_snp: bool = False) -> Dataset:
        """Write a store and give the dataset that reads it."""
        extra = {} if self.meta is None else self.metadata()
        extra = {k: v for k, v in extra.items() if k not in ("n_snps", "n_probes")}
        assoc = self.assoc.drop("probe_chr")
        store.write_store(self.snps, self.probes, assoc, folder, force, by_snp, extra)
        return Dataset.from_store(self.snps.sparkSession, folder)

    def metadata(self) -> dict[str, str]:
        return {r.key: r.value for r in self.meta.collect()} if self.meta is not None else {}

    @property
    def stored(self) -> bool:
        return "probe_chr" in self.assoc.columns

    def assoc_of_probes(self, probes: DataFrame) -> DataFrame:
        """The fact for a join with filtered ``probes``: of a store the partitions
        that they are in, of a binary matrix their slices."""
        if not self.stored and self.slices is None:
            return self.assoc
        found = probes.select("row_idx", "chr").distinct().limit(LOOKUP_ROWS + 1).collect()
        if len(found) > LOOKUP_ROWS:
            return self.assoc.drop("probe_chr")
        rows = sorted(r.row_idx for r in found)
        if self.slices is not None:
            return self.slices(probes=rows)
        chosen = F.col("probe_chr").isin(sorted({r.chr for r in found})) & F.col("probe_idx").isin(rows)
        return self.assoc.where(chosen).drop("probe_chr")

    def assoc_of_probe(self, probe_idx: int) -> DataFrame:
        """The fact of one probe row."""
        if self.slices is not None:
            return self.slices(probes=[probe_idx])
        return self.assoc.where(F.col("probe_idx") == F.lit(probe_idx))

    def assoc_of_snps(self, snps: DataFrame) -> DataFrame:
        """The fact for a join with filtered ``snps``, from the SNP projection if
        there is one."""
        if self.assoc_by_snp is None:
            return self.assoc.drop("probe_chr")
        found = snps.select("row_idx").distinct().limit(LOOKUP_ROWS + 1).collect()
        by_snp = self.assoc_by_snp.drop("probe_chr")
        if len(found) > LOOKUP_ROWS:
            return by_snp
        return by_snp.where(F.col("snp_idx").isin(sorted(r.row_idx for r in found)))
