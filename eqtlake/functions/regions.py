"""Regions on a chromosome: parsing, kilobases, and their use as predicates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Region:
    """Positions ``start`` to ``end`` of a chromosome, both included."""

    chrom: str
    start: int
    end: int

    @classmethod
    def parse(cls, text: str) -> Region:
        """``chr:pos`` or ``chr:start-end`` in base pairs."""
        chrom, colon, place = text.partition(":")
        if not colon:
            raise ValueError(f"Invalid region: {text}. Expected chr:pos or chr:start-end")
        bounds = place.split("-")
        try:
            numbers = [int(x) for x in bounds]
        except ValueError:
            raise ValueError(f"Invalid position in {text}. Expected integers") from None
        if len(numbers) > 2:
            raise ValueError(f"Invalid range in {text}. Expected start-end")
        if numbers[0] > numbers[-1]:
            raise ValueError(f"Invalid range in {text}. Start must not be above end")
        return cls(chrom, numbers[0], numbers[-1])

    @classmethod
    def from_kb(cls, chrom: str | int, start_kb: float, end_kb: float) -> Region:
        """Kilobases, truncated to whole base pairs."""
        return cls(str(chrom), kb_to_bp(start_kb), kb_to_bp(end_kb))

    def through_kb(self) -> Region:
        """The region after a round trip through fractional kilobases, which
        loses a base pair at some positions; for callers that need that."""
        return Region.from_kb(self.chrom, self.start / 1000.0, self.end / 1000.0)

    def holds(self, chrom: Column, bp: Column) -> Column:
        return (chrom == F.lit(str(self.chrom))) & bp.between(self.start, self.end)


def kb_to_bp(kb: float) -> int:
    return int(kb * 1000)


def parse_regions(text: str) -> list[Region]:
    """A comma-separated list; order and repeats stay."""
    return [Region.parse(x.strip()) for x in text.split(",")]


def split_ids(text: str) -> list[str]:
    return [x.strip() for x in text.split(",")]


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: pa.Schema) -> DataFrame:
    """A table of the caller's arguments as a local relation, not a Python RDD."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


def region_table(spark: SparkSession, regions: Iterable[Region], prefix: str) -> DataFrame:
    """(prefix_no, prefix_chr, prefix_start, prefix_end), one row a region."""
    rows = [(i, str(r.chrom), r.start, r.end) for i, r in enumerate(regions)]
    kinds = {"no": pa.int32(), "chr": pa.string(), "start": pa.int64(), "end": pa.int64()}
    return local_table(spark, rows, pa.schema([(f"{prefix}_{k}", kind) for k, kind in kinds.items()]))


def parse_region_column(text: Column) -> Column:
    """struct<chrom, start, end> of a region's text, null where it is invalid."""
    pattern = r"^([^:]*):\s*(\+?[0-9]+)\s*(?:-\s*(\+?[0-9]+)\s*)?$"
    start = F.regexp_extract(text, pattern, 2).try_cast("bigint")
    last = F.regexp_extract(text, pattern, 3)
    end = F.when(last == "", start).otherwise(last.try_cast("bigint"))
    found = F.struct(F.regexp_extract(text, pattern, 1).alias("chrom"), start.alias("start"), end.alias("end"))
    return F.when(text.rlike(pattern) & (start <= end), found)
