"""Text forms of the result columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, Row
from pyspark.sql import functions as F

# The report's header.
HEADER = (
    "SNP",
    "SNP_Chr",
    "SNP_bp",
    "A1",
    "A2",
    "Probe",
    "Probe_Chr",
    "Probe_bp",
    "Gene",
    "Beta",
    "SE",
    "P_value",
)
ABSENT = "NA"


def or_na(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(ABSENT))


def fixed(x: Column, places: int = 6) -> Column:
    """``%.6f`` with ties to even, as C formats the values that are exact."""
    value = x.cast("double")
    rounded = F.bround(value.cast(f"decimal(38,{places + 12})"), places)
    sign = F.when((value < 0) & (rounded == 0), F.lit("-")).otherwise(F.lit(""))
    usable = ~F.isnan(value) & (F.abs(value) < F.lit(1e18))
    exact = F.concat(sign, rounded.cast("string"))
    return F.when(usable, exact).otherwise(F.format_string(f"%.{places}f", value))


def scientific(x: Column, places: int = 6) -> Column:
    return F.format_string(f"%.{places}e", x)


def report_columns() -> list[Column]:
    """The result's columns as text under the report's header."""
    sources = (
        F.col("snp_id"),
        F.col("snp_chr"),
        F.col("snp_bp").cast("string"),
        or_na(F.col("a1")),
        or_na(F.col("a2")),
        F.col("probe_id"),
        F.col("probe_chr"),
        F.col("probe_bp").cast("string"),
        or_na(F.col("gene")),
        fixed(F.col("beta")),
        fixed(F.col("se")),
        scientific(F.col("pval")),
    )
    return [c.alias(name) for c, name in zip(sources, HEADER, strict=True)]


def report_line(row: Row) -> str:
    """One result row as the single-file report has it."""
    texts: Iterable[str] = (
        row.snp_id,
        row.snp_chr,
        str(row.snp_bp),
        row.a1 or ABSENT,
        row.a2 or ABSENT,
        row.probe_id,
        row.probe_chr,
        str(row.probe_bp),
        row.gene or ABSENT,
        f"{row.beta:.6f}",
        f"{row.se:.6f}",
        f"{row.pval:.6e}",
    )
    return "\t".join(texts)
