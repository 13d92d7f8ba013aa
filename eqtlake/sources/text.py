"""Readers of the whitespace-separated SNP (``.esi``) and probe (``.epi``) lists.

Rows are numbered by accepted line, as the binary matrix refers to them so. The
file is read in splits: accepted lines are counted per split, and a line's number
is what earlier splits hold plus its place in its own, so no task sees it all. Of a
folder or pattern the files follow each other by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Unicode white space, of which Java's ``\s`` has only the ASCII part.
BLANK = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
FLOAT = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))$"
INTEGER = r"^[+-]?[0-9]+$"
MIN_FIELDS = 4


def fields(line: Column) -> Column:
    return F.split(F.regexp_replace(line, f"^{BLANK}+|{BLANK}+$", ""), f"{BLANK}+")


def whole_number(text: Column) -> Column:
    return F.when(text.rlike(INTEGER), text.try_cast("bigint"))


def number(text: Column) -> Column:
    """A float; ``NA`` and everything unreadable is null."""
    return F.when(text.rlike(FLOAT), text.try_cast("double"))


def readable(text: Column) -> Column:
    """Whether an optional float is absent, ``NA`` or a float."""
    return text.isNull() | (text == "NA") | text.rlike(FLOAT)


def parse_lines(lines: DataFrame, kind: str) -> DataFrame:
    """Accepted rows of (block, at, line) without their numbers.

    A line is skipped if it is blank, a comment, shorter than four fields, or has
    an unreadable number; the numbers then close up.
    """
    f = F.col("f")
    split = lines.select("block", "at", fields(F.col("line")).alias("f")).where(
        (F.size("f") >= MIN_FIELDS) & ~f[0].startswith("#")
    )
    get = lambda i: F.get(f, i)
    if kind == "snp":
        accepted = split.where(
            whole_number(get(3)).isNotNull() & readable(get(2)) & readable(get(6))
        )
        rest = [
            get(1).alias("snp_id"),
            number(get(2)).alias("genetic_dist"),
            whole_number(get(3)).alias("bp"),
            get(4).alias("a1"),
            get(5).alias("a2"),
            number(get(6)).alias("freq"),
        ]
    else:
        accepted = split.where(whole_number(get(3)).isNotNull() & readable(get(2)))
        rest = [
            get(1).alias("probe_id"),
            number(get(2)).alias("genetic_dist"),
            whole_number(get(3)).alias("probe_bp"),
            get(4).alias("gene"),
            get(5).alias("orientation"),
        ]
    return accepted.select("block", "at", get(0).alias("chr"), *rest)


def number_rows(rows: DataFrame) -> DataFrame:
    """Replace (block, at) by ``row_idx``, dense from 0 in file order."""
    counts = rows.groupBy("block").agg(F.count("*").alias("n"))
    # One row a split, so this window stays small.
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("block").orderBy("at")) - 1
    names = [c for c in rows.columns if c not in ("block", "at")]
    return rows.join(offsets, "block").select((F.col("offset") + own).alias("row_idx"), *names)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )


def read_snps(spark: SparkSession, path: str) -> DataFrame:
    return number_rows(parse_lines(_lines(spark, path), "snp"))


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    return number_rows(parse_lines(_lines(spark, path), "probe"))
