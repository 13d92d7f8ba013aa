"""What the corpus operators share: shared-folder tables, size-checked joins,
column helpers that stay in the JVM."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eqtlake.plans.workspace import scratch_path

#: Words of the whitespace tokeniser; the class is ASCII only.
SPACES = r"[\x20\x09-\x0D]+"
#: Spark's switch for deleting the shuffles of a command when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes up to which a small side may be broadcast, after both were measured.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it.

    The files outlive lost executors, and each later use reads columns instead
    of recomputing the plan. Shuffles of the write are deleted as it ends.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later step reads."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for parent in {os.path.dirname(f) for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(parent)
        where.getFileSystem(conf).delete(where, True)


def _width(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(kind, T.ArrayType):
        inner = F.aggregate(column, F.lit(0).cast("long"), lambda acc, x: acc + _width(x, kind.elementType))
        return F.coalesce(inner, F.lit(0).cast("long"))
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind), F.lit(0).cast("long"))
    return F.lit(8).cast("long")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and about ``size``
    bytes, else as is.

    ``df`` must be materialized, as it is measured. Beyond the bounds Spark joins by
    sort and merge, where adaptive execution splits skew.
    """
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0).cast("long"))
    n, whole = df.agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(df) if n <= rows and (whole or 0) <= size else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and bind it for ``body``.

    Without it the optimizer may inline an array expression into a lambda and
    evaluate it again for every element.
    """
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """Whitespace words of ``text``; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def total(values: Column) -> Column:
    """Sum of an array of integers."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x.cast("long"))


def running_sum(values: Column, block: int = 64) -> Column:
    """Exclusive prefix sums of an array of integers, by blocks, so that the
    work stays near linear for long arrays."""

    def within(a: Column) -> Column:
        blocks = F.when(F.size(a) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size(a) - 1) / F.lit(block)).cast("int")),
                lambda b: total(F.slice(a, b * block + 1, F.lit(block))),
            )
        )
        offsets = let(blocks, lambda s: F.transform(s, lambda x, b: total(F.slice(s, F.lit(1), b))))
        return let(
            offsets,
            lambda o: F.transform(
                a,
                lambda x, i: F.get(o, F.floor(i / F.lit(block)).cast("int"))
                + total(F.slice(a, i - i % block + 1, i % block)),
            ),
        )

    return let(values, within)


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
