"""Spark source for indexes kept in one SQLite file.

The driver reads the row numbers' bounds and the probes' counts; tasks open the
file read-only and read ranges of rows, or slices of a probe's arrays, by primary
key. The file has to lie where every task can open it: SQLite knows no remote
paths. Options are ``path``, ``table`` (esi, epi, besd_meta or probe_data),
``rowsPerPartition``, ``valuesPerPartition`` and ``probes`` (rows, comma-separated:
only their arrays are read).
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterable, Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructType

from ..schemas import ASSOC, META, PROBES, SNPS

# The file's head and the tables of an index.
HEAD = b"SQLite format 3\x00"
TABLES = {"esi": SNPS, "epi": PROBES, "besd_meta": META, "probe_data": ASSOC}
ROWS_PER_PARTITION = 1_000_000
VALUES_PER_PARTITION = 4_000_000
BATCH = 100_000


def local_path(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def is_sqlite(path: str) -> bool:
    """Whether ``path`` is a SQLite file."""
    name = local_path(path)
    if not os.path.isfile(name):
        return False
    with open(name, "rb") as f:
        return f.read(len(HEAD)) == HEAD


def connect(path: str) -> sqlite3.Connection:
    name = local_path(path)
    if not os.path.exists(name):
        raise FileNotFoundError(f"no index at {path}")
    return sqlite3.connect(f"file:{quote(os.path.abspath(name))}?mode=ro", uri=True)


@dataclass
class Rows(InputPartition):
    """Row numbers ``first`` to ``last``, both included."""

    first: int
    last: int

    def __init__(self, first, last):
        self.first, self.last = first, last


@dataclass
class Arrays(InputPartition):
    """Slices (probe, first ord, ord after the last)."""

    slices: Sequence[tuple[int, int, int]]

    def __init__(self, slices):
        self.slices = slices


def stretches(counts: Iterable[tuple[int, int]], values: int) -> Iterator[Arrays]:
    """Cut probes of (row, count), wide ones too, into even stretches."""
    held, size = [], 0
    for probe, n in counts:
        for first in range(0, n, values):
            last = min(first + values, n)
            if held and size + last - first > values:
                yield Arrays(held)
                held, size = [], 0
            held.append((probe, first, last))
            size += last - first
    if held:
        yield Arrays(held)


#: Elements that all three arrays of a probe have.
_COUNT = "CASE WHEN snp_count = 0 THEN 0 ELSE min(length(snp_indices), length(betas), length(ses)) / 4 END"


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.rows = int(options.get("rowsPerPartition", ROWS_PER_PARTITION))
        self.values = int(options.get("valuesPerPartition", VALUES_PER_PARTITION))
        probes = options.get("probes")
        self.probes = None if probes is None else sorted({int(x) for x in probes.split(",") if x})

    def partitions(self) -> Sequence[InputPartition]:
        with closing(connect(self.path)) as con:
            if self.table == "probe_data":
                return list(stretches(self._counts(con), self.values)) or [Arrays([])]
            key = "rowid" if self.table == "besd_meta" else "row_idx"
            low, high = con.execute(f"SELECT min({key}), max({key}) FROM {self.table}").fetchone()
        if low is None:
            return [Rows(0, -1)]
        return [Rows(i, min(i + self.rows - 1, high)) for i in range(low, high + 1, self.rows)]

    def _counts(self, con: sqlite3.Connection) -> Iterator[tuple[int, int]]:
        select = f"SELECT probe_idx, {_COUNT} FROM probe_data"
        if self.probes is None:
            yield from con.execute(f"{select} ORDER BY probe_idx")
            return
        for probe in self.probes:
            yield from con.execute(f"{select} WHERE probe_idx = ?", (probe,))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with closing(connect(self.path)) as con:
            yield from self._arrays(con, partition) if self.table == "probe_data" else self._records(con, partition)

    def _records(self, con: sqlite3.Connection, rows: Rows) -> Iterator[pa.RecordBatch]:
        # A column of a SQLite table may hold values of any type.
        kinds = {LongType(): "INTEGER", DoubleType(): "REAL"}
        columns = ", ".join(f"CAST({quoted(f.name)} AS {kinds.get(f.dataType, 'TEXT')})" for f in self.schema)
        key = "rowid" if self.table == "besd_meta" else "row_idx"
        found = con.execute(
            f"SELECT {columns} FROM {self.table} WHERE {key} BETWEEN ? AND ? ORDER BY {key}", (rows.first, rows.last)
        )
        schema = to_arrow_schema(self.schema)
        while some := found.fetchmany(BATCH):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema
            )

    def _arrays(self, con: sqlite3.Connection, part: Arrays) -> Iterator[pa.RecordBatch]:
        names = ("snp_indices", "betas", "ses")
        kinds = ("<i4", "<f4", "<f4")
        cut = ", ".join(f"substr({c}, :at, :n)" for c in names)
        for probe, first, last in part.slices:
            for i in range(first, last, BATCH):
                n = min(BATCH, last - i)
                bound = {"at": 4 * i + 1, "n": 4 * n, "probe": probe}
                row = con.execute(f"SELECT {cut} FROM probe_data WHERE probe_idx = :probe", bound).fetchone()
                snp, beta, se = (np.frombuffer(x, k) for x, k in zip(row, kinds, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, probe, np.int64)),
                        pa.array(np.arange(i, i + n, dtype=np.int32)),
                        pa.array(snp.astype(np.int64)),
                        pa.array(beta.astype(np.float32)),
                        pa.array(se.astype(np.float32)),
                    ],
                    names=ASSOC.fieldNames(),
                )


def quoted(name: str) -> str:
    return '"' + name + '"'


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "eqtl_sqlite"

    def schema(self) -> StructType:
        return TABLES[self.options["table"]]

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options, TABLES[self.options["table"]])


def read_table(spark: SparkSession, path: str, table: str, **options: object) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("eqtl_sqlite").option("path", path).option("table", table)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def read_assoc(spark: SparkSession, path: str, probes: Iterable[int] | None = None, **options: object) -> DataFrame:
    """The fact of an index; with ``probes`` only these rows' arrays are read."""
    if probes is not None:
        options["probes"] = ",".join(map(str, probes))
    return read_table(spark, path, "probe_data", **options)
