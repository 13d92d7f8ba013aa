"""Spark source for sparse binary association matrices (``.besd``).

The driver reads the header and the offset array (16 bytes a probe) and deals out
stretches of probes of about equal size; executors seek to their slices and give
Arrow batches. Register it with ``register(spark)``; options are ``path``,
``nProbes`` (accepted rows of the probe list), ``valuesPerPartition`` and
``probes`` (rows, comma-separated: only their slices are read).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Magic numbers and header sizes in bytes, before the value count.
MAGIC_3F = 0x40400000
MAGIC_3 = 3
FORMATS = {MAGIC_3F: ("3F", 4), MAGIC_3: ("3", 64)}
VALUES_PER_PARTITION = 4_000_000
BATCH = 100_000


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and its name there."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def open_file(path: str) -> pa.NativeFile:
    """A seekable file of any file system that pyarrow knows."""
    system, name = locate(path)
    return system.open_input_file(name)


def create_file(path: str) -> pa.NativeFile:
    """A file to write, with its parent folders."""
    system, name = locate(path)
    system.create_dir(name.rpartition("/")[0] or ".", recursive=True)
    return system.open_output_stream(name)


@dataclass
class Layout:
    """Where the parts of a file lie."""

    kind: str
    cols: np.ndarray
    n_values: int
    rowid_at: int

    @property
    def val_at(self) -> int:
        return self.rowid_at + 4 * self.n_values


def read_layout(path: str, n_probes: int) -> Layout:
    with open_file(path) as f:
        head = f.read(4)
        if len(head) < 4:
            raise ValueError(f"{path} is too short for a header")
        magic = int(np.frombuffer(head, "<u4")[0])
        if magic not in FORMATS:
            raise ValueError(f"Unsupported BESD magic: 0x{magic:08x}")
        kind, at = FORMATS[magic]
        f.seek(at)
        n_values = int(np.frombuffer(f.read(8), "<u8")[0])
        size = 8 * (2 * n_probes + 1)
        cols = np.frombuffer(f.read(size), "<u8").astype(np.int64)
        layout = Layout(kind, cols, n_values, at + 8 + size)
        if len(cols) < 2 * n_probes + 1 or f.size() < layout.val_at + 4 * n_values:
            raise ValueError(f"{path} is truncated: it should have {layout.val_at + 4 * n_values} bytes")
        return layout


@dataclass
class Stretch(InputPartition):
    """Slices (probe, first ord, ord after the last, effect at, error at)."""

    slices: Sequence[tuple[int, int, int, int, int]]
    n_values: int
    rowid_at: int

    def __init__(self, slices, n_values, rowid_at):
        self.slices, self.n_values, self.rowid_at = slices, n_values, rowid_at


def stretches(layout: Layout, values: int, probes: Iterable[int] | None = None) -> Iterator[Stretch]:
    """Cut the probes (all, or those given), and probes that are too wide, into even
    stretches."""
    held, size = [], 0
    n_probes = (len(layout.cols) - 1) // 2
    for p in range(n_probes) if probes is None else sorted(x for x in set(probes) if 0 <= x < n_probes):
        begin, middle = int(layout.cols[2 * p]), int(layout.cols[2 * p + 1])
        for first in range(0, max(0, middle - begin), values):
            last = min(first + values, middle - begin)
            if held and size + last - first > values:
                yield Stretch(held, layout.n_values, layout.rowid_at)
                held, size = [], 0
            held.append((p, first, last, begin, middle))
            size += last - first
    if held:
        yield Stretch(held, layout.n_values, layout.rowid_at)


class BesdReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.n_probes = int(options["nProbes"])
        self.values = int(options.get("valuesPerPartition", VALUES_PER_PARTITION))
        rows = options.get("probes")
        self.probes = None if rows is None else [int(x) for x in rows.split(",") if x]

    def partitions(self) -> Sequence[InputPartition]:
        found = list(stretches(read_layout(self.path, self.n_probes), self.values, self.probes))
        return found or [Stretch([], 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        val_at = partition.rowid_at + 4 * partition.n_values
        with open_file(self.path) as f:

            def part(at: int, first: int, last: int, kind: str) -> np.ndarray:
                """Elements that the file has; those beyond its end are left out."""
                last = min(last, partition.n_values)
                if first >= last:
                    return np.empty(0, kind)
                f.seek(at + 4 * first)
                return np.frombuffer(f.read(4 * (last - first)), kind)

            for probe, first, last, begin, middle in partition.slices:
                for i in range(first, last, BATCH):
                    j = min(i + BATCH, last)
                    snp = part(partition.rowid_at, begin + i, begin + j, "<u4")
                    beta = part(val_at, begin + i, begin + j, "<f4")
                    se = part(val_at, middle + i, middle + j, "<f4")
                    n = min(len(snp), len(beta), len(se))
                    if n:
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(n, probe, np.int64)),
                                pa.array(np.arange(i, i + n, dtype=np.int32)),
                                pa.array(snp[:n].astype(np.int64)),
                                pa.array(beta[:n].astype(np.float32)),
                                pa.array(se[:n].astype(np.float32)),
                            ],
                            names=["probe_idx", "ord", "snp_idx", "beta", "se"],
                        )


class BesdSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "besd"

    def schema(self) -> str:
        return "probe_idx long, ord int, snp_idx long, beta float, se float"

    def reader(self, schema) -> BesdReader:
        return BesdReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BesdSource)


def read_assoc(
    spark: SparkSession, path: str, n_probes: int, probes: Iterable[int] | None = None, **options: object
) -> DataFrame:
    """The fact of a file; with ``probes`` only the slices of these rows are read."""
    register(spark)
    if probes is not None:
        options["probes"] = ",".join(map(str, probes))
    reader = spark.read.format("besd").option("path", path).option("nProbes", n_probes)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
