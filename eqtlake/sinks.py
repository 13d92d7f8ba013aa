"""Sinks for results: tab-separated reports and binary matrices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.formatting import HEADER, report_columns, report_line
from .schemas import RESULT
from .plans.workspace import scratch_path
from .sources.besd import MAGIC_3, MAGIC_3F, create_file, locate


def write_report(found: DataFrame, folder: str, pval_below: float = 0.05) -> None:
    """A folder of tab-separated parts, each with the header, written by tasks."""
    below = found.where(F.col("pval") < pval_below).select(*report_columns())
    below.write.option("sep", "\t").option("header", True).option("quote", "").csv(folder)


def write_report_file(found: DataFrame, prefix: str, pval_below: float = 0.05) -> int:
    """``prefix``.txt in row order, a partition at a time through the driver; the
    number of rows below the threshold. The prefix may be a URI; parent folders are
    made. For reports of any size there is ``write_report``."""
    n = 0
    with create_file(f"{prefix}.txt") as out:
        out.write(("\t".join(HEADER) + "\n").encode())
        for row in found.where(F.col("pval") < pval_below).select(*RESULT).toLocalIterator():
            out.write((report_line(row) + "\n").encode())
            n += 1
    return n


_PART = "part int, probe_idx long, n long"


def _write_parts(folder: str):
    """Task function: the blocks of the partition's probes, SNP rows and values, as
    two files; gives the number of facts of each probe."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, root = locate(folder)
        system.create_dir(root, recursive=True)
        names = [f"{root}/{part:06d}.{x}" for x in ("snp", "val")]
        probes, counts = [], []
        with ExitStack() as stack:
            snp, val = (stack.enter_context(system.open_output_stream(f"{x}.{attempt}")) for x in names)

            def put(probe: int, columns: list[list[np.ndarray]]) -> None:
                rows, beta, se = (np.concatenate(x) for x in columns)
                snp.write(np.tile(rows, 2).astype("<u4").tobytes())
                val.write(np.concatenate([beta, se]).astype("<f4").tobytes())
                probes.append(probe)
                counts.append(len(rows))

            now, held = None, [[], [], []]
            for batch in stream:
                probe, *columns = (batch.column(c).to_numpy() for c in ("probe_idx", "snp_idx", "beta", "se"))
                bounds = [*np.flatnonzero(np.diff(probe, prepend=probe[0] - 1 if len(probe) else 0)).tolist(), len(probe)]
                for i, j in pairwise(bounds):
                    if probe[i] != now and held[0]:
                        put(now, held)
                        held = [[], [], []]
                    now = int(probe[i])
                    for own, column in zip(held, columns, strict=True):
                        own.append(column[i:j])
            if held[0]:
                put(now, held)
        for name in names:
            system.move(f"{name}.{attempt}", name)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(probes), pa.int32()), pa.array(probes, pa.int64()), pa.array(counts, pa.int64())],
            names=["part", "probe_idx", "n"],
        )

    return run


def write_besd(assoc: DataFrame, n_probes: int, path: str, kind: str = "3F") -> None:
    """A binary matrix of (probe_idx, ord, snp_idx, beta, se).

    Tasks write the blocks of ranges of probes to the shared folder; the driver
    writes the offsets (16 bytes a probe) and appends the parts in order, holding
    a few megabytes. A probe's facts are in one task, as its block is one.
    """
    spark = assoc.sparkSession
    folder, done = scratch_path(spark, "besd-parts"), scratch_path(spark, "besd-counts")
    ranged = assoc.select("probe_idx", "ord", "snp_idx", F.col("beta").cast("float"), F.col("se").cast("float"))
    ordered = ranged.repartitionByRange("probe_idx").sortWithinPartitions("probe_idx", "ord").drop("ord")
    ordered.mapInArrow(_write_parts(folder), _PART).write.parquet(done)
    found = spark.read.schema(_PART).parquet(done).toArrow()  # a row a probe, as the offsets
    counts = np.zeros(n_probes, np.int64)
    counts[found.column("probe_idx").to_numpy()] = found.column("n").to_numpy()
    cols = np.concatenate([[0], np.cumsum(np.repeat(counts, 2))])
    system, root = locate(folder)
    with create_file(path) as out:
        out.write(np.array([MAGIC_3F if kind == "3F" else MAGIC_3], "<u4").tobytes())
        if kind == "3":
            out.write(bytes(60))
        out.write(np.array([cols[-1]], "<u8").tobytes())
        out.write(cols.astype("<u8").tobytes())
        for suffix in ("snp", "val"):
            for part in sorted(set(found.column("part").to_pylist())):
                with system.open_input_stream(f"{root}/{part:06d}.{suffix}") as source:
                    while data := source.read(8 << 20):
                        out.write(data)
