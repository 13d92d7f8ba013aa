"""Packs: a stored table of texts in batches of bounded size.

A pack is one row: a number of its own, the ids of its texts, a flag for each, and
the texts compressed. Operators that look up keys of the whole corpus send one row
for each distinct key of a pack; keys are aggregated in the JVM, where partial sums
come before the shuffle and large partitions spill, and the answers are gathered by
pack. A key that all texts share costs one row a pack.

Everything is derived from the stored rows, so a pack's number means the same texts
when a task runs again or a scan is cut in another way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize
from .fingerprint import Batch, batches, hash_rows, slices

PACK = "uid long, n_flagged long, ids binary, sizes binary, flags binary, blob binary"
_CODEC = "zstd"


def _pack(kind: pa.DataType):
    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for n, batch in enumerate(batches(stream, words=False)):
            sink = pa.BufferOutputStream()
            table = pa.table({"id": pa.array(batch.ids, kind)})
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            flags = np.array(batch.extra, bool)
            row = {
                "uid": first | n,
                "n_flagged": int(flags.sum()),
                "ids": sink.getvalue().to_pybytes(),
                "sizes": np.array([len(t) for t in batch.texts], np.int64).tobytes(),
                "flags": flags.tobytes(),
                "blob": pa.Codec(_CODEC).compress(b"".join(batch.texts), asbytes=True),
            }
            yield pa.RecordBatch.from_pylist([row], _SCHEMA)

    return run


_SCHEMA = pa.schema(
    [("uid", pa.int64()), ("n_flagged", pa.int64())] + [(c, pa.binary()) for c in ("ids", "sizes", "flags", "blob")]
)


def pack_texts(rows: DataFrame, name: str) -> DataFrame:
    """The stored packs of (id, text, flag)."""
    return materialize(rows.mapInArrow(_pack(to_arrow_type(rows.schema[0].dataType)), PACK), name)


class Pack:
    """One row of the table, and what was found for it (columns from outside)."""

    def __init__(self, row: pa.RecordBatch):
        self._row = row
        self.uid = row.column("uid")[0].as_py()
        self.flags = np.frombuffer(self._bytes("flags"), bool)

    def _bytes(self, name: str) -> bytes:
        return self._row.column(name)[0].as_py()

    def ids(self) -> pa.Array:
        return pa.ipc.open_stream(self._bytes("ids")).read_all().column("id").combine_chunks()

    def texts(self) -> list[bytes]:
        sizes = np.frombuffer(self._bytes("sizes"), np.int64)
        whole = int(sizes.sum())
        data = pa.Codec(_CODEC).decompress(self._bytes("blob"), whole, asbytes=True) if whole else b""
        return [data[e - n : e] for e, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)]

    def batch(self, lower: bool = False) -> Batch:
        """The texts and the hashes of their words, of A-Z in lower case if asked for."""
        texts = self.texts()
        hashed = hash_rows([t.lower() for t in texts] if lower else texts)
        return Batch(self.ids().to_pylist(), texts, self.flags.tolist(), *hashed)

    def found(self, name: str) -> pa.StructArray:
        """Answers of a column that ``answers`` made; none if it is null."""
        return self._row.column(name).flatten()


def each_pack(stream: Iterable[pa.RecordBatch]) -> Iterator[Pack]:
    return map(Pack, slices(stream, 1))


def entries(uid: int, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows of one pack: its number and the given columns."""
    n = len(next(iter(columns.values())))
    held = {"uid": np.full(n, uid, np.int64)} | columns
    return pa.RecordBatch.from_arrays([pa.array(x) for x in held.values()], names=list(held))


def answers(found: DataFrame, name: str, *columns: str) -> DataFrame:
    """(uid, name): what was found for each pack as one array, bounded by the pack."""
    return found.groupBy("uid").agg(F.collect_list(F.struct(*columns)).alias(name))


def is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values
