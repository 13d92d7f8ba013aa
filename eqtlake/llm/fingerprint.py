"""Vectorised word and n-gram hashes over UTF-8 bytes, and packed batches.

A word is a run of bytes outside ASCII whitespace. Its hash is a polynomial over
its bytes modulo 2**64 with a final mix, computed for a whole buffer at once.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library has no malloc_trim
    _LIBC = None

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: 3 modulo 8, so that neither it nor it less one has many factors of two.
_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Bytes hashed at once, so that temporary arrays stay in the cache.
CHUNK = 1 << 19

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = 1 << max(n, CHUNK + 4096).bit_length()
        table = np.empty(size, np.uint64)
        table[0] = 1
        done = 1
        while done < size:
            step = min(done, size - done)
            with np.errstate(over="ignore"):
                table[done : done + step] = table[:step] * U64(pow(base, done, 1 << 64))
            done += step
        _powers[base] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """One hash for each word of ``data``."""
    buf = np.frombuffer(data, np.uint8)
    if not len(buf):
        return np.empty(0, np.uint64)
    space = np.ones(len(buf) + 2, bool)
    space[1:-1] = _SPACE[buf]
    turns = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = turns[::2], turns[1::2]
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_VALUES[buf] * _power_table(_BASE, len(buf))[: len(buf)], out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * _power_table(_INVERSE, len(buf))[starts]
        return mix(h + (ends - starts).astype(np.uint64))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * U64(0xD6E8FEB86659FD93) + words[k : k + m]
        return mix(h)


@dataclass
class Batch:
    """Rows in their order and the hashes of all their words."""

    ids: list
    texts: list[bytes]
    extra: list
    words: np.ndarray
    bounds: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.bounds))


def hash_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text begins."""
    parts, counts, group, size = [], [0], [], 0

    def flush() -> None:
        joined = b" ".join(group)
        h = word_hashes(joined)
        parts.append(h)
        if len(group) == 1:
            counts.append(len(h))
            return
        counts.extend(len(t.split()) for t in group)

    for t in texts:
        group.append(t)
        size += len(t)
        if size >= CHUNK:
            flush()
            group, size = [], 0
    if group:
        flush()
    words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return words, np.cumsum(np.array(counts, np.int64))


def slices(stream: Iterable[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, so that only they become Python objects."""
    for batch in stream:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
        give_back()


def give_back() -> None:
    """Return freed memory to the system: workers are kept between stages, and
    what they hold is missing for the executor's next one."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def batches(
    stream: Iterable[pa.RecordBatch],
    size: int = 2 << 20,
    lower: bool = False,
    words: bool = True,
) -> Iterator[Batch]:
    """Regroup Arrow batches of (id, text[, extra]) to about ``size`` bytes of text.

    A text is never split, so one longer than ``size`` is a batch of its own.
    ``lower`` hashes the words with A-Z in lower case; texts stay as they are.
    Without ``words`` nothing is hashed.
    """
    ids: list = []
    texts: list[bytes] = []
    extra: list = []
    held = 0

    def made() -> Batch:
        hashed = hash_rows(([t.lower() for t in texts] if lower else texts) if words else [])
        return Batch(ids, texts, extra, *hashed)

    for part in slices(stream):
        column = part.column(1).cast(pa.large_binary()).to_pylist()
        more = part.column(2).to_pylist() if part.num_columns > 2 else [None] * len(column)
        for i, t, x in zip(part.column(0).to_pylist(), column, more, strict=True):
            ids.append(i)
            texts.append(t or b"")
            extra.append(x)
            held += len(texts[-1])
            if held >= size:
                yield made()
                ids, texts, extra, held = [], [], [], 0
    if ids:
        yield made()


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` hashes the place of its rightmost minimum."""
    m = len(hashes) - window + 1
    if m <= 0:
        return np.empty(0, np.int64)
    best = np.arange(m)
    low = hashes[:m].copy()
    for k in range(1, window):
        other = hashes[k : k + m]
        take = other <= low
        low[take] = other[take]
        best[take] = np.arange(k, k + m)[take]
    return best
