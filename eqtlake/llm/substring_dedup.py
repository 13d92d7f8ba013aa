"""Substring deduplication by seed and extend.

Every run of ``length`` words has one winnowed anchor (the rightmost least k-gram
hash in it), so equal runs have equal anchors. Documents are joined on anchors;
around each shared anchor the match is extended both ways to all runs that the
anchor stands for; runs that also start in an earlier document are removed, and
neighbouring ones merge into maximal repeats.

Documents are stored as packs first, and anchors, runs and the result are all read
from them. A pack sends each distinct hash once, so a text that a third of all
documents share costs one row a pack and no pairs are made; hashes meet in
aggregates with partial sums, and those found come back by a join with one row for
each hash, whose skew adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .fingerprint import Batch, ngram_hashes, winnow
from .packs import answers, each_pack, entries, is_in, pack_texts

LENGTH = 13
ANCHOR = 5
_LAST = np.iinfo(np.int64).max


def _order_key(ids: list) -> np.ndarray:
    """Ids to compare; a null one is after all others."""
    return np.array([_LAST if i is None else i for i in ids], np.int64)


def _least(of: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    least = np.full(n, _LAST)
    np.minimum.at(least, of, doc)
    return least


class Windows:
    """The runs of a pack: first word, hash, document, and anchor."""

    def __init__(self, batch: Batch, length: int, anchor: int):
        grams = ngram_hashes(batch.words, anchor)
        best = winnow(grams, length - anchor + 1)
        row = batch.row_of_word()
        inside = row[: len(best)] == row[length - 1 :] if len(best) else np.empty(0, bool)
        self.start = np.flatnonzero(inside)
        self.hash = ngram_hashes(batch.words, length)[self.start].view(np.int64)
        self.doc = _order_key(batch.ids)[row[self.start]]
        self.anchor = grams[best[self.start]].view(np.int64)


def _anchors(length: int, anchor: int):
    """(uid, hash, several): a pack's distinct anchors, and whether more than one
    of its documents has the anchor."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in each_pack(stream):
            w = Windows(pack.batch(), length, anchor)
            found, of = np.unique(w.anchor, return_inverse=True)
            several = np.zeros(len(found), bool)
            several[of[w.doc > _least(of, w.doc, len(found))[of]]] = True
            yield entries(pack.uid, hash=found, several=several)

    return run


def _runs(length: int, anchor: int):
    """(uid, hash, least): a pack's runs around shared anchors with their least ids."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in each_pack(stream):
            w = Windows(pack.batch(), length, anchor)
            shared = is_in(w.anchor, np.sort(pack.found("shared").field("hash").to_numpy()))
            found, of = np.unique(w.hash[shared], return_inverse=True)
            yield entries(pack.uid, hash=found, least=_least(of, w.doc[shared], len(found)))

    return run


def _keep(length: int, anchor: int):
    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in each_pack(stream):
            batch = pack.batch()
            w = Windows(batch, length, anchor)
            found, of = np.unique(w.hash, return_inverse=True)
            goes = w.doc > _least(of, w.doc, len(found))[of]
            goes |= is_in(w.hash, np.sort(pack.found("earlier").field("hash").to_numpy()))
            starts = w.start[goes]
            edge = np.zeros(len(batch.words) + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + length, -1)
            yield _result(batch, np.cumsum(edge[:-1]) > 0)

    return run


def _result(batch: Batch, gone: np.ndarray) -> pa.RecordBatch:
    n_words = np.diff(batch.bounds)
    removed, kept, repeats = [], [], []
    for text, i, j in zip(batch.texts, batch.bounds[:-1].tolist(), batch.bounds[1:].tolist(), strict=True):
        own = gone[i:j]
        n = int(own.sum())
        removed.append(n)
        words = text.split()
        if n:
            words = [w for w, g in zip(words, own.tolist(), strict=True) if not g]
        kept.append(b" ".join(words))
        turns = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]])))
        repeats.append([{"first": int(a), "n": int(b - a)} for a, b in zip(turns[::2], turns[1::2], strict=True)] if n else [])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(batch.ids, pa.int64()),
            pa.array(n_words, pa.int64()),
            pa.array(removed, pa.int64()),
            pa.array(kept, pa.binary()).cast(pa.string()),
            pa.array(repeats, pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))),
        ],
        names=["doc_id", "n_words", "n_removed", "kept_text", "repeats"],
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, repeats), a row per input row.

    A word goes if a run of ``length`` words that covers it also starts in a
    document with a smaller doc_id; runs are judged on the input. ``repeats`` are
    the maximal removed stretches (first word, number of words); ``kept_text``
    has the other words, joined by one space. A null or empty text has no words.
    Null ids are after all others and equal to each other; rows that repeat an id
    do not remove each other's words. An empty table gives an empty result.
    Columns besides doc_id and text are ignored. Words are compared unchanged, by
    64-bit hashes of their runs.
    """
    packs = pack_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(True)), "repeat-packs")
    seeds = materialize(packs.mapInArrow(_anchors(length, anchor), "uid long, hash long, several boolean"), "repeat-anchors")
    # Stored, so that the joins' sides are plain shuffles, which can be split.
    shared = materialize(
        seeds.groupBy("hash")
        .agg(F.count("*").alias("n"), F.max("several").alias("several"))
        .where("n > 1 or several")
        .select("hash"),
        "repeat-shared",
    )
    marks = materialize(answers(seeds.join(shared, "hash"), "shared", "hash"), "repeat-marks")
    release(seeds)
    release(shared)
    marked = packs.join(marks, "uid", "left")
    runs = materialize(marked.mapInArrow(_runs(length, anchor), "uid long, hash long, least long"), "repeat-runs")
    release(marks)
    first = materialize(
        runs.groupBy("hash").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first < last").drop("last"),
        "repeat-first",
    )
    later = runs.join(first, "hash").where("first < least")
    earlier = materialize(answers(later, "earlier", "hash"), "repeat-earlier")
    release(runs)
    release(first)
    return packs.join(earlier, "uid", "left").mapInArrow(
        _keep(length, anchor),
        "doc_id long, n_words long, n_removed long, kept_text string, repeats array<struct<first:long,n:long>>",
    )
