"""MinHash near-duplicates.

One-permutation hashing with optimal densification gives each shingle set a
signature; bands of it are buckets; in a bucket every member is paired with the
bucket's centre only. Pairs are confirmed on the full sets, and confirmed links
are closed into components by label propagation in Spark. Where a bucket still
holds several components, their members are compared across components by
blocks, so no link is lost because its bucket had another centre.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, release
from .fingerprint import U64, batches, mix, ngram_hashes, slices, word_hashes

BINS = 128
ROWS_PER_BAND = 4
BANDS = BINS // ROWS_PER_BAND
#: Members of a bucket that one task compares with as many others.
BLOCK = 2048


def least_agreement(percent: int, size: np.ndarray) -> np.ndarray:
    """Slots of two signatures that must agree before sets, the smaller of
    ``size`` shingles, are compared in full: six standard deviations under what
    the threshold expects. Bins that borrow double the variance of small sets. A
    pair at the threshold is ruled out with a chance of about 1e-9; below some 30
    shingles the bound is under what any pair has and rules nothing out."""
    p = percent / 100
    return BINS * (p - 6 * np.sqrt(2 * p * (1 - p) / np.clip(size, 1, BINS)))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles; of fewer words, the
    whole sequence is one."""
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(ngram_hashes(words, min(width, len(words))))


def _probe(bins: np.ndarray, attempt: int) -> np.ndarray:
    """The bin that an empty bin asks at this attempt; the same for all sets."""
    with np.errstate(over="ignore"):
        return mix(bins.astype(np.uint64) * U64(1_000_003) + U64(attempt + 1)) % U64(BINS)


_PROBES = np.stack([_probe(np.arange(BINS), a) for a in range(4096)]).astype(np.int64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation signature: the least hash of each bin, where an empty bin
    takes the value of the first non-empty one on its own probe sequence."""
    order = mix(shingles)
    bins = (order >> U64(57)).astype(np.int64)
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, bins, order)
    filled = np.zeros(BINS, bool)
    filled[bins] = True
    empty = np.flatnonzero(~filled)
    result = out.copy()
    attempt = 0
    while len(empty) and attempt < len(_PROBES):
        asked = _PROBES[attempt, empty]
        found = filled[asked]
        result[empty[found]] = out[asked[found]]
        empty = empty[~found]
        attempt += 1
    result[empty] = out[np.flatnonzero(filled)[0]]
    return result


def band_keys(sig: np.ndarray) -> np.ndarray:
    return ngram_hashes_rows(sig.reshape(BANDS, ROWS_PER_BAND))


def ngram_hashes_rows(rows: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.arange(1, len(rows) + 1).astype(np.uint64)
        for k in range(rows.shape[1]):
            h = h * U64(0xD6E8FEB86659FD93) + rows[:, k]
        return mix(h)


def _sign(width: int):
    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, lower=True):
            sizes, keys, sigs, bands = [], [], [], []
            for i, j in zip(batch.bounds[:-1], batch.bounds[1:], strict=True):
                s = shingle_set(batch.words[i:j], width)
                sizes.append(len(s))
                if not len(s):
                    keys.append(None)
                    sigs.append(None)
                    bands.append(None)
                    continue
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig = signature(s)
                sigs.append((sig & U64(255)).astype(np.uint8).tobytes())
                bands.append(band_keys(sig).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(sigs, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_key", "sig", "bands"],
            )

    return run


def _confirm(width: int, percent: int):
    """Whether the two texts' sets reach ``percent`` of their union."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last = None, None
        for batch in slices(stream):
            linked = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "text_a", "text_b")), strict=True):
                if a != last_id or last is None:
                    last_id, last = a, shingle_set(word_hashes((ta or "").encode().lower()), width)
                other = shingle_set(word_hashes((tb or "").encode().lower()), width)
                shared = len(np.intersect1d(last, other, assume_unique=True))
                linked.append(bool(shared) and 100 * shared >= percent * (len(last) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    return run


def _signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _agreeing(percent: int):
    """Pairs whose signatures do not already rule the link out."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            a, b = _signatures(batch.column("sig_a")), _signatures(batch.column("sig_b"))
            size = np.minimum(batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy())
            keep = pa.array((a == b).sum(1) >= least_agreement(percent, size))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    return run


def _sets(width: int):
    """Shingle sets of labelled texts."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream):
            sets = [
                shingle_set(word_hashes((t or "").encode().lower()), width).view(np.int64)
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(sets, pa.list_(pa.int64()))],
                names=["doc_id", "label", "shingles"],
            )

    return run


#: Places of a matrix, and pairs, worked on at once.
_WIDE, _PAIRS = 4096, 4 << 20


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right.

    Elements that many sets have are multiplied as matrices, so a family of near
    copies costs a product of its common text; those of few sets are counted pair
    by pair.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    known = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, element) by element, and how many sets have each."""
        of, values = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.searchsorted(known, values)
        mine = np.flatnonzero(at < len(known))
        mine = mine[known[at[mine]] == values[mine]]
        order = mine[np.argsort(at[mine], kind="stable")]
        return of[order], at[order], np.bincount(at[order], minlength=len(known))

    (r, x, n_r), (c, y, n_c) = places(left), places(right)
    first_c = np.cumsum(n_c) - n_c
    many = 100 * n_r * n_c > out.size
    columns = np.cumsum(many) - 1
    for i in range(0, int(many.sum()), _WIDE):
        sides = []
        for sets, of, at in ((left, r, x), (right, c, y)):
            mine = many[at] & (columns[at] >= i) & (columns[at] < i + _WIDE)
            side = np.zeros((len(sets), _WIDE), np.float32)
            side[of[mine], columns[at[mine]] - i] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    few = np.flatnonzero(~many[x])
    times = n_c[x[few]]
    ends = np.cumsum(times)
    i = 0
    while i < len(few):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _PAIRS)))
        t = times[i:j]
        step = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        other = c[np.repeat(first_c[x[few[i:j]]], t) + step]
        pair = np.repeat(r[few[i:j]], t) * len(right) + other
        out += np.bincount(pair, minlength=out.size).reshape(out.shape)
        i = j
    return out


def _across(percent: int):
    """Links that join different components among two blocks of a family, one for
    each two components."""

    def run(group: pa.Table) -> pa.Table:
        doc, label, block, left, right = (
            group.column(c).to_numpy() for c in ("doc_id", "label", "block", "first", "second")
        )
        # Sorted as the unsigned numbers that they are.
        sets = [s.view(np.uint64) for s in group.column("shingles").to_numpy(zero_copy_only=False)]
        size = np.array([len(s) for s in sets], np.int64)
        rows, columns = np.flatnonzero(block == left[0]), np.flatnonzero(block == right[0])
        found: set[tuple[int, int]] = set()
        if len(rows) and len(columns):
            shared = intersections([sets[i] for i in rows], [sets[i] for i in columns])
            both = size[rows][:, None] + size[columns][None, :]
            apart = label[rows][:, None] != label[columns][None, :]
            x, y = np.nonzero(apart & (shared > 0) & (100 * shared.astype(np.int64) >= percent * (both - shared)))
            names = np.stack([label[rows[x]], label[columns[y]]], 1)
            _, at = np.unique(np.sort(names, 1), axis=0, return_index=True)
            for a, b in zip(doc[rows[x[at]]].tolist(), doc[columns[y[at]]].tolist(), strict=True):
                found.add((min(a, b), max(a, b)))
        a, b = zip(*sorted(found), strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def confirm_pairs(pairs: DataFrame, sets: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, linked) for the pairs (a, b) that sizes and signatures allow.

    Texts move once to meet b and once more, for these pairs alone, to meet a.
    """
    side = sets.select("doc_id", "sig", "n_shingles")
    likely = (
        pairs.join(side.toDF("a", "sig_a", "size_a"), "a")
        .join(side.toDF("b", "sig_b", "size_b"), "b")
        .where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
        .select("a", "b", "sig_a", "sig_b", "size_a", "size_b")
        .mapInArrow(_agreeing(percent), "a long, b long")
    )
    with_b = likely.join(texts.toDF("b", "text_b"), "b")
    both = with_b.join(texts.toDF("a", "text_a"), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(
        _confirm(width, percent), "a long, b long, linked boolean"
    )


def components(nodes: DataFrame, links: DataFrame, name: str = "components") -> DataFrame:
    """(doc_id, component_id): the smallest id reachable over ``links`` (a, b).

    Labels start as the least id nearby; each round takes the least label of the
    neighbours and then the label of that label, and ends when none changes.
    Rounds are written to the shared folder. Labels are broadcast if they are few,
    which is counted once, as their number stays; else they are joined.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")), f"{name}-0")
    few = labels.count() <= BROADCAST_ROWS
    step = 0
    while True:
        step += 1
        side = F.broadcast(labels) if few else labels
        near = both.join(side.toDF("b", "near"), "b").select(F.col("a").alias("v"), "near", F.lit(None).cast("long").alias("label"))
        own = labels.select("v", F.col("label").alias("near"), "label")
        lower = near.union(own).groupBy("v").agg(F.min("label").alias("label"), F.min("near").alias("lower"))
        jumped = lower.join(side.toDF("lower", "jump"), "lower")
        following = materialize(
            jumped.select(
                "v", F.least("lower", "jump").alias("label"), (F.least("lower", "jump") < F.col("label")).alias("changed")
            ),
            f"{name}-{step}",
        )
        done = following.where("changed").limit(1).count() == 0
        release(labels)
        labels = following.drop("changed")
        if done:
            break
    return nodes.join(labels.toDF("doc_id", "label"), "doc_id", "left").select(
        *[F.col(c) for c in nodes.columns], F.coalesce("label", "doc_id").alias("component_id")
    )


def _mixed(entries: DataFrame, name: str) -> DataFrame:
    """Entries (key, doc_id, label) of buckets with more than one component.

    The buckets are stored first: then both sides of the join are plain shuffles,
    and adaptive execution splits a bucket that holds many entries.
    """
    keys = entries.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return entries.join(materialize(keys.select("key", F.col("low").alias("root")), name), "key")


def _links_across(
    entries: DataFrame, label: DataFrame, texts: DataFrame, width: int, percent: int
) -> DataFrame:
    """Links (a, b) between components that share buckets (key, doc_id).

    Documents in buckets of several components get the number of their shingles
    that other components have too. Where that is too small for a link with
    anything, the document is done. The others form families, which are
    connected by their buckets, and are compared by blocks of bounded size.
    """
    known = materialize(entries.join(label.toDF("doc_id", "label"), "doc_id"), "near-entries")
    mixed = materialize(_mixed(known, "near-mixed-keys"), "near-mixed")
    wanted = mixed.select("doc_id", "label").distinct()
    sets = materialize(
        wanted.join(texts, "doc_id").mapInArrow(_sets(width), "doc_id long, label long, shingles array<long>"), "near-sets"
    )
    single = sets.select("doc_id", "label", F.explode("shingles").alias("shingle"))
    spread = (
        single.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    )
    outer = single.join(spread.select("shingle"), "shingle").groupBy("doc_id").agg(F.count("*").alias("outer"))
    alive = materialize(
        outer.join(sets.select("doc_id", F.size("shingles").alias("n")), "doc_id")
        .where(100 * F.col("outer") >= percent * F.col("n"))
        .select("doc_id")
        .distinct(),
        "near-alive",
    )
    still = materialize(mixed.select("key", "doc_id", "label").join(alive, "doc_id"), "near-still")
    left = materialize(_mixed(still, "near-left-keys"), "near-left")
    heads = materialize(left.groupBy("key").agg(F.min("doc_id").alias("head")), "near-heads")
    edges = materialize(
        left.join(heads, "key").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct(), "near-families"
    )
    nodes = edges.select(F.col("b").alias("doc_id")).distinct()
    family = materialize(components(nodes, edges.where("a != b"), "near-family"), "near-family-labels")
    blocks = family.groupBy("component_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        family.join(blocks, "component_id")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("first", F.least("block", "other"))
        .withColumn("second", F.greatest("block", "other"))
        .drop("other", "blocks")
        .join(sets, "doc_id")
    )
    return dealt.groupBy("component_id", "first", "second").applyInArrow(_across(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per input row.

    Documents whose sets of ``width``-word shingles (A-Z in lower case) have an
    intersection of at least ``percent`` hundredths of their union are linked;
    the component is the smallest id reachable, and its row is ``kept``. Equal
    sets form one class, of which only the smallest id goes through the buckets.
    Null or empty texts have an empty set and link with nothing; rows with a null
    id are components of their own and kept. Rows that repeat an id are one
    document, linked by any of its texts. An empty table gives an empty result. Columns besides doc_id and text are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(
        rows.mapInArrow(_sign(width), "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>"),
        "near-signed",
    )
    known = signed.where("doc_id is not null and set_key is not null")
    classes = materialize(
        known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")), "near-classes"
    )
    # A class of one needs no join back; the rest gives membership links.
    several = classes.where("rep < last")
    members = (
        known.select("doc_id", "set_key")
        .join(several, "set_key")
        .where("doc_id > rep")
        .select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    )
    reps = materialize(
        known.join(classes.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"])
        .dropDuplicates(["doc_id", "set_key"])
        .select("doc_id", "n_shingles", "sig", "bands"),
        "near-reps",
    )
    entries = reps.select("doc_id", F.explode("bands").alias("key"))
    # Stored, as in _mixed, so that the entries of a hot bucket can be split.
    buckets = materialize(
        entries.groupBy("key").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last")).where("centre < last").drop("last"),
        "near-buckets",
    )
    placed = materialize(entries.join(buckets, "key"), "near-placed")
    star = placed.where("doc_id > centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    nodes = materialize(placed.select("doc_id").distinct(), "near-nodes")
    # Texts of documents in buckets of two or more, moved once for all that follows.
    texts = materialize(rows.join(nodes, "doc_id"), "near-texts")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        found = confirm_pairs(pairs, reps, texts, width, percent).where("linked")
        return materialize(found.select("a", "b").distinct(), name)

    def labelled(links: DataFrame, name: str) -> DataFrame:
        return materialize(components(nodes, links, name).toDF("v", "label"), f"{name}-labels")

    # Each member against its smallest centre; then against the other centres,
    # where that did not already bring the two into one component.
    first = confirmed(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "near-least")
    label = labelled(first, "near-first")
    apart = (
        star.join(label.toDF("a", "label_a"), "a").join(label.toDF("b", "label_b"), "b").where("label_a != label_b")
    )
    second = confirmed(apart.select("a", "b"), "near-star")
    label = labelled(first.union(second), "near-second")
    third = materialize(
        _links_across(placed.select("key", "doc_id"), label, texts, width, percent), "near-across"
    )
    links = members.union(first).union(second).union(third)
    whole = signed.select("doc_id", "n_shingles")
    return components(whole, links, "near-all").select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
