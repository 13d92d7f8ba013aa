"""Language-model scoring by prediction by partial matching.

A byte-context trie of order 3 is trained on the corpus: counts of every symbol
after every context of up to three bytes. Escapes are estimated by method C
(an escape weighs as many symbols as the context has seen), with the symbols of
the longer context excluded in the shorter one. A trained trie gives fixed
distributions, so each context's is worked out once, and scoring a text is a
gather over its bytes plus the end symbol. Tasks hold the distributions of the
most frequent three-byte contexts, the head; those of all others stay in a table,
and a pack of texts asks for the ones that it has, so every context seen has its
own distribution however many there are.

Beside it, a unigram base score over words needs the count of every token in the
training rows; those counts follow the corpus in size and never leave Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .packs import Pack, answers, each_pack, entries, is_in, pack_texts

FOLDS = 10
#: Symbols: 256 bytes and the end of the text.
SYMBOLS = 257
END = 256
#: Contexts of three bytes whose distributions every task holds, the most frequent
#: first. A task's model takes 41 MB for them, at most 68 MB for contexts of two
#: bytes and at most 68 MB for the places of three; others are looked up.
LONG_CONTEXTS = 40_000
#: Words whose counts every task holds (1 MB), the most frequent first, so that packs
#: ask for the others only.
COMMON_WORDS = 65_536
#: Distinct keys whose counts a task gathers before it sends them on.
HELD_KEYS = 4 << 20
ALPHA = 0.1


def fold(row_id: Column) -> Column:
    """crc32 of the id as text modulo FOLDS; a null id counts as empty text."""
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


# ---- the trie -------------------------------------------------------------


def gram_codes(data: bytes) -> np.ndarray:
    """Code of (three bytes before, symbol) for each byte and the end.

    A text begins after three zero bytes.
    """
    buf = np.frombuffer(b"\0\0\0" + data, np.uint8).astype(np.int64)
    symbols = np.append(buf[3:], END)
    before = (buf[:-2] << 16) | (buf[1:-1] << 8) | buf[2:]
    return before * SYMBOLS + symbols


def _count(keys):
    """Task function: (key, n) over the packs, ``keys`` of each, summed over the task
    as far as memory allows."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for pack in each_pack(stream):
            new, n = np.unique(keys(pack), return_counts=True)
            known, at = np.unique(np.concatenate([known, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(known)).astype(np.int64)
            if len(known) >= HELD_KEYS:
                yield from _counted(known, counts)
                known, counts = known[:0], counts[:0]
        yield from _counted(known, counts)

    return run


def _counted(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(keys), 200_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[i : i + 200_000]), pa.array(counts[i : i + 200_000])], names=["key", "n"]
        )


def _grams(pack: Pack) -> np.ndarray:
    """Codes of the flagged texts."""
    held = [gram_codes(t) for t, own in zip(pack.texts(), pack.flags, strict=True) if own]
    return np.concatenate(held) if held else np.empty(0, np.int64)


def _words(pack: Pack) -> np.ndarray:
    """Word hashes of the flagged texts, A-Z in lower case."""
    batch = pack.batch(lower=True)
    return batch.words[pack.flags[batch.row_of_word()]].view(np.int64)


def counted(packs: DataFrame, keys, column: str, name: str) -> DataFrame:
    """(column, n): how often each key occurs in the flagged texts of all packs."""
    parts = packs.mapInArrow(_count(keys), "key long, n long")
    return materialize(parts.groupBy(F.col("key").alias(column)).agg(F.sum("n").alias("n")), name)


@dataclass
class Tails:
    """Distributions of a pack's contexts outside the head: sorted codes seen with
    their log10 probabilities, and for the symbols that a context has not seen what
    is added to those after its last two bytes."""

    codes: np.ndarray
    logs: np.ndarray
    contexts: np.ndarray
    unseen: np.ndarray

    def log10(self, context: np.ndarray, symbol: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        out = shorter.astype(np.float64)
        known = is_in(context, self.contexts)
        out[known] += self.unseen[np.searchsorted(self.contexts, context[known])]
        code = context * SYMBOLS + symbol
        seen = is_in(code, self.codes)
        out[seen] = self.logs[np.searchsorted(self.codes, code[seen])]
        return out


@dataclass
class Trie:
    """log10 probabilities by context. ``pairs`` maps two bytes to a row of
    ``short``; ``triples`` maps (row of two bytes, byte) to a row of ``long``."""

    pairs: np.ndarray
    short: np.ndarray
    triples: np.ndarray
    long: np.ndarray

    def log10(self, data: bytes, tails: Tails | None = None) -> float:
        """log10 probability of the text with its end; contexts outside ``long`` go
        by ``tails`` and then by their last two bytes."""
        total, n = 0.0, len(data) + 1
        whole = b"\0\0\0" + data
        for i in range(0, n, 1 << 18):
            buf = np.frombuffer(whole[i : i + (1 << 18) + 3], np.uint8).astype(np.int64)
            m = min(1 << 18, n - i)
            symbols = buf[3 : 3 + m] if len(buf) >= 3 + m else np.append(buf[3:], END)
            # Context rows: (c2, c3) for two bytes, (c1, c2) and c3 for three.
            two = self.pairs[(buf[1 : m + 1] << 8) | buf[2 : m + 2]]
            first = self.pairs[(buf[:m] << 8) | buf[1 : m + 1]]
            three = self.triples[first * 256 + buf[2 : m + 2]]
            at = np.flatnonzero(three < 0)
            total += float(self.long[np.maximum(three, 0), symbols].sum(dtype=np.float64, where=three >= 0))
            if len(at):
                other = self.short[two[at], symbols[at]]
                if tails is not None:
                    before = (buf[at] << 16) | (buf[at + 1] << 8) | buf[at + 2]
                    other = tails.log10(before, symbols[at], other)
                total += float(other.sum(dtype=np.float64))
        return total

    def in_long(self, contexts: np.ndarray) -> np.ndarray:
        return self.triples[self.pairs[contexts >> 8] * 256 + (contexts & 255)] >= 0


def _escape(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Symbol probabilities of contexts, one row of ``counts`` each.

    ``lower`` has the finished probabilities of each row's next shorter context.
    After an escape the symbols already seen are excluded there, so what is left
    of it is scaled to the escape's probability.
    """
    seen = counts > 0
    total, kinds = counts.sum(1, keepdims=True), seen.sum(1, keepdims=True)
    own = counts / np.maximum(total + kinds, 1)
    rest = np.where(seen, 0.0, lower)
    weight = rest.sum(1, keepdims=True)
    escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
    shared = np.where(weight > 0, rest / np.where(weight > 0, weight, 1), 0.0)
    out = np.where(seen, own, escape * shared)
    return out / out.sum(1, keepdims=True)


def build_trie(two: np.ndarray, two_counts: np.ndarray, three: np.ndarray, three_counts: np.ndarray) -> Trie:
    """From counts of (2 bytes, symbol) codes and of the kept (3 bytes, symbol)."""
    context, symbol = two // SYMBOLS, two % SYMBOLS
    found = np.unique(context)
    zero = np.zeros(SYMBOLS)
    order0 = np.bincount(symbol, two_counts, SYMBOLS) if len(two) else zero
    uniform = np.ones((1, SYMBOLS))
    p0 = _escape(order0[None, :], uniform)
    order1 = np.zeros((256, SYMBOLS))
    np.add.at(order1, (context & 255, symbol), two_counts)
    p1 = _escape(order1, np.repeat(p0, 256, 0))
    # Row b < 256 stands for any unseen context that ends with byte b.
    pairs = np.arange(65536) & 255
    pairs[found] = 256 + np.arange(len(found))
    short = np.empty((256 + len(found), SYMBOLS))
    short[:256] = p1
    for part, counts in _rows(found, context, symbol, two_counts):
        short[pairs[part]] = _escape(counts, p1[part & 255])
    context3, symbol3 = three // SYMBOLS, three % SYMBOLS
    kept = np.unique(context3)
    # The first two bytes of a kept context have a row, as the third followed
    # them; else the text began there, after zero bytes, and it escapes.
    kept = kept[pairs[kept >> 8] >= 256]
    place = np.isin(context3, kept)
    long = np.zeros((max(1, len(kept)), SYMBOLS), np.float32)
    triples = np.full(len(short) * 256, -1, np.int32)
    for part, counts in _rows(kept, context3[place], symbol3[place], three_counts[place]):
        long[np.searchsorted(kept, part)] = np.log10(_escape(counts, short[pairs[part & 65535]]))
    triples[pairs[kept >> 8] * 256 + (kept & 255)] = np.arange(len(kept))
    return Trie(pairs, np.log10(short).astype(np.float32), triples, long)


def _rows(contexts: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, step: int = 2048):
    """Dense counts of sorted ``contexts``, ``step`` rows at a time."""
    for i in range(0, len(contexts), step):
        part = contexts[i : i + step]
        mine = (context >= part[0]) & (context <= part[-1])
        dense = np.zeros((len(part), SYMBOLS))
        dense[np.searchsorted(part, context[mine]), symbol[mine]] = n[mine]
        yield part, dense


def _tails(lower):
    """Distributions of contexts from their (code, n), sorted by code and whole in
    a partition; a context has at most SYMBOLS rows."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in stream:
            codes, n = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("code", "n"), strict=True))
            if len(codes):
                whole = np.searchsorted(codes, codes[-1] // SYMBOLS * SYMBOLS)
                held = (codes[whole:], n[whole:])
                yield from _distributions(codes[:whole], n[:whole], *lower.value)
        yield from _distributions(*held, *lower.value)

    return run


_TAIL = "context int, symbols binary, logs binary, unseen double"


def _distributions(codes: np.ndarray, counts: np.ndarray, pairs: np.ndarray, short: np.ndarray) -> Iterator[pa.RecordBatch]:
    context, symbol = codes // SYMBOLS, codes % SYMBOLS
    for part, dense in _rows(np.unique(context), context, symbol, counts):
        lower = 10.0 ** short[pairs[part & 65535]].astype(np.float64)
        out = np.log10(np.maximum(_escape(dense, lower), 1e-300))
        # What an escape adds is the same for all symbols that were not seen.
        gap = np.argmin(dense > 0, 1)
        unseen = (out - np.log10(lower))[np.arange(len(part)), gap]
        rows = [
            (int(c), np.flatnonzero(d).astype(np.uint16).tobytes(), o[d > 0].tobytes(), float(u))
            for c, d, o, u in zip(part, dense, out, unseen, strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.float64()), strict=True)],
            names=["context", "symbols", "logs", "unseen"],
        )


def train(counts: DataFrame, long_contexts: int = LONG_CONTEXTS) -> Trie:
    """Trie from the counts of all texts. The driver gets those of two-byte contexts
    (65,536 x 257 at most) and of the ``long_contexts`` most frequent three-byte
    contexts, the head; the others stay in the table."""
    context = F.floor(F.col("code") / SYMBOLS)
    two = counts.groupBy(((context % 65536) * SYMBOLS + F.col("code") % SYMBOLS).alias("code")).agg(
        F.sum("n").alias("n")
    )
    top = (
        counts.groupBy(context.alias("context"))
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "context")
        .limit(long_contexts)
        .select("context")
    )
    three = counts.join(F.broadcast(top), context == F.col("context")).select("code", "n")  # <= long_contexts rows
    pair, triple = two.toArrow(), three.toArrow()
    return build_trie(*[t.column(c).to_numpy() for t in (pair, triple) for c in ("code", "n")])


# ---- what packs ask for ---------------------------------------------------


@dataclass
class Common:
    """The most frequent words: sorted hashes and counts; rows that train, each of
    which has one end."""

    hashes: np.ndarray
    counts: np.ndarray
    ends: int


def common_words(words: DataFrame, ends: int, most: int) -> Common:
    top = words.orderBy(F.desc("n"), "hash").limit(most).toArrow()
    order = np.argsort(hashes := top.column("hash").to_numpy())
    return Common(hashes[order], top.column("n").to_numpy()[order], ends)


def _ask_words(common):
    """(uid, hash): a pack's distinct words that are not common."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in each_pack(stream):
            found = np.unique(pack.batch(lower=True).words.view(np.int64))
            yield entries(pack.uid, hash=found[~is_in(found, common.value.hashes)])

    return run


def _ask_contexts(trie):
    """(uid, context): a pack's distinct contexts that are not in the head."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 24, bool)
        for pack in each_pack(stream):
            for text in pack.texts():
                seen[gram_codes(text) // SYMBOLS] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield entries(pack.uid, context=found[~trie.value.in_long(found)].astype(np.int32))

    return run


def _pack_tails(pack: Pack) -> Tails | None:
    found = pack.found("tails")
    if not len(found):
        return None
    context = found.field("context").to_numpy().astype(np.int64)
    symbols, logs = (found.field(c).to_pylist() for c in ("symbols", "logs"))
    codes = np.repeat(context, [len(x) // 2 for x in symbols]) * SYMBOLS + np.frombuffer(b"".join(symbols), np.uint16)
    order, place = np.argsort(codes), np.argsort(context)
    return Tails(
        codes[order], np.frombuffer(b"".join(logs))[order], context[place], found.field("unseen").to_numpy()[place]
    )


def _score(trie, common):
    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = common.value.ends
        for pack in each_pack(stream):
            batch, tails = pack.batch(lower=True), _pack_tails(pack)
            n, row = len(batch.ids), batch.row_of_word()
            found = pack.found("words")
            order = np.argsort(rare := found.field("hash").to_numpy())
            words, count = batch.words.view(np.int64), np.zeros(len(batch.words))
            for known, times in ((common.value.hashes, common.value.counts), (rare[order], found.field("n").to_numpy()[order])):
                hit = is_in(words, known)
                count[hit] = times[np.searchsorted(known, words[hit])]
            yield pa.RecordBatch.from_arrays(
                [
                    pack.ids(),
                    pa.array(np.diff(batch.bounds) + 1, pa.int64()),
                    pa.array((np.bincount(row, count > 0, n) + (ends > 0)).astype(np.int64)),
                    pa.array(np.bincount(row, np.log10(count + ALPHA), n) + np.log10(ends + ALPHA)),
                    pa.array([trie.value.log10(t, tails) for t in batch.texts], pa.float64()),
                ],
                names=["doc_id", "n_tokens", "n_known", "raw", "score"],
            )

    return run


def score_documents(
    docs: DataFrame, long_contexts: int = LONG_CONTEXTS, most_common: int = COMMON_WORDS
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Rows whose crc32 of the id modulo FOLDS is not 0 train both models; every row
    is scored. A null or empty text has the end token only. Null and repeated
    ids and repeated rows each give a row. An empty table gives an empty result.
    Columns besides doc_id and text are ignored. ``long_contexts`` and
    ``most_common`` bound what every task holds, not what the scores rest on: the
    counts of all words and contexts are tables, and packs ask for what they have.
    """
    send = docs.sparkSession.sparkContext.broadcast
    kind = docs.schema["doc_id"].dataType
    packs = pack_texts(docs.select("doc_id", "text", fold(F.col("doc_id")) != 0), "ppm-packs")
    counts = counted(packs, _grams, "code", "ppm-counts")
    trie = train(counts, long_contexts)
    words = counted(packs, _words, "hash", "ppm-words")
    tokens, distinct = (x or 0 for x in words.agg(F.sum("n"), F.count("*")).first())
    ends = packs.agg(F.sum("n_flagged")).first()[0] or 0
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    shared, common = send(trie), send(common_words(words, ends, most_common))
    asked = packs.mapInArrow(_ask_words(common), "uid long, hash long")
    given = materialize(answers(asked.join(words, "hash"), "words", "hash", "n"), "ppm-given")
    rare = materialize(
        counts.select(F.floor(F.col("code") / SYMBOLS).cast("int").alias("context"), "code", "n")
        .repartition("context")
        .sortWithinPartitions("code")
        .select("code", "n")
        .mapInArrow(_tails(send((trie.pairs, trie.short))), _TAIL),
        "ppm-tails",
    )
    tails = answers(packs.mapInArrow(_ask_contexts(shared), "uid long, context int").join(rare, "context"), "tails", "context", "symbols", "logs", "unseen")
    scored = (
        packs.join(given, "uid", "left")
        .join(tails, "uid", "left")
        .mapInArrow(_score(shared, common), f"doc_id {kind.simpleString()}, n_tokens long, n_known long, raw double, score double")
    )
    bottom = tokens + ALPHA * (distinct + 1)
    return scored.select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("raw") - F.col("n_tokens") * F.lit(float(np.log10(bottom)))).alias("base_score"),
        "score",
    )
