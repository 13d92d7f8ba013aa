"""Quality classifier: random-indexing word vectors pooled per document, then a
two-layer network with temperature-calibrated probabilities, all in numpy.

Words are counted, and their vectors summed, over all documents, in tasks; sums are
of integers, so they do not depend on how the rows are dealt. The network is fitted
on the driver from a bounded sample of labelled rows; every document is then scored
in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .fingerprint import batches, hash_rows, mix, slices
from .packs import is_in

#: Labelled rows that the network is fitted on, at most; taken by the hash of the id.
SAMPLE_ROWS = 4000
#: The commonest words and shapes of all documents have vectors of their own; a word
#: beyond them has its shape's, a shape beyond them that of all rare shapes.
VOCABULARY = 32_768
SHAPES = 3_000
DIMENSIONS = 96
NONZERO = 6
HIDDEN = 32
WINDOW = 2
#: Weight of a word's shape in its vector, about that of five occurrences.
SHAPE_WEIGHT = 25.0
THRESHOLD = 0.3
FOLDS = 5
FORM = 5
#: Distinct words whose counts a task gathers before it sends them on.
HELD_WORDS = 1 << 20
#: Rows of the vectors that are summed together, and words whose contexts are.
BLOCK = 512
STRETCH = 8_000

_CLASSES = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)
_CODEC = "zstd"
#: Of a signed column to the hash.
_MASK = (1 << 64) - 1


def shape(text: bytes) -> bytes:
    """Classes of letters and digits with runs shortened, of a word or a whole text."""
    classes = np.frombuffer(text.translate(_CLASSES), np.uint8)
    return classes[np.append(True, classes[1:] != classes[:-1])].tobytes() if len(classes) else b""


def index_vectors(keys: np.ndarray) -> np.ndarray:
    """The index vector of each key: NONZERO entries of 1 or -1 at random places."""
    draws = mix(keys[:, None] ^ mix(np.arange(1, DIMENSIONS + 1, dtype=np.uint64)))
    places = np.argpartition(draws, NONZERO, axis=1)[:, :NONZERO]
    signs = (np.take_along_axis(draws, places, 1) & np.uint64(1)).astype(np.int16) * 2 - 1
    out = np.zeros((len(keys), DIMENSIONS), np.int16)
    np.put_along_axis(out, places, signs, 1)
    return out


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and of their shapes, and where each text begins."""
    words, bounds = hash_rows(texts)
    return words, hash_rows([shape(t) for t in texts])[0], bounds


@dataclass
class Vocabulary:
    """Hashes of the known shapes and words, sorted, how often each occurs, and the
    shapes of the words. Row 0 is of rare shapes; rows of shapes and of words follow."""

    shapes: np.ndarray
    n_shapes: np.ndarray
    words: np.ndarray
    n_words: np.ndarray
    shape_of: np.ndarray

    @classmethod
    def of(cls, words: list[tuple[int, int, int]], shapes: list[tuple[int, int]]) -> Vocabulary:
        """From (word, shape, n) and (shape, n)."""
        w = np.array(words, np.uint64).reshape(-1, 3)
        s = np.array(shapes, np.uint64).reshape(-1, 2)
        w, s = w[np.argsort(w[:, 0])], s[np.argsort(s[:, 0])]
        return cls(s[:, 0], s[:, 1].astype(np.int64), w[:, 0], w[:, 2].astype(np.int64), w[:, 1])

    def __len__(self) -> int:
        return 1 + len(self.shapes) + len(self.words)

    def shape_rows(self, shapes: np.ndarray) -> np.ndarray:
        return np.where(is_in(shapes, self.shapes), 1 + np.searchsorted(self.shapes, shapes), 0)

    def rows(self, words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        known = is_in(words, self.words)
        out = 1 + len(self.shapes) + np.searchsorted(self.words, words)
        out[~known] = self.shape_rows(shapes[~known])
        return out

    def index(self) -> np.ndarray:
        """Index vectors of all rows, then rows of zeros to whole blocks, one at least."""
        of_shapes = np.append(np.zeros(1, np.uint64), mix(self.shapes ^ np.uint64(0x5348415045)))
        found = index_vectors(np.concatenate([of_shapes, self.words]))
        return np.vstack([found, np.zeros((BLOCK - len(found) % BLOCK, DIMENSIONS), np.int16)])

    def vectors(self, contexts: np.ndarray) -> np.ndarray:
        """Unit vectors from the sums of the neighbours' index vectors: a row's own
        counts half an occurrence, and a word leans on its shape as far as it is rare."""
        n = np.concatenate([[1], self.n_shapes, self.n_words])
        out = contexts[: len(self)] + 0.5 * n[:, None] * self.index()[: len(self)]
        first = 1 + len(self.shapes)
        out[:first] = _unit(out[:first])
        out[first:] = _unit(out[first:] + SHAPE_WEIGHT * out[self.shape_rows(self.shape_of)])
        return out.astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def add_contexts(total: np.ndarray, index: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> None:
    """Add to each row of ``total`` the index vectors within WINDOW words around its
    occurrences; ``rows`` are the words of texts that begin at ``bounds``."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # Between texts are words without an index vector, the last row.
    line = np.full(len(rows) + WINDOW * len(bounds), len(total) - 1, np.int64)
    line[np.arange(len(rows)) + WINDOW * text] = rows
    for low in range(0, len(line), STRETCH):
        first, part = max(0, low - WINDOW), line[low : low + STRETCH]
        near = index[line[first : low + STRETCH + WINDOW]]
        around = np.zeros_like(near)
        for step in range(1, WINDOW + 1):
            around[step:] += near[:-step]
            around[:-step] += near[step:]
        around = around[low - first : low - first + len(part)]
        order = np.argsort(part, kind="stable")
        at, starts = np.unique(part[order], return_index=True)
        total[at] += np.add.reduceat(around[order], starts, axis=0, dtype=np.int16)  # at most 4 x STRETCH


# ---- over all documents -----------------------------------------------------


def _tally(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, shapes, n = map(np.concatenate, zip(*parts, strict=True))
    known, first, at = np.unique(words, return_index=True, return_inverse=True)
    return known, shapes[first], np.bincount(at, n, len(known)).astype(np.int64)


def _count_words(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, shape, n), summed over the task as far as memory allows."""
    parts: list[tuple[np.ndarray, ...]] = []

    def sent() -> Iterator[pa.RecordBatch]:
        word, of, n = parts.pop()
        for i in range(0, len(word), 200_000):
            held = (word[i : i + 200_000].view(np.int64), of[i : i + 200_000].view(np.int64), n[i : i + 200_000])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["word", "shape", "n"])

    for batch in batches(stream):
        shapes = hash_rows([shape(t) for t in batch.texts])[0]
        parts.append(_tally([(batch.words, shapes, np.ones(len(shapes), np.int64))]))
        if sum(len(x[0]) for x in parts) >= HELD_WORDS:
            parts[:] = [_tally(parts)]
            if len(parts[0][0]) >= HELD_WORDS // 2:
                yield from sent()
    if parts:
        parts[:] = [_tally(parts)]
        yield from sent()


def _commonest(counts: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows of the largest n, ties by key. Only rows of the powers of two
    that reach so far are ordered, about twice as many as are wanted."""
    power = F.floor(F.log2("n"))
    sizes = sorted(counts.groupBy(power.alias("p")).count().collect(), reverse=True)  # at most 64
    reached, low = 0, 0
    for p, rows in sizes:
        reached, low = reached + rows, p
        if reached >= most:
            break
    return counts.where(power >= low).orderBy(F.desc("n"), key).limit(most)


def learn_vocabulary(docs: DataFrame, words: int = VOCABULARY, shapes: int = SHAPES) -> Vocabulary:
    """The commonest words and shapes of all texts; null texts have none."""
    parts = docs.select(F.lit(0).alias("id"), F.col("text")).mapInArrow(_count_words, "word long, shape long, n long")
    counts = materialize(
        parts.groupBy("word").agg(F.min("shape").alias("shape"), F.sum("n").alias("n")), "classifier-words"
    )
    top = _commonest(counts, "word", words).collect()  # at most ``words``
    kinds = materialize(counts.groupBy("shape").agg(F.sum("n").alias("n")), "classifier-shapes")
    found = Vocabulary.of(
        [(r["word"] & _MASK, r["shape"] & _MASK, r["n"]) for r in top],
        [(r["shape"] & _MASK, r["n"]) for r in _commonest(kinds, "shape", shapes).collect()],
    )
    release(counts)
    release(kinds)
    return found


def learn_vectors(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Vectors of the vocabulary from the contexts in all texts.

    A task sends its sums in blocks of rows, which are added in two rounds, one
    block at a time, so no task holds more than one copy of the sums."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, vocabulary.index()))

    def contexts(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = shared.value
        total = np.zeros(index.shape, np.int64)
        for batch in batches(stream):
            shapes = hash_rows([shape(t) for t in batch.texts])[0]
            add_contexts(total, index, known.rows(batch.words, shapes), batch.bounds)
        blocks = ((i, total[i : i + BLOCK]) for i in range(0, len(total), BLOCK))
        yield from _sent((i, x) for i, x in blocks if x.any())

    parts = docs.select(F.lit(0).alias("id"), F.col("text")).mapInArrow(contexts, _SUMS)
    parts = parts.repartition(64, "block", "salt").mapInArrow(_added, _SUMS)
    out = np.zeros(shared.value[1].shape, np.int64)
    for row in parts.repartition(16, "block").mapInArrow(_added, _SUMS).collect():  # the sums once
        out[row["block"] : row["block"] + BLOCK] = _sums(row["data"])
    return vocabulary.vectors(out)


_SUMS = "block long, salt long, data binary"


def _sent(blocks: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    salt = TaskContext.get().partitionId() % 32
    for i, sums in blocks:
        data = pa.Codec(_CODEC).compress(sums.tobytes(), asbytes=True)
        yield pa.RecordBatch.from_pydict({"block": [i], "salt": [salt], "data": [data]})


def _sums(data: bytes) -> np.ndarray:
    found = pa.Codec(_CODEC).decompress(data, BLOCK * DIMENSIONS * 8, asbytes=True)
    return np.frombuffer(found, np.int64).reshape(BLOCK, DIMENSIONS)


def _added(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in slices(stream):
        for i, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist(), strict=True):
            held[i] = held[i] + _sums(data) if i in held else _sums(data)
    yield from _sent(held.items())


# ---- the model ---------------------------------------------------------------


@dataclass
class QualityModel:
    """Vocabulary and vectors, the network's weights and the temperature."""

    vocabulary: Vocabulary | None = None
    vectors: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0
    prior: float = 0.5

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """The mean of each text's word vectors and FORM figures of its form."""
        data = [(t or "").encode() for t in texts]
        words, shapes, bounds = hashed(data)
        rows = self.vocabulary.rows(words, shapes)
        out = np.zeros((len(texts), DIMENSIONS + FORM))
        for i, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if low == high:
                continue
            n, own = high - low, words[low:high]
            at, times = np.unique(rows[low:high], return_counts=True)
            lines = [x for x in data[i].split(b"\n") if x.strip()]
            out[i, :DIMENSIONS] = times @ self.vectors[at] / n
            out[i, DIMENSIONS:] = (
                np.log1p(n),
                len(np.unique(own)) / n,
                len(set(lines)) / max(1, len(lines)),
                len(data[i]) / n,
                np.count_nonzero(own[1:] == own[:-1]) / n,
            )
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2[0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), self.prior)
        # Products depend in their last digits on how rows are batched.
        return np.round(self.probability(self.pooled(texts)), 9)


def vectors_of(texts: list[str]) -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary and vectors from the given texts alone."""
    words, shapes, bounds = hashed([t.encode() for t in texts])
    word, of, n = _tally([(words, shapes, np.ones(len(words), np.int64))])
    kind, n_kind = np.unique(shapes, return_counts=True)
    # Ties in the order of signed columns.
    top = np.lexsort((word.view(np.int64), -n))[:VOCABULARY]
    kinds = np.lexsort((kind.view(np.int64), -n_kind))[:SHAPES]
    vocabulary = Vocabulary.of(
        list(zip(word[top].tolist(), of[top].tolist(), n[top].tolist(), strict=True)),
        list(zip(kind[kinds].tolist(), n_kind[kinds].tolist(), strict=True)),
    )
    index = vocabulary.index()
    total = np.zeros(index.shape, np.int64)
    add_contexts(total, index, vocabulary.rows(words, shapes), bounds)
    return vocabulary, vocabulary.vectors(total)


def fit(
    texts: list[str | None],
    labels: list[int],
    learned: tuple[Vocabulary, np.ndarray] | None = None,
    seed: int = 11,
    rounds: int = 400,
) -> QualityModel:
    """Fit on labelled texts, with vectors that were learned elsewhere or else from
    these texts. One class or under 20 rows give a constant score."""
    y = np.array(labels, np.float64)
    model = QualityModel(prior=float((y.sum() + 1) / (len(y) + 2)))
    if not _enough(labels):
        return model
    model.vocabulary, model.vectors = learned or vectors_of([t or "" for t in texts])
    x = model.pooled(texts)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, rest = order[: len(y) // 5], order[len(y) // 5 :]
    model.mean, model.scale = x[rest].mean(0), x[rest].std(0) + 1e-6
    z = (x - model.mean) / model.scale
    d = z.shape[1]
    layers = [
        rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN),
        np.array([np.log(model.prior / (1 - model.prior))]),
    ]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    best, best_layers, waited = np.inf, [w.copy() for w in layers], 0
    step = 0
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(rest), max(1, len(rest) // 256)):
            step += 1
            h = np.maximum(z[part] @ layers[0] + layers[1], 0)
            p = 1 / (1 + np.exp(-np.clip(h @ layers[2] + layers[3][0], -30, 30)))
            g = (p - y[part]) / len(part)
            back = np.outer(g, layers[2]) * (h > 0)
            grads = [z[part].T @ back + 1e-4 * layers[0], back.sum(0), h.T @ g + 1e-4 * layers[2], np.array([g.sum()])]
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                layers[i] = layers[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (
                    np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8
                )
        model.layers = tuple(layers)
        loss = _loss(model.logits(x[held]), y[held])
        if loss < best - 1e-5:
            best, best_layers, waited = loss, [w.copy() for w in layers], 0
        elif (waited := waited + 1) >= 40:
            break
    model.layers = tuple(best_layers)
    logits = model.logits(x[held])
    model.temperature = float(min(np.geomspace(0.5, 8, 57), key=lambda t: _loss(logits / t, y[held])))
    return model


def _enough(labels: list[int]) -> bool:
    return len(labels) >= 20 and len(set(labels)) > 1


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    z = np.clip(logits, -30, 30)
    return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))


def fold(row_id: Column) -> Column:
    """crc32 of the id as text modulo FOLDS; a null id counts as empty text."""
    return F.crc32(F.coalesce(row_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list, list]:
    """Texts and labels of at most ``rows`` labelled documents outside fold 0."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` rows
    found = sorted(((r["doc_id"], r["text"] or "", int(r["quality"])) for r in got.toLocalIterator()))
    return [x[1] for x in found], [x[2] for x in found]


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold) added.

    Only the text is read for the score. Null and empty texts are scored as a
    document without words. Rows are independent, so order, repeats, ties, null
    ids and empty tables do not matter. Columns of ``docs`` that are named score
    or predicted are replaced.
    """
    from pyspark.sql import types as T

    names = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType(
        [docs.schema[c] for c in names]
        + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream):
            score = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    return docs.select(*names).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Vectors from every text of ``docs``, the network from at most ``rows`` labelled ones.

    Labels with a null id or quality are left out, the larger of a row's labels
    counts, and rows that repeat an id count each. Too few labels, or labels of one
    class, give a constant score; no document then needs to be read for vectors.
    """
    texts, marks = training_rows(docs, labels, rows)
    if not _enough(marks):
        return fit(texts, marks)
    vocabulary = learn_vocabulary(docs)
    return fit(texts, marks, (vocabulary, learn_vectors(docs, vocabulary)))


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train on ``docs`` and ``labels`` (doc_id, quality) and score every row of ``docs``.

    The odd cases are as ``train`` and ``score_documents`` say.
    """
    return score_documents(docs, train(docs, labels, rows))
