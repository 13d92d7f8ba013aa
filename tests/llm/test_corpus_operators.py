"""Operators over a whole corpus, against plain Python."""

import gzip
import itertools
import json
import math
import random
import zlib
from collections import Counter
from functools import partial
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from eqtlake.llm import classifier, common, fingerprint, mixing, near_dup, packs, ppm, substring_dedup, warc
from eqtlake.plans.workspace import scratch_path

from . import brute
from .conftest import TEXTS, crc

ALPHABET = [f"v{i}" for i in range(40)]


def family(seed: int, n: int, length: int, edits: int) -> list[str]:
    """Copies of a text with up to ``edits`` words changed."""
    rng = random.Random(seed)
    base = [rng.choice(ALPHABET) + str(rng.randrange(50)) for _ in range(length)]
    out = []
    for _ in range(n):
        words = base.copy()
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


# ---- substring dedup


def check_repeats(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(df).collect())
    want = sorted(((i is None, i or 0), *x) for (i, _), x in zip(rows, brute.repeats(rows), strict=True))
    assert got == want


def test_repeats(docs, odd_docs, no_docs):
    for df in (docs, odd_docs, no_docs):
        check_repeats(df)


def test_repeats_at_random(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words = [rng.choice(ALPHABET[:3]) for _ in range(rng.randrange(60))]
        if i % 3:
            words += family(i % 7, 1, 40, 2)[0].split()
        rows.append((rng.randrange(200), " ".join(words)))
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_results_when_scans_are_cut_anew(spark, monkeypatch):
    """Each stored table is followed by another split size and partition count, and
    the input comes from a shuffle: packs keep their numbers."""
    texts = family(1, 40, 60, 2) + [" ".join(f"u{i}_{j}" for j in range(50)) for i in range(100) for _ in range(2)]
    random.Random(7).shuffle(texts)
    folder = scratch_path(spark, "split-input")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12).write.parquet(folder)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k) for k in keys}
    turns = iter(range(10**6))

    def disturbed(df, name):
        out = common.materialize(df, name)
        n = next(turns)
        spark.conf.set(keys[0], str((3000, 40_000, 10**8)[n % 3]))
        spark.conf.set(keys[1], str((3, 7, 2)[n % 3]))
        return out

    for module in (substring_dedup, ppm, packs):
        monkeypatch.setattr(module, "materialize", disturbed)
    monkeypatch.setattr(packs, "batches", partial(fingerprint.batches, size=2000))
    try:
        for df in (spark.read.parquet(folder), spark.read.parquet(folder).repartition(5)):
            got = sorted((r.doc_id, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(df).collect())
            assert got == [(i, *x[1:]) for i, x in enumerate(brute.repeats(list(enumerate(texts))))]
            train = [t for i, t in enumerate(texts) if crc(i) % 10]
            want = brute.unigram_all(train, texts)
            scored = sorted(ppm.score_documents(df).collect(), key=lambda r: r.doc_id)
            assert [(r.n_tokens, r.n_known, r.train_tokens) for r in scored] == [x[:3] for x in want]
            assert [r.base_score for r in scored] == pytest.approx([x[3] for x in want], rel=1e-9)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_repeats_are_maximal(docs):
    for r in substring_dedup.remove_repeats(docs).collect():
        spans = [(x.first, x.first + x.n) for x in r.repeats]
        assert brute.merged(spans) == spans and sum(b - a for a, b in spans) == r.n_removed


def test_word_hashes():
    texts = [b"a b", b"", b" b  a\n", b"x" * 100, "é è".encode()]
    words, bounds = fingerprint.hash_rows(texts)
    assert np.diff(bounds).tolist() == [2, 0, 2, 1, 2]
    assert words[0] == words[3] and words[1] == words[2] and len(set(words.tolist())) == 5
    big = [(b"%d " % i) * 40000 for i in range(5)]
    words, bounds = fingerprint.hash_rows(big)
    assert np.diff(bounds).tolist() == [40000] * 5 and len(set(words.tolist())) == 5


# ---- near duplicates


def check_components(df, width, percent):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = near_dup.near_duplicates(df, width, percent).collect()
    want = brute.components([x for x in rows if x[0] is not None], width, percent)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)
    sizes = sorted((str(i), len(brute.shingles(t, width))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sizes


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, odd_docs, no_docs, width, percent):
    for df in (docs, odd_docs, no_docs):
        check_components(df, width, percent)


def test_near_duplicate_families(spark):
    texts = []
    for seed, (length, edits) in enumerate([(8, 1), (40, 4), (150, 20), (400, 30), (150, 60)]):
        texts += family(seed, 60, length, edits)
    random.Random(5).shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    check_components(df, 3, 85)


def test_blocks_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    texts = family(9, 150, 150, 40)
    check_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85)


def test_signature_recall():
    """Pairs at the threshold share a band."""
    rng = np.random.default_rng(2)
    missed = 0
    for n in (7, 20, 100, 500):
        for _ in range(200):
            both = int(n * 0.86)
            s = np.unique(rng.integers(0, 2**63, n + n - both, dtype=np.uint64))
            a, b = s[:both].tolist() + s[both:n].tolist(), s[:both].tolist()
            x, y = (near_dup.band_keys(near_dup.signature(np.unique(np.array(v, np.uint64)))) for v in (a, b))
            missed += not (x == y).any()
    assert missed == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_no_pair_at_the_threshold_is_ruled_out(percent):
    """Pairs just at the threshold keep as many equal slots as the filter asks for."""
    rng = np.random.default_rng(3)
    least = []
    for n in (8, 20, 40, 100, 300, 1000):
        both = -(-percent * n // 100)
        for _ in range(250):
            s = rng.integers(0, 2**63, n, dtype=np.uint64)
            own = (n - both) // 2
            a, b = np.unique(s[: both + own]), np.unique(np.concatenate([s[:both], s[both + own :]]))
            x, y = ((near_dup.signature(v) & near_dup.U64(255)).astype(np.uint8) for v in (a, b))
            least.append((x == y).sum() - near_dup.least_agreement(percent, np.array(min(len(a), len(b)))))
    assert min(least) >= 0


def test_intersections(monkeypatch):
    monkeypatch.setattr(near_dup, "_WIDE", 7)
    monkeypatch.setattr(near_dup, "_PAIRS", 50)
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**64, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[: rng.integers(5, 400)], rng.integers(1, 60))) for _ in range(40)]
    sets += [np.empty(0, np.uint64), pool[:1]]
    got = near_dup.intersections(sets, sets[::-1])
    want = [[len(np.intersect1d(a, b)) for b in sets[::-1]] for a in sets]
    assert got.tolist() == want


def test_components_of_a_chain(spark):
    nodes = spark.range(64).toDF("doc_id")
    links = spark.range(1, 50).select(F.col("id").alias("b"), (F.col("id") - 1).alias("a")).select("a", "b")
    got = {r.doc_id: r.component_id for r in near_dup.components(nodes, links).collect()}
    assert got == {i: 0 if i < 50 else i for i in range(64)}


# ---- mixing


def check_mix(rows, df):
    got = mixing.mix_sources(df, size=F.col("size")).collect()
    want = brute.mixing(rows)
    taken = {}
    for r in got:
        size, target = want[r.source]
        assert r.source_size == size and r.target == pytest.approx(target)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert taken == {s: round(t) for s, (_, t) in want.items()}


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "B", "é", None, "z", "y"]), rng.choice([0, 1, 7, 50])) for _ in range(300)]
    rows += [("tiny", 2), ("zero", 0), ("huge", 40000)]
    df = spark.createDataFrame([(i // 2, s, n, None) for i, (s, n) in enumerate(rows)], "doc_id long, source string, size long, text string")
    check_mix(rows, df.repartition(7))
    one = mixing.mix_sources(df.repartition(3), size=F.col("size")).orderBy("doc_id", "source", "size", "taken").collect()
    two = mixing.mix_sources(df.repartition(5, "size"), size=F.col("size")).orderBy("doc_id", "source", "size", "taken").collect()
    assert one == two


def test_mixing_of_odd_tables(odd_docs, no_docs):
    got = mixing.mix_sources(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert sum(r.taken for r in got) == sum(r.size for r in got)
    assert mixing.mix_sources(no_docs).collect() == []


# ---- language model


def test_lm_scores(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        train = [t for i, t in rows if crc(i) % 10]
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.held_out), r) for r in ppm.score_documents(df).collect())
        want = sorted(((i is None, i or 0, *(u := brute.unigram(train, t))[:2], crc(i) % 10 == 0), u, t or "") for i, t in rows)
        trained = [(t or "").encode() for t in train]
        assert len(got) == len(want)
        for (key, r), (other, u, text) in zip(got, want, strict=True):
            assert key == other and r.train_tokens == u[2]
            assert r.base_score == pytest.approx(u[3], rel=1e-9)
            if len(text) < 300:
                assert r.score == pytest.approx(brute.ppm(trained, text.encode()), rel=1e-4), text
    assert ppm.score_documents(no_docs).collect() == []


def test_lm_scores_beyond_the_head(spark):
    """More three-byte contexts than tasks hold, against all of them."""
    rng = random.Random(8)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FA6)) for _ in range(2000)) for _ in range(30)]
    texts += [t[i : i + 30] for t in texts[:4] for i in (0, 700)]
    rows = list(enumerate(texts))
    train = [t.encode() for i, t in rows if crc(i) % 10]
    contexts = {(b"\0\0\0" + t)[i : i + 3] for t in train for i in range(len(t) + 1)}
    assert len(contexts) > ppm.LONG_CONTEXTS + 5000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {i: brute.ppm(train, t.encode()) for i, t in rows[30:]}
    base = brute.unigram_all([t for i, t in rows if crc(i) % 10], texts)
    for held in (ppm.LONG_CONTEXTS, 7):
        rows = ppm.score_documents(docs, held, 7).where("doc_id >= 30").collect()
        assert {r.doc_id: r.score for r in rows} == pytest.approx(want, rel=1e-5)
        assert {r.doc_id: r.base_score for r in rows} == pytest.approx({i: base[i][3] for i in want}, rel=1e-9)


def test_lm_distribution_sums_to_one():
    codes = np.concatenate([ppm.gram_codes(t) for t in (b"abracadabra", b"alakazam", b"")])
    three, n3 = np.unique(codes, return_counts=True)
    two, n2 = np.unique((codes // 257 % 65536) * 257 + codes % 257, return_counts=True)
    trie = ppm.build_trie(two, n2, three, n3)
    assert np.allclose((10.0**trie.short).sum(1), 1, atol=1e-4)
    assert np.allclose((10.0**trie.long).sum(1), 1, atol=1e-4)
    assert trie.log10(b"abra") > trie.log10(b"zzzz")
    assert trie.log10(b"abra" * 100000) == pytest.approx(
        trie.log10(b"abra" * 50000) * 2, rel=1e-3
    )


# ---- classifier


def test_classifier(spark, docs, odd_docs, no_docs):
    rng = random.Random(6)
    good = [" ".join(rng.choice(ALPHABET) + "ing" for _ in range(60)) for _ in range(200)]
    bad = [" ".join(rng.choice(ALPHABET).upper() + "$$$" for _ in range(60)) for _ in range(60)]
    rows = list(enumerate(good + bad))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in rows] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = classifier.classify(df, labels).collect()
    held = [r for r in got if crc(r.doc_id) % 5 == 0]
    assert held and all(r.predicted == (r.doc_id < 200) for r in held)
    assert all(0 <= r.score <= 1 for r in got)
    again = classifier.classify(df.repartition(3), labels).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    model = classifier.fit(good + bad, [1] * 200 + [0] * 60)
    for odd in (docs, odd_docs, no_docs):
        scored = classifier.score_documents(odd.withColumn("score", F.lit("x")), model)
        assert scored.count() == odd.count() and scored.where("score is null").count() == 0


def rows_by_hand(vocabulary):
    """Which row of the vectors a word has, looked up one by one."""
    shapes = {int(h): 1 + i for i, h in enumerate(vocabulary.shapes)}
    words = {int(h): 1 + len(shapes) + i for i, h in enumerate(vocabulary.words)}

    def row(word):
        kinds = [chr(b) if b < 128 and not chr(b).isalnum() else "0" if 48 <= b <= 57 else "A" if 65 <= b <= 90 else "a" for b in word]
        short = "".join(k for k, _ in itertools.groupby(kinds)).encode()
        h, s = (int(fingerprint.word_hashes(x)[0]) for x in (word, short))
        return words.get(h, shapes.get(s, 0))

    return row


def test_word_vectors_over_all_documents(spark, docs, odd_docs, no_docs):
    """Sums of neighbours' index vectors, word by word; alike however rows are dealt,
    and with vocabularies smaller than the words there are."""
    for rows, words, shapes in ((docs, 12, 4), (docs, 10_000, 2), (odd_docs, 3, 1), (no_docs, 5, 5)):
        vocabulary = classifier.learn_vocabulary(rows, words, shapes)
        texts = [(r.text or "").encode().split() for r in rows.select("text").collect()]
        n = Counter(w for t in texts for w in t)
        assert len(vocabulary.words) == min(words, len(n)) and len(vocabulary.shapes) <= shapes
        assert sorted(vocabulary.n_words.tolist()) == sorted(n.values())[len(n) - len(vocabulary.words) :]
        row_of, index = rows_by_hand(vocabulary), vocabulary.index().tolist()
        want = [[0] * classifier.DIMENSIONS for _ in index]
        for t in texts:
            at = [row_of(w) for w in t]
            for i, a in enumerate(at):
                for b in at[max(0, i - 2) : i] + at[i + 1 : i + 3]:
                    want[a] = [x + y for x, y in zip(want[a], index[b], strict=True)]
        want = vocabulary.vectors(np.array(want))
        assert (classifier.learn_vectors(rows, vocabulary) == want).all()
        assert (classifier.learn_vectors(rows.repartition(5, "text"), vocabulary) == want).all()
    assert (classifier.index_vectors(np.arange(50, dtype=np.uint64)) != 0).sum() == 50 * classifier.NONZERO


def test_vectors_of_texts(spark, docs):
    texts = [r.text or "" for r in docs.select("text").collect()]
    alone, found = classifier.vectors_of(texts)
    vocabulary = classifier.learn_vocabulary(docs)
    for name in ("words", "n_words", "shape_of", "shapes", "n_shapes"):
        assert (getattr(alone, name) == getattr(vocabulary, name)).all()
    assert (classifier.learn_vectors(docs, vocabulary) == found).all()


def test_classifier_score_by_hand(spark):
    """The fitted weights applied word by word and node by node in plain Python."""
    good = [f"calm river number {i} flows past the old mill and the green field {i % 7}" for i in range(60)]
    bad = [f"BUY $$$ {i} !!! now now now {i} CLICK $$$" for i in range(60)]
    model = classifier.fit(good + bad, [1] * 60 + [0] * 60)
    w1, b1, w2, b2 = (x.tolist() for x in model.layers)
    row_of = rows_by_hand(model.vocabulary)

    def by_hand(text):
        words, x = text.encode().split(), [0.0] * (classifier.DIMENSIONS + classifier.FORM)
        if words:
            for w in words:
                at = row_of(w)
                for d in range(classifier.DIMENSIONS):
                    x[d] += float(model.vectors[at][d]) / len(words)
            lines = [y for y in text.encode().split(b"\n") if y.strip()]
            same = sum(a == b for a, b in itertools.pairwise(words))
            kinds = len(set(words)) / len(words)
            x[classifier.DIMENSIONS :] = [math.log1p(len(words)), kinds, len(set(lines)) / len(lines), len(text.encode()) / len(words), same / len(words)]
        z = [(v - m) / s for v, m, s in zip(x, model.mean.tolist(), model.scale.tolist(), strict=True)]
        hidden = [max(0.0, b + sum(v * row[j] for v, row in zip(z, w1, strict=True))) for j, b in enumerate(b1)]
        logit = b2[0] + sum(h * w for h, w in zip(hidden, w2, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit / model.temperature))))

    texts = [good[3], bad[4], "", "one\none\n\ntwo $$$", "never seen words here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in classifier.score_documents(docs, model).collect():
        assert r.score == pytest.approx(by_hand(texts[r.doc_id]), abs=1e-6)
        assert r.predicted == (r.score >= 0.3)


def test_classifier_without_labels(docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality")).where("false")
    assert {r.score for r in classifier.classify(docs, labels).collect()} == {0.5}


# ---- WARC


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes string")


def test_warc_round_trip(spark):
    big, other = "<p>é" * 400, "x" * 999
    rows = [(1, "http://a/\r\nX: y", big, "c"), (5, "u", big, "c"), (3, None, big, "c"), (2, "u", other, "c"), (4, "u", other, "c")]
    rows += [(6, "u", None, "c"), (7, "u", "", None), (None, "u", big, "c"), (5, "u", big, "c"), (8, "u", "y" * 10**6, "c")]
    got = warc.round_trip(pages_of(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for p, _, h, _ in rows if p == r.page_id) or ""
        is_revisit = html == big and r.page_id in (1, 3)
        assert (r.record_type, r.refers_to) == (("revisit", 5) if is_revisit else ("response", None))
        assert r.payload_bytes == len(html.encode())
        assert bytes(r.payload) == (b"" if is_revisit else html.encode())
    assert warc.round_trip(pages_of(spark, [])).collect() == []


def test_normaliser(spark):
    pages = pages_of(spark, [(i, f"http://h/{i}", f"<html>{i}</html>" * (i + 1), "") for i in range(50)]).coalesce(1)
    folder = scratch_path(spark, "warc-test")
    made = warc.write_archives(pages, folder).collect()
    assert [r.n for r in made] == [50]
    root = Path(folder)
    mono, part = root / "mono-000000-000000.warc.gz", root / made[0].archive
    assert gzip.decompress(mono.read_bytes()) == gzip.decompress(part.read_bytes())
    data = part.read_bytes()
    lines = [json.loads(x) for x in (root / f"{made[0].archive}.idx").read_text().splitlines()]
    assert sum(x["length"] for x in lines) == len(data)
    for x in lines:
        record = zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31)
        assert warc.parse_record(record)[0]["WARC-Record-ID"] == x["id"]
    assert not list(root.glob("*.tmp"))


def test_archives_are_bounded(spark):
    pages = pages_of(spark, [(i, f"http://h/{i}", "x" * 300, "") for i in range(20)]).coalesce(1)
    folder = scratch_path(spark, "warc-bound")
    made = warc.write_archives(pages, folder, limit=2000)
    sizes = [r.n for r in made.collect()]
    assert sum(sizes) == 20 and len(sizes) > 4 and max(sizes) <= 4
    back = warc.read_archives(spark, made, folder).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in back) == [(i, 300) for i in range(20)]


def test_small_payloads_have_keys_of_their_own(spark):
    pages = pages_of(spark, [(i, "u", "small", "") for i in range(400)])
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = warc.plan_records(pages.repartition(4)).hint("merge")
        assert plan.where("record_type = 'response' and refers_to is null").count() == 400
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_record_parser():
    one = warc.page_record(1, "u", b"\r\n\r\nWARC/1.1\r\n\r\n", "response", None)
    two = warc.page_record(2, "u", b"", "revisit", 1)
    stream = one + two
    for step in (1, 7, len(stream)):
        assert list(warc.records(stream[i : i + step] for i in range(0, len(stream), step))) == [one, two]
    with pytest.raises(ValueError):
        list(warc.records([stream[:-5]]))


def test_texts_cover_the_odd_cases():
    assert None in TEXTS and "" in TEXTS and len(TEXTS) > len(set(TEXTS)) and max(len(t or "") for t in TEXTS) > 100_000
