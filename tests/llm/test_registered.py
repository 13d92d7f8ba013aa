"""The registered queries against their SQL, and the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from eqtlake.llm import classifier, mixing, op_queries
from eqtlake.plans import explain
from tests import support

from . import brute
from .conftest import ITEMS, TEXTS, crc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(op_queries.oracle_sql()))
def test_query_against_sql(spark, name):
    support.same_rows(op_queries.queries()[name](spark, SF), support.views(SF), op_queries.oracle_sql()[name])


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names


def test_queries_without_sql(spark):
    """On the smallest tables: brute force for what SQL does not give."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    component = brute.components(docs, 3, 85)
    got = op_queries.op8_near_dup(spark, SF).collect()
    assert {r.doc_id: r.component_id for r in got} == component
    train = [t for i, t in docs if crc(i) % 10]
    for r in op_queries.op10_lm_scoring(spark, SF).where("doc_id % 20 = 0").collect():
        n, known, total, score = brute.unigram(train, dict(docs)[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = op_queries.op7_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in scored)
    assert right >= 0.93 * len(scored)
    assert all(r.predicted == 1 for r in scored if r.quality == 1)


def test_stages_on_their_input(spark, docs, benchmark_items, tmp_path):
    rows = docs.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(0).cast("long").alias("n_chars"))
    benchmark_items.write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = [3 * i for i in range(len(TEXTS))]
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["minhash_near_dedup"](spark, rows, str(tmp_path))
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    component = brute.components(list(zip(ids, TEXTS, strict=True)), 5, 80)
    assert {r.doc_id for r in kept.collect()} == set(component.values())

    clean = {r.doc_id: r for r in stage["benchmark_decontamination"](spark, rows, str(tmp_path)).collect()}
    for i, t in zip(ids, TEXTS, strict=True):
        n, hit, _ = brute.contamination(t, ITEMS)
        assert (i in clean) == (not hit or 20 * hit < n)
        if i in clean:
            assert clean[i].text == (brute.cut(t, ITEMS) if hit else t)

    private = stage["pii_redaction"](spark, rows, str(tmp_path)).collect()
    assert len(private) == len(ids)
    for r in private:
        text = TEXTS[r.doc_id // 3]
        assert r.n_chars == (None if text is None else len(r.text))
        assert (r.text is None) == (text is None)

    mix = stage["source_mixing"](spark, rows, str(tmp_path)).collect()
    want = brute.mixing([(f"s{i % 4}" if i % 5 else None, len(brute.words(t))) for i, t in enumerate(TEXTS)])
    assert sum(r.taken for r in mix) == sum(round(t) for _, t in want.values())


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == [], name
        assert name == "source_mixing" or out.columns == list(corpus_pipeline.COLUMNS)


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 100
    assert sum(r.taken for r in rows) == pytest.approx(sum(r.size for r in rows), abs=30)
    assert corpus_pipeline.ORACLE_SQL is None


def by_hand(spark, sf):
    """What each stage makes of rows of COLUMNS, in plain Python but for the fitted model."""
    docs, labels, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    model = classifier.train(docs, labels)
    items = [(r.item_id, r.text) for r in items.collect()]
    key = dict(docs.select("doc_id", mixing.hash_key(F.col("doc_id"), 17)).collect())

    def good(rows):
        return [x for x in rows if model.score([x[1]])[0] >= classifier.THRESHOLD]

    def apart(rows):
        component = brute.components([x[:2] for x in rows], 5, 80)
        return [x for x in rows if component[x[0]] == x[0]]

    def clean(rows):
        out = []
        for i, t, *rest, _ in rows:
            n, hit, _ = brute.contamination(t, items)
            if not hit or 20 * hit < n:
                left = brute.cut(t, items)
                out.append((i, left, *rest, len(left)))
        return out

    def private(rows):
        return [(i, t, *rest, len(t)) for i, t, *rest, _ in ((x[0], brute.redacted(x[1]), *x[2:]) for x in rows)]

    def mix(rows):
        return brute.mixed([(x[0], x[3], len(brute.words(x[1]))) for x in rows], key)

    return dict(zip(dict(corpus_pipeline.STAGES), (good, apart, clean, private, mix), strict=True))


def same_mix(got, want):
    assert [(*x[:3], x[4]) for x in got] == [(*x[:3], x[4]) for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want])


def test_all_rows_of_stages_and_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rows = sorted(map(tuple, docs.collect()))
    hand, kept = by_hand(spark, SF), rows
    for name, stage in corpus_pipeline.STAGES:
        got = sorted(map(tuple, stage(spark, docs, SF).collect()))
        if name == "source_mixing":
            same_mix(got, hand[name](rows))
        else:
            assert got == sorted(hand[name](rows)), name
            assert got != rows, name
        kept = hand[name](kept)
    same_mix(sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())), kept)


def test_every_row_of_the_language_model(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    train = [t for i, t in docs.items() if crc(i) % 10]
    base = dict(zip(docs, brute.unigram_all(train, list(docs.values())), strict=True))
    score = dict(zip(docs, brute.ppm_all([t.encode() for t in train], [t.encode() for t in docs.values()]), strict=True))
    got = op_queries.op10_lm_scoring(spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in got} == {i: x[:3] for i, x in base.items()}
    assert len(got) == len(docs) and all(r.held_out == (crc(r.doc_id) % 10 == 0) for r in got)
    for r in got:
        assert r.base_score == pytest.approx(base[r.doc_id][3], rel=1e-9)
        assert r.score == pytest.approx(score[r.doc_id], rel=1e-5)


def test_op_tables_keep_every_row(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    mixed = mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet"))
    assert mixed.count() == n


@pytest.mark.parametrize("name", ["op1_secret_scan", "op2_decontamination", "op3_quality_rules", "op6_pii", "op9_mixing"])
def test_native_operators_have_no_python_in_their_plans(spark, name):
    text = explain.plan_text(op_queries.queries()[name](spark, SF))
    for node in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text
