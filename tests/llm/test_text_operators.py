"""Operators that judge one text at a time, against plain Python."""

import re
import time

import pytest
from pyspark.sql import functions as F

from eqtlake.llm import decontaminate, pii, quality_rules, secret_scan
from eqtlake.llm.common import materialize, small_side
from eqtlake.llm.spans import between, chunks, digest, span_digests
from eqtlake.llm.trigrams import trigram_query

from . import brute
from .conftest import CARD, ITEMS, TEXTS


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_secrets(docs):
    found = secret_scan.scan_secrets(docs)
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    got = by_id(found.select("doc_id", *span_digests(F.col("secrets"), kinds)), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for i, text in enumerate(TEXTS):
        want = brute.spans(text, brute.SECRETS)
        assert got[3 * i][3] == brute.sha(want), text
        assert got[3 * i][:3] == tuple(want.count(f"{k}:") for k in kinds)
        assert set(filter(None, want.split(","))) <= set(got[3 * i][4].split(","))
    assert any("github:" in x[4] for x in got.values())


def secret_digests(df):
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    found = secret_scan.scan_secrets(df).select("doc_id", *span_digests(F.col("secrets"), kinds))
    return sorted((str(r.doc_id), r.base_sha256, r.spans) for r in found.collect())


def test_secrets_of_odd_tables(spark, no_docs):
    """Null and repeated ids, repeated rows and nulls, by value."""
    texts = [None, "", "token: abcdefg", "secret=abcdef1", "AKIA" + "A" * 16, "f" * 30 + " token: abcdefg"]
    rows = [(i, t) for i in (None, 4, 4, 5) for t in texts]
    got = secret_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    spans = [brute.spans(t, brute.SECRETS) for _, t in rows]
    assert got == sorted((str(i), brute.sha(s), s) for (i, _), s in zip(rows, spans, strict=True))
    assert secret_scan.scan_secrets(no_docs).collect() == []


def test_rules_without_an_index(docs):
    rules = [r for r in secret_scan.RULES if trigram_query(r.pattern) is None]
    found = secret_scan.scan_secrets(docs, rules)
    assert rules and {s.kind for r in found.collect() for s in r.secrets} == {"hex"}


def test_tokens_in_runs(spark):
    """What the linear expression finds is what the plain one means."""
    head, body = "eyJ" + "a" * 8, "eyJ" + "b" * 9
    texts = [
        f"{head}.{body}.sig",
        f"xx-{head}.{body}.sig_1 {head}.{body}.s",
        f"eyJeyJ{head}.{body}.sig.{head}.{body}.more",
        f"eyJab.{body}.sig",
        f"{head}.eyJab.sig {head}.{body}.",
        f"{head}.{head}.{body}.sig",
        f"é{head}.{body}.é",
        "eyJ" * 60_000,
        "eyJ" * 60_000 + "." + body + ".z",
    ]
    found = secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rule = next(r for r in secret_scan.RULES if r.kind == "jwt")
    for r in found.collect():
        got = [(s.start, s.end, s.match) for s in r.secrets if s.kind == "jwt"]
        assert got == [(m.start(), m.end(), m[0]) for m in re.finditer(rule.pattern, texts[r.doc_id])] if r.doc_id < 7 else len(got) == r.doc_id - 7


def test_trigram_queries_never_exclude_a_match():
    for rule in secret_scan.RULES:
        query = trigram_query(rule.pattern)
        assert query is None or all(len(g) == 3 for part in query for g in part)
    assert trigram_query("[0-9a-f]+") is None
    assert set(trigram_query("ab?cd")) == {frozenset({"abc", "bcd"}), frozenset({"acd"})}
    assert set(trigram_query("(foo|ba)x")) == {frozenset({"foo", "oox"}), frozenset({"bax"})}
    assert trigram_query("(foo|ba).") is None
    assert trigram_query("x*") is None


def test_pii(docs):
    found = pii.find_pii(docs)
    kinds = [d.kind for d in pii.BASE]
    got = by_id(
        found.select("doc_id", *span_digests(F.col("pii"), kinds), pii.redact(F.col("text"), F.col("pii")).alias("clean")),
        *[f"n_{k}" for k in kinds],
        "base_sha256",
        "spans",
        "clean",
    )
    for i, text in enumerate(TEXTS):
        if text and len(text) > 30000 and "7" in text:
            continue  # one run of digits, for which Python's backtracking is slow
        want = brute.spans(text, brute.PII)
        assert got[3 * i][4] == brute.sha(want), text
        assert got[3 * i][:4] == tuple(want.count(f"{k}:") for k in kinds)
    by_text = {t: got[3 * i] for i, t in enumerate(TEXTS)}
    iban = next(v for t, v in by_text.items() if t and "iban" in t)
    assert iban[5].count("iban:") == 1
    # Context raises the first number over the threshold, not the far one.
    ssn = next(v for t, v in by_text.items() if t and "social" in t)
    assert ssn[5] == "ssn:17:28" and ssn[6].startswith("my social number [SSN] pad")
    card = next(v for t, v in by_text.items() if t and CARD in t)
    assert CARD not in card[6] and "[CARD]" in card[6] and "a@b.co" not in card[6]


def test_pii_of_odd_tables(spark, no_docs):
    """Null and repeated ids and repeated rows by value; empty tables."""
    texts = [None, "", "mail a@b.co", "é a@b.co 1.2.3.4 \U0001F600 c@d.ef", "ssn 123-45-6789"]
    rows = [(i, t) for i in (None, 4, 4) for t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = pii.find_pii(docs).select("doc_id", "text", digest(F.col("pii")).alias("spans"), pii.redact(F.col("text"), F.col("pii")).alias("clean"))
    got = sorted((str(r.doc_id), r.text, r.spans, r.clean) for r in found.collect())
    base = lambda t: brute.spans(t, brute.PII) or ("ssn:4:15" if t and "ssn" in t else "")
    assert got == sorted((str(i), t or "", base(t), brute.redacted(t or "")) for i, t in rows)
    assert pii.find_pii(no_docs).collect() == []


def test_long_texts_of_spans(spark):
    """Twice the spans take about twice the time: places far down cost no more."""

    def seconds(n: int) -> float:
        text = " ".join(f"m{i}@host.org" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        row = pii.find_pii(docs).select(F.size("pii").alias("n"), pii.redact(F.col("text"), F.col("pii")).alias("t")).first()
        assert row.n == n and row.t == " ".join(["[EMAIL]"] * n)
        return time.perf_counter() - began

    seconds(10)
    few = seconds(100)
    half, whole = seconds(10_000) - few, seconds(20_000) - few
    assert whole < 3 * max(half, 1.0)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_chunks(spark, n):
    text = "".join(chr(0x1F600 + i % 50) if i % 3 else "\n" for i in range(n))
    rows = [(text, a, b) for a in range(0, n + 1, 9) for b in range(a, n + 1, 13)]
    df = spark.createDataFrame(rows or [(text, 0, 0)], "t string, a long, b long")
    got = df.select("a", "b", between(chunks(F.col("t")), F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r.x == text[r.a : r.b] for r in got)


def test_redact_overlaps(spark):
    rows = spark.createDataFrame(
        [("abcdefghij", [(1, 0, 4, "x"), (2, 1, 6, "y"), (3, 2, 4, "z"), (7, 0, 9, "x")])],
        "text string, s array<struct<start:long,rank:int,end:long,kind:string>>",
    )
    assert rows.select(pii.redact(F.col("text"), F.col("s")).alias("t")).first().t == "a[X]g[X]j"


def test_checksums(spark):
    values = ["4111111111111111", "4111111111111112", "79927398713", "GB82WEST12345698765432", "GB82WEST12345698765433"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = rows.select(pii.luhn(F.col("v")).alias("l"), pii.mod97(F.col("v")).alias("m")).collect()
    assert [r.l for r in got[:3]] == [True, False, True]
    assert [r.m for r in got[3:]] == [True, False]


def test_quality_features(docs):
    got = by_id(
        quality_rules.quality_rules(docs),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
    )
    for i, text in enumerate(TEXTS):
        want = brute.quality(text)
        assert got[3 * i] == (*want, want[0] < 50 or 100 * want[4] > 50 * want[0]), text


def words_of(n: int, tail: str = "") -> str:
    return " ".join(f"word{i}" for i in range(n)) + tail


def hosted(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, source string")


def test_quality_hosts(spark, no_docs):
    good = words_of(80)
    rows = [(good if i % 10 == 0 else "bad", "bad-host") for i in range(40)]
    rows += [(good if i else "bad", f"host{i % 8}") for i in range(80)]
    rows += [(good, None)]
    got = by_id(quality_rules.quality_rules(hosted(spark, rows)), "base_failed", "kept", "host_rate")
    assert got[0][:2] == (False, False) and got[0][2] > quality_rules.MAX_HOST_RATE
    assert got[41][:2] == (False, True) and got[40][:2] == (True, False)
    assert got[120][:2] == (False, True)
    assert quality_rules.quality_rules(no_docs).collect() == []


def test_hosts_of_one_document_are_not_condemned(spark):
    """Their rates are noise alone, so all are shrunk to the mean."""
    rows = [("bad" if i % 10 < 3 else words_of(60), f"h{i}") for i in range(300)]
    got = by_id(quality_rules.quality_rules(hosted(spark, rows)), "base_failed", "kept", "host_rate")
    assert all(r[1] != r[0] and r[2] == pytest.approx(0.3, abs=1e-3) for r in got.values())


def test_rules_of_a_host_by_habit(spark):
    """Symbol junk goes where it is a habit; one such page elsewhere stays."""
    good, junk = words_of(60), words_of(60, " $$$ ### &&& ||| ***")
    rows = [(junk if i % 4 == 0 else good, "forum") for i in range(200)]
    rows += [(junk if i == 0 else good, "news") for i in range(200)]
    got = by_id(quality_rules.quality_rules(hosted(spark, rows)), "failed", "base_failed", "kept")
    assert got[0] == (["symbols"], False, False) and got[1] == ([], False, True)
    assert got[200] == (["symbols"], False, True)


def test_quality_of_odd_rows(spark, odd_docs):
    """Null and repeated ids and repeated rows are each judged by their text."""
    got = quality_rules.quality_rules(odd_docs).collect()
    want = [brute.quality(r.text) for r in odd_docs.collect()]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(want)


def test_verdicts_decide_rows_of_the_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert quality_rules.quality_rules(docs).where("kept != (not base_failed)").count() > 0


def test_contamination(docs, benchmark_items):
    got = by_id(decontaminate.decontaminate(docs, benchmark_items), "n_words", "n_hit", "items", "contaminated")
    for i, text in enumerate(TEXTS):
        n, hit, items = brute.contamination(text, ITEMS)
        assert got[3 * i] == (n, hit, items, hit > 0 and 20 * hit >= n), text


def test_contamination_of_odd_tables(spark, odd_docs, no_docs, benchmark_items):
    rows = decontaminate.decontaminate(odd_docs, benchmark_items).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"]) == brute.contamination(r.text, ITEMS)
    assert decontaminate.decontaminate(no_docs, benchmark_items).collect() == []
    nothing = benchmark_items.where("false")
    assert all(r.n_hit == 0 for r in decontaminate.decontaminate(odd_docs, nothing).collect())


def test_a_foreign_short_item_seeds_nothing(spark, docs, benchmark_items, monkeypatch):
    """Short items have one fingerprint, so one that occurs nowhere brings no candidates."""
    counts = {}

    def counted(df, name):
        out = materialize(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(decontaminate, "materialize", counted)
    seen = []
    for more in ([], [(99, "zyzzyva"), (98, "zyzzyva w3 nowhere else")]):
        extra = spark.createDataFrame([(*x, "") for x in more], benchmark_items.schema)
        found = decontaminate.decontaminate(docs, benchmark_items.union(extra)).collect()
        seen.append((counts["decon-candidates"], counts["decon-words"], sorted((r.doc_id, r.n_hit) for r in found)))
    assert seen[0] == seen[1] and seen[0][0] < docs.count()


def test_broadcast_is_bounded_in_bytes(spark):
    def hinted(df):
        return "broadcast" in df._jdf.queryExecution().logical().toString().lower()

    few = spark.createDataFrame([("x" * 1000, [1, 2], [("a", 1)])], "a string, b array<int>, c array<struct<d:string,e:int>>")
    assert hinted(small_side(few)) and not hinted(small_side(few, size=900)) and not hinted(small_side(few, rows=0))


def test_cut(docs, benchmark_items):
    found = decontaminate.decontaminate(docs, benchmark_items)
    for r in found.select("text", "spans", decontaminate.cut(F.col("text"), F.col("spans")).alias("left")).collect():
        hit = {j for s in r.spans for j in range(s.s, s.e)}
        want = [w for j, w in enumerate(brute.item_words(r.text)) if j not in hit]
        assert brute.item_words(r.left) == want


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_running_sum(spark, n):
    from eqtlake.llm.common import running_sum

    values = [(i * 7) % 11 for i in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>").select(running_sum(F.col("v")).alias("s")).first()
    assert row.s == [sum(values[:i]) for i in range(n)]


def test_numbers_beside_others_are_found(spark):
    text = "two 4111111111111111 4111111111111111 and +1 (843) 555-7672 4550997810720808"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.find_pii(docs).select(pii.redact(F.col("text"), F.col("pii")).alias("t")).first().t
    assert "4111111111111111" not in found and "555-7672" not in found


def test_numbers_in_groups_beside_others_are_found(spark):
    card, amex, gb, de = "4111 1111 1111 1111", "3782-822463-10005", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"
    es = "ES91 2100 0418 4502 0005 1332"
    want = {
        f"{card} 12/26": (card,),
        f"year 2024 {card} 2025 and {amex} 77": (card, amex),
        f"{card} {card}": (card,),
        f"pay {gb} OK or {de} 2024, {es} ON": (gb, de, es),
        f"{es} EUR 100": (es,),
        "1234 5678 9012 3456 12/26 GB82 WEST 1234 5698 7654 33": (),
        f"x{card} 12/26 AB12 CDEF": (),
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    spans = pii.find_pii(docs).select("doc_id", "text", "pii", pii.redact(F.col("text"), F.col("pii")).alias("clean"))
    for r in spans.collect():
        found = {r.text[s.start : s.end] for s in r.pii if s.kind.endswith("_groups")}
        # Moved by a group, a number may pass its checksum again.
        assert found >= set(want[r.text]) and bool(found) == bool(want[r.text]), r.text
        assert all(s.match == r.text[s.start : s.end] for s in r.pii)
        assert not any(x in r.clean for x in want[r.text]), r.clean
