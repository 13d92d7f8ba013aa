import numpy as np
import pytest

from eqtlake import Dataset, Region, by_gene, by_probe, by_snp, cis_window, cis_windows, probe_range, snp_range
from eqtlake.operators import queries as q
from eqtlake.operators import summary

from . import support


@pytest.fixture(scope="module", params=["files", "store"])
def ds(request, spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    files = Dataset.from_files(spark, support.make_files(folder))
    return files if request.param == "files" else files.save(str(folder / "store"), by_snp=True)


def expected(keep_snp, keep_probe):
    """Brute force: (snp row, probe row, beta, se, p) in file order."""
    out = []
    for p, s, b, e in support.ROWS:
        b, e = float(np.float32(b)), float(np.float32(e))
        if s < support.N_SNPS and keep_snp(s) and keep_probe(p):
            out.append((s, p, b, e, support.p_value(b, e)))
    return out


SNP_IDS = ["snA", "snB", "snC", "snE", "snB"]
PROBE_IDS = ["p0", "p1", "p2", "p3", "p1"]


def check(df, want):
    rows = df.collect()
    assert [(r.snp_id, r.probe_id, str(r.beta), str(r.se)) for r in rows] == [
        (SNP_IDS[s], PROBE_IDS[p], str(b), str(e)) for s, p, b, e, _ in want
    ]
    assert [r.pval for r in rows] == pytest.approx([w[-1] for w in want], abs=1e-12)
    assert df.columns == list(q.RESULT)


def test_ranges_are_closed(ds):
    assert [r.row_idx for r in snp_range(ds, Region("1", 100, 200), ordered=True).collect()] == [0, 1, 4]
    assert [r.row_idx for r in snp_range(ds, Region("X", 400, 400)).collect()] == [3]
    assert [r.row_idx for r in probe_range(ds, Region("1", 100, 150), ordered=True).collect()] == [4, 0, 1]
    assert probe_range(ds, Region("2", 0, 10**9)).collect() == []
    assert snp_range(ds, Region("1", 300, 100)).collect() == []


def test_cis_window(ds):
    found = cis_window(ds, Region("1", 100, 250), Region("1", 0, 200), ordered=True)
    want = expected(lambda s: s in (0, 1, 4), lambda p: p in (0, 1, 4))
    check(found, sorted(want, key=lambda w: (w[1] != 4, w[1])))


def test_window_threshold_is_strict(ds):
    whole = cis_window(ds, Region("1", 0, 10**6), Region("1", 0, 10**6))
    p = min(r.pval for r in whole.collect() if r.pval > 0)
    assert all(r.pval < p for r in cis_window(ds, Region("1", 0, 10**6), Region("1", 0, 10**6), pval_below=p).collect())
    assert all(r.pval < 1 for r in cis_window(ds, Region("1", 0, 10**6), Region("1", 0, 10**6), pval_below=1.0).collect())


def test_overlapping_windows_repeat_rows(ds):
    one = Region("1", 0, 10**6)
    two = cis_windows(ds, [one, Region("1", 50, 150)], [one, one], ordered=True)
    once = cis_window(ds, one, one).count()
    twice = cis_window(ds, Region("1", 50, 150), one).count()
    assert two.count() == 2 * once + 2 * twice


def test_by_snp(ds):
    check(by_snp(ds, "snA", ordered=True), expected(lambda s: s == 0, lambda p: True))
    # Of two SNPs named snB the first is meant.
    check(by_snp(ds, "snB", ordered=True), expected(lambda s: s == 1, lambda p: True))
    first = by_snp(ds, "snA", first_only=True, ordered=True)
    check(first, [w for i, w in enumerate(expected(lambda s: s == 0, lambda p: True)) if i != 1])


def test_by_probe_and_gene(ds):
    check(by_probe(ds, "p0", ordered=True), expected(lambda s: True, lambda p: p == 0))
    # Of two probes named p1 the first is meant, which has no rows.
    assert by_probe(ds, "p1").collect() == []
    check(by_gene(ds, "G1", ordered=True), expected(lambda s: True, lambda p: p in (0, 2)))
    check(by_gene(ds, "NA", ordered=True), expected(lambda s: True, lambda p: p == 4))


def test_lists_keep_order_and_repeats(ds):
    once = expected(lambda s: s == 0, lambda p: True)
    other = expected(lambda s: s == 3, lambda p: True)
    check(by_snp(ds, ["snA", "snE", "none", "snA"], ordered=True), once + other + once)
    assert by_gene(ds, ["G1", "G1"]).count() == 2 * by_gene(ds, "G1").count()


def test_unknown_ids_give_no_rows(ds):
    for found in (by_snp(ds, "x"), by_probe(ds, "x"), by_gene(ds, ""), by_snp(ds, [""])):
        assert found.collect() == [] and found.columns == list(q.RESULT)


def test_probe_slice(ds):
    assert [(r.snp_idx, r.se) for r in q.probe_associations(ds, 0).collect()] == [
        (0, pytest.approx(0.1)),
        (2, 0.5),
        (0, 0.0),
    ]
    assert q.probe_associations(ds, 99).collect() == q.probe_associations(ds, -1).collect() == []


def test_dangling_snps(ds):
    assert [tuple(r) for r in q.dangling(ds).collect()] == [(9, 1)]
    with pytest.raises(KeyError):
        q.check_snps(ds)


def test_summaries(ds):
    counts = {r.probe_idx: r.snp_count for r in summary.probe_snp_counts(ds).collect()}
    assert counts == {0: 3, 1: 0, 2: 3, 3: 2, 4: 2}
    arrays = {r.probe_idx: (r.snp_count, r.snp_indices) for r in summary.probe_arrays(ds).collect()}
    assert arrays[0] == (3, [0, 2, 0]) and arrays[1] == (0, [])
    assert summary.from_arrays(summary.probe_arrays(ds)).count() == len(support.ROWS)
    ids = ["snA", "none", "snA"]
    got = summary.id_counts(by_snp(ds, sorted(set(ids))), ids, "snp_id").orderBy("pos").collect()
    assert [(r.id, r.n) for r in got] == [("snA", 3), ("none", 0), ("snA", 3)]
    row = summary.threshold_counts(by_gene(ds, "G1"), 0.05).first()
    want = expected(lambda s: True, lambda p: p in (0, 2))
    assert (row.n_all, row.n_below) == (len(want), sum(w[-1] < 0.05 for w in want))
    assert {r.key: r.value for r in summary.dataset_counts(ds).collect()} == {"n_snps": "5", "n_probes": "5"}
