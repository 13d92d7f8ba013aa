import math

import numpy as np
import pytest

from eqtlake.dataset import Dataset
from eqtlake.sinks import write_besd
from eqtlake.sources import besd, text

from . import support


def test_snp_lines(spark, tmp_path):
    prefix = support.make_files(tmp_path)
    rows = text.read_snps(spark, f"{prefix}.esi").orderBy("row_idx").collect()
    assert [tuple(r) for r in rows] == [
        (0, "1", "snA", 0.1, 100, "A", "G", 0.4),
        (1, "1", "snB", 0.2, 200, "C", "T", 0.2),
        (2, "1", "snC", None, 300, None, None, None),
        (3, "X", "snE", 0.0, 400, "A", "G", None),
        (4, "1", "snB", 0.0, 200, "G", "T", 0.3),
    ]


def test_probe_lines(spark, tmp_path):
    prefix = support.make_files(tmp_path)
    rows = text.read_probes(spark, f"{prefix}.epi").orderBy("row_idx").collect()
    assert [(r.row_idx, r.chr, r.probe_id, r.probe_bp, r.gene, r.orientation) for r in rows] == [
        (0, "1", "p0", 150, "G1", "+"),
        (1, "1", "p1", 150, "G2", "-"),
        (2, "X", "p2", 350, "G1", "+"),
        (3, "1", "p3", 5000, None, None),
        (4, "1", "p1", 100, "NA", "+"),
    ]


def test_rows_are_numbered_across_splits(spark, tmp_path):
    lines = [f"1 rs{i} 0 {i if i % 7 else 'NA'} A G 0.1" for i in range(3000)]
    (tmp_path / "many.esi").write_text("\r\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = text.read_snps(spark, str(tmp_path / "many.esi")).orderBy("row_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    kept = [i for i in range(3000) if i % 7]
    assert [(r.row_idx, r.bp) for r in rows] == list(enumerate(kept))


@pytest.mark.parametrize("kind", ["3F", "3"])
@pytest.mark.parametrize("values", [1, 2, 4_000_000])
def test_binary_formats(spark, tmp_path, kind, values):
    prefix = support.make_files(tmp_path, kind)
    rows = besd.read_assoc(spark, f"{prefix}.besd", support.N_PROBES, valuesPerPartition=values).collect()
    got = sorted((r.probe_idx, r.ord, r.snp_idx, str(r.beta), str(r.se)) for r in rows)
    want, place = [], {}
    for p, s, b, e in support.ROWS:
        place[p] = place.get(p, -1) + 1
        want.append((p, place[p], s, str(float(np.float32(b))), str(float(np.float32(e)))))
    assert got == sorted(want)
    assert besd.read_layout(f"{prefix}.besd", support.N_PROBES).kind == kind


def test_only_the_slices_of_wanted_probes_are_read(spark, tmp_path):
    prefix = support.make_files(tmp_path)
    layout = besd.read_layout(f"{prefix}.besd", support.N_PROBES)
    dealt = list(besd.stretches(layout, 2, [4, 0, 99, -1]))
    assert sum(s[2] - s[1] for part in dealt for s in part.slices) == 5
    assert {s[0] for part in dealt for s in part.slices} == {0, 4}
    ds = Dataset.from_files(spark, prefix)
    own = ds.assoc_of_probes(ds.probes.where("probe_id = 'p2'"))
    assert own.rdd.getNumPartitions() == 1 and {r.probe_idx for r in own.collect()} == {2}
    assert [r.snp_idx for r in ds.assoc_of_probe(2).orderBy("ord").collect()] == [3, 1, 9]
    assert ds.assoc_of_probes(ds.probes.where("false")).collect() == []


@pytest.mark.parametrize("kind", ["3F", "3"])
def test_matrix_written_by_tasks(spark, tmp_path, kind):
    """Byte for byte what a plain writer gives, also of no facts."""
    prefix = support.make_files(tmp_path, kind)
    rows = besd.read_assoc(spark, f"{prefix}.besd", support.N_PROBES)
    for df, name in ((rows.repartition(5), "set.besd"), (rows.where("false"), "none.besd")):
        write_besd(df, support.N_PROBES, str(tmp_path / "again.besd"), kind)
        if name == "none.besd":
            support.write_small_besd([], support.N_PROBES, str(tmp_path / name), kind)
        assert (tmp_path / "again.besd").read_bytes() == (tmp_path / name).read_bytes()


def test_lists_of_several_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        (folder / f"part-{k}").write_text("".join(f"1 s{k}_{i} 0 {i} A G 0.1\n" for i in range(4)))
    rows = text.read_snps(spark, str(folder)).orderBy("row_idx").collect()
    assert [(r.row_idx, r.snp_id) for r in rows] == [(4 * k + i, f"s{k}_{i}") for k in range(3) for i in range(4)]


def test_binary_errors(spark, tmp_path):
    prefix = support.make_files(tmp_path)
    whole = (tmp_path / "set.besd").read_bytes()
    (tmp_path / "short.besd").write_bytes(whole[:-4])
    with pytest.raises(ValueError, match="truncated"):
        besd.read_layout(str(tmp_path / "short.besd"), support.N_PROBES)
    (tmp_path / "magic.besd").write_bytes(b"\x05\0\0\0" + whole[4:])
    with pytest.raises(ValueError, match="0x00000005"):
        besd.read_layout(str(tmp_path / "magic.besd"), support.N_PROBES)
    with pytest.raises(FileNotFoundError):
        besd.read_layout(f"{prefix}.none", 1)


def test_offsets_beyond_the_arrays_are_left_out(spark, tmp_path):
    cols = np.array([0, 2, 4], "<u8")
    body = np.array([besd.MAGIC_3F], "<u4").tobytes() + np.array([3], "<u8").tobytes() + cols.tobytes()
    body += np.array([7, 8, 7], "<u4").tobytes() + np.array([0.5, 0.25, 2.0], "<f4").tobytes()
    (tmp_path / "odd.besd").write_bytes(body)
    rows = besd.read_assoc(spark, str(tmp_path / "odd.besd"), 1).collect()
    assert [tuple(r) for r in rows] == [(0, 0, 7, 0.5, 2.0)]


def test_dataset_from_files(spark, tmp_path):
    ds = Dataset.from_files(spark, support.make_files(tmp_path))
    meta = ds.metadata()
    assert (meta["n_snps"], meta["n_probes"], meta["format_type"]) == ("5", "5", "3F")
    assert math.isnan([r for r in ds.assoc.collect() if r.probe_idx == 2 and r.snp_idx == 1][0].beta)
