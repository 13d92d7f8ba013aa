import sqlite3

import pytest

from eqtlake import Dataset, Region, by_gene, by_probe, by_snp, cis_window
from eqtlake.cli import main
from eqtlake.sources import sqlite_index

from . import support


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    return Dataset.from_files(spark, support.make_files(tmp_path_factory.mktemp("files")))


@pytest.fixture(scope="module")
def path(files, tmp_path_factory):
    return support.make_sqlite(files, str(tmp_path_factory.mktemp("index") / "set.db"))


def rows(df):
    return support.text_rows([tuple(r) for r in df.collect()])


def test_tables_and_metadata(spark, files, path):
    ds = Dataset.from_sqlite(spark, path)
    assert ds.snps.dtypes == files.snps.dtypes and ds.probes.dtypes == files.probes.dtypes
    for name in ("snps", "probes", "assoc"):
        assert rows(getattr(ds, name)) == rows(getattr(files, name)), name
    assert ds.metadata() == files.metadata()


def test_parts_give_the_same_rows(spark, files, path):
    facts = sqlite_index.read_assoc(spark, path, valuesPerPartition=2)
    assert facts.rdd.getNumPartitions() > 3
    assert rows(facts) == rows(files.assoc)
    snps = sqlite_index.read_table(spark, path, "esi", rowsPerPartition=2)
    assert snps.rdd.getNumPartitions() == 3
    assert rows(snps) == rows(files.snps)


def test_queries_equal_those_on_files(spark, files, path):
    ds = Dataset.from_index(spark, f"file:{path}")
    for query in (
        lambda d: cis_window(d, Region("1", 0, 1000), Region("1", 0, 6000)),
        lambda d: by_snp(d, ["snA", "snB"]),
        lambda d: by_probe(d, "p2"),
        lambda d: by_gene(d, "G1"),
    ):
        assert rows(query(ds)) == rows(query(files)) != []


def test_only_wanted_probes_are_read(spark, path):
    ds = Dataset.from_sqlite(spark, path)
    assert {r.probe_idx for r in ds.assoc_of_probe(2).collect()} == {2}
    assert ds.assoc_of_probe(1).count() == 0 == ds.assoc_of_probe(99).count()
    assert sqlite_index.read_assoc(spark, path, probes=[]).count() == 0
    found = ds.assoc_of_probes(ds.probes.where("chr = 'X'"))
    assert {r.probe_idx for r in found.collect()} == {2}


def test_odd_indexes(spark, tmp_path, path):
    with pytest.raises(FileNotFoundError):
        Dataset.from_sqlite(spark, str(tmp_path / "none.db"))
    (tmp_path / "text.db").write_text("no index")
    with pytest.raises(ValueError, match="not a SQLite file"):
        Dataset.from_sqlite(spark, str(tmp_path / "text.db"))
    with pytest.raises(FileNotFoundError):
        Dataset.from_index(spark, str(tmp_path / "none"))
    empty = str(tmp_path / "empty.db")
    with sqlite3.connect(path) as con:
        made = [sql for (sql,) in con.execute("SELECT sql FROM sqlite_master WHERE type = 'table'")]
    with sqlite3.connect(empty) as con:
        for sql in made:
            con.execute(sql)
    ds = Dataset.from_sqlite(spark, empty)
    assert [x.count() for x in (ds.snps, ds.probes, ds.assoc)] == [0, 0, 0]
    assert cis_window(ds, Region("1", 0, 9), Region("1", 0, 9)).count() == 0


def test_command_line_takes_the_index(spark, path, tmp_path, capsys):
    out = tmp_path / "report"
    assert main(["--besd-index", path, "--probe", "p0", "--query", "1.5", "--out", str(out)], spark) == 0
    assert (tmp_path / "report.txt").exists() and "associations" in capsys.readouterr().out
