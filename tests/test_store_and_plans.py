import pytest

from eqtlake import Dataset, Region, by_probe, by_snp, cis_window
from eqtlake.catalog import dataset
from eqtlake.plans import explain

from . import support

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store")
    return Dataset.from_files(spark, support.make_files(folder)).save(str(folder / "store"), by_snp=True)


def test_store_exists_and_force(spark, tmp_path):
    files = Dataset.from_files(spark, support.make_files(tmp_path))
    folder = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        Dataset.from_store(spark, folder)
    first = files.save(folder)
    assert first.assoc_by_snp is None
    with pytest.raises(FileExistsError):
        files.save(folder)
    again = files.save(folder, force=True)
    meta = again.metadata()
    assert (meta["n_snps"], meta["n_probes"], meta["format_type"]) == ("5", "5", "3F")
    assert again.assoc.count() == len(support.ROWS)


def test_chromosome_stays_text(stored):
    assert stored.assoc.schema["probe_chr"].dataType.simpleString() == "string"
    assert {r.probe_chr for r in stored.assoc.collect()} == {"1", "X"}


def test_window_plan_prunes_the_store(stored):
    found = cis_window(stored, Region("1", 0, 1000), Region("X", 0, 1000))
    assert any("probe_chr" in x for x in explain.partition_filters(found))
    assert any("probe_idx" in x for x in explain.pushed_filters(found))


def test_snp_lookup_uses_the_projection(stored):
    assert any("snp_idx" in x for x in explain.pushed_filters(by_snp(stored, "snA")))


def test_queries_stay_in_the_jvm(spark):
    ds = dataset(spark, SF)
    for found in (cis_window(ds, Region("1", 0, 10**6), Region("1", 0, 10**6)), by_snp(ds, "rs42"), by_probe(ds, "x")):
        text = explain.plan_text(found)
        assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text
        assert explain.operators(found)["BroadcastHashJoin"] >= 2


def test_columns_are_pruned(spark):
    read = explain.read_schemas(cis_window(dataset(spark, SF), Region("1", 0, 1000), Region("1", 0, 1000)))
    assert not any("l_extendedprice" in x or "p_retailprice" in x for x in read)
