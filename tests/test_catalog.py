import pytest

import __spark_entry__
from eqtlake import catalog

from . import support

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return support.views(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_against_sql(spark, con, name):
    support.same_rows(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 211
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
