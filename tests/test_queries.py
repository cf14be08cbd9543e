import pytest

from tesserae.plans import catalogue
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_like_its_sql(spark, name):
    if name in catalogue.ORACLES:
        compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)
    else:
        df = catalogue.QUERIES[name](spark, SF)
        assert len(df.collect()) > 0 and df.columns


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
