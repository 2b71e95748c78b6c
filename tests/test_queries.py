import pytest

from compare import same
from folium.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(name, spark, sf_dir):
    same(catalog.queries()[name](spark, sf_dir), catalog.ORACLES[name], sf_dir)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
