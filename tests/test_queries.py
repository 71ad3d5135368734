"""Every registered query of the reference's own operators against its DuckDB oracle."""

import pytest
from compare import duck, duck_rows, spark_rows

from siftline.plans import registry

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    columns, rows = spark_rows(registry.queries()[name](spark, sf_dir))
    assert len(set(columns)) == len(columns)
    if name in ORACLES:
        assert (columns, rows) == duck_rows(con, ORACLES[name])


def test_oracles_have_queries():
    assert ORACLES.keys() <= registry.queries().keys()
