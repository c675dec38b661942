"""Every query against its SQL."""

import pytest

from quillspark import catalog

from .compare import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf)


def test_all_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
