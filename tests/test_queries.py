"""Every registered query of the library against its SQL."""

from __future__ import annotations

import pytest

from tagmill.plans import catalog

from .oracle import database, same_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_all_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, con):
    same_rows(catalog.QUERIES[name](spark, FOLDER), con, catalog.ORACLE[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
