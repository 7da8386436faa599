"""Every query of the subpackage that has SQL against that SQL, and all of them for a stable schema on the smallest tables."""

from __future__ import annotations

import pytest

from tagmill.llm import catalog

from ..oracle import database, same_rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(name, spark):
    same_rows(catalog.QUERIES[name](spark, FOLDER), database(FOLDER), catalog.ORACLE[name])


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
