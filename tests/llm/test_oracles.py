"""The numbered operators that SQL can express, side by side with DuckDB."""

from __future__ import annotations

import pytest

import oracle
from navgraph.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    con = oracle.connect(sf_dir)
    assert oracle.differences(spark, con, name, registry.queries()[name], registry.oracle_sql()[name], sf_dir) == ""
