"""The registered queries against independent DuckDB SQL, over all rows."""

from __future__ import annotations

import check_oracle
import pytest
from conftest import SF

from branchlore.llm.oracle import oracle_sql
from branchlore.llm.queries import queries


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries()) == list(range(1, 14))
    assert set(oracle_sql()) < set(queries())


@pytest.mark.parametrize("name", oracle_sql())
def test_query_equals_oracle(spark, name):
    assert check_oracle.compare(spark, check_oracle.duck(SF), SF, name, oracle_sql()[name]) == ""
