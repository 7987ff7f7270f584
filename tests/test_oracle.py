from __future__ import annotations

import pytest

from speechmill import registry
from tests.oracle import differences

ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(registry.queries()[name](spark, sf_dir), ORACLE[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLE)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
