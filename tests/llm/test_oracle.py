from __future__ import annotations

import pytest

from speechmill.llm import registry
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(registry.queries()[name](spark, sf_dir), registry.oracle_sql()[name], sf_dir) == ""


def test_ten_operators_are_registered():
    numbers = {int(n.split("_")[0][2:]) for n in registry.queries()}
    assert numbers == set(range(1, 11))
