"""Every query of the subpackage that has SQL gives what DuckDB gives."""

import pytest

from pairloom.llm import registry
from tests.compare import both


@pytest.mark.parametrize("name", registry.SQL)
def test_sql(spark, sf, name):
    got, want = both(spark, sf, registry.QUERIES[name], registry.SQL[name])
    assert got == want
