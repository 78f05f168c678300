"""Every query that has SQL gives what DuckDB gives."""

import pytest

from pairloom.plans import analogues, registry
from tests.compare import both


@pytest.mark.parametrize("name", registry.SQL)
def test_sql(spark, sf, name):
    got, want = both(spark, sf, registry.QUERIES[name], registry.SQL[name])
    assert got == want


def test_every_query_has_sql_but_those_of_the_readme():
    assert set(registry.QUERIES) - set(registry.SQL) <= {"d13_greedy_clusters"} and len(analogues.QUERIES) == 31


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_read_only_what_is_used(spark, sf):
    plan = registry.QUERIES["q01_conjunction"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag)" in plan and "l_shipdate" not in plan
    plan = registry.QUERIES["d04_best_rows"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "uniprot_pair" not in plan and plan.count("Exchange") == 1
