"""Every query of the subpackage on hard tables."""

import pytest

from pairloom.llm import problems
from tests import hard_tables

QUERIES = problems.QUERIES


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    folder = hard_tables.empty(spark, sf, tmp_path_factory.mktemp("empty"))
    spark.read.parquet(f"{sf}/split_shares.parquet").write.mode("overwrite").parquet(f"{folder}/split_shares.parquet")
    return folder


@pytest.fixture(scope="module")
def hard(spark, sf, tmp_path_factory):
    return hard_tables.hard(spark, sf, tmp_path_factory.mktemp("hard"))


@pytest.mark.parametrize("name", QUERIES)
def test_empty(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", QUERIES)
def test_hard(spark, sf, hard, name):
    got = QUERIES[name](spark, hard)
    assert got.columns == QUERIES[name](spark, sf).columns
    rows = got.collect()
    if name not in ("p6_renamed", "p7_mix"):
        assert len(rows) >= len(QUERIES[name](spark, sf).collect())
