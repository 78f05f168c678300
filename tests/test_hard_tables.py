"""Every query of the core on hard tables."""

import pytest

from pairloom.plans import domain, problems
from tests import hard_tables

QUERIES = {**problems.QUERIES, **domain.QUERIES}


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    return hard_tables.empty(spark, sf, tmp_path_factory.mktemp("empty"))


@pytest.fixture(scope="module")
def hard(spark, sf, tmp_path_factory):
    return hard_tables.hard(spark, sf, tmp_path_factory.mktemp("hard"))


@pytest.mark.parametrize("name", QUERIES)
def test_empty(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    assert not rows or name in ("d08_lengths", "d09_unknown_residues")


@pytest.mark.parametrize("name", QUERIES)
def test_hard(spark, sf, hard, name):
    assert QUERIES[name](spark, hard).columns == QUERIES[name](spark, sf).columns
    assert len(QUERIES[name](spark, hard).collect()) >= len(QUERIES[name](spark, sf).collect())
