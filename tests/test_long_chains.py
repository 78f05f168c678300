"""Greedy clustering of chains that need more rounds than are made."""

import random

import pytest

from pairloom.operators import clustering
from pairloom.operators.clustering import greedy


@pytest.mark.parametrize("rest", [100_000, 3])
def test_chains_beyond_the_rounds(spark, monkeypatch, rest):
    """With the rest on the driver, and with too much of it at first, so that rounds go on."""
    monkeypatch.setattr(clustering, "REST", rest, raising=False)
    rng = random.Random(3)
    edges = {(i, i + 1) for i in range(13)} | {(a, b) for a in range(20, 34) for b in range(a + 1, 34) if rng.random() < 0.3}
    near, want, reps = {}, {}, []
    for a, b in edges:
        near.setdefault(b, set()).add(a)
    for x in range(36):
        first = next((r for r in reps if r in near.get(x, ())), None)
        want[x] = x if first is None else first
        if first is None:
            reps.append(x)
    got = greedy(spark.range(36), spark.createDataFrame(sorted(edges), "a long, b long"), rounds=2)
    assert {r["id"]: r["representative"] for r in got.collect()} == want
