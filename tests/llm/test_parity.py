"""The parity-sketch join against all pairs."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from pairloom.llm import parity
from pairloom.llm.parity import _Cells, band_of, cells_of, mix, similar_pairs, sketches, token_sets

SETS = "id long, tokens array<long>, alike string"


def sets(rng, n, kinds, most):
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            old = set(rng.choice(out))
            for _ in range(rng.randint(0, max(1, len(old) // 3))):
                old.discard(rng.choice(sorted(old))) if rng.random() < 0.5 and len(old) > 1 else old.add(rng.randrange(kinds))
            out.append(old)
        else:
            out.append({rng.randrange(kinds) for _ in range(rng.randint(1, most))})
    return out


def brute(rows, t):
    return {
        (i, j): (len(a & b), len(a | b)) for i, a in rows for j, b in rows if i < j and len(a & b) * t.denominator >= len(a | b) * t.numerator and a
    }


def found(spark, rows, t, alike=None):
    df = spark.createDataFrame([(i, list(s), None) if len(x) == 0 else (i, list(s), x[0]) for i, s, *x in rows], SETS)
    return {(r["a"], r["b"]): (r["shared"], r["either"]) for r in similar_pairs(df, t, alike).collect()}


@pytest.mark.parametrize("t", [Fraction(1, 2), Fraction(4, 5), Fraction(2, 5), Fraction(9, 10), Fraction(1)])
def test_all_pairs(spark, t):
    rng = random.Random(8)
    for kinds, most in ((40, 6), (3000, 60)):
        rows = list(enumerate(sets(rng, 120, kinds, most)))
        assert found(spark, rows, t) == brute(rows, t)


@pytest.mark.parametrize("t", [Fraction(1, 2), Fraction(4, 5)])
def test_pairs_across_bands(spark, monkeypatch, t):
    monkeypatch.setattr(parity, "FIRST", 8)
    rng = random.Random(9)
    rows = list(enumerate(sets(rng, 120, 500, 50)))
    assert found(spark, rows, t) == brute(rows, t)


def test_records_whose_tokens_fall_together(spark, monkeypatch):
    """So few cells that no cell must agree: those records meet in one-token cells."""
    rng = random.Random(10)
    rows = list(enumerate(sets(rng, 80, 300, 16)))
    monkeypatch.setattr(parity, "FIRST", 16)
    monkeypatch.setattr(parity, "PER", 8)
    odd = [i for i, s in rows if not _Cells(pa.array([sorted(s)]), token_sets, Fraction(4, 5), True).regular()[0]]
    assert 10 < len(odd) < 80
    assert found(spark, rows, Fraction(4, 5)) == brute(rows, Fraction(4, 5))


def test_cells_of_several_tokens_are_rarer(monkeypatch):
    """Records that share many common tokens by chance agree in fewer cells if a cell holds several."""
    rng = random.Random(11)
    column = pa.array([sorted(rng.sample(range(200), 64)) for _ in range(200)])
    met = {}
    for several in (False, True):
        cells = _Cells(column, token_sets, Fraction(4, 5), several)
        record, signature, agree = next(cells.role(parity.SMALLER))
        assert (agree > 0).all() and cells.regular().all()
        assert (len(record) < 0.6 * cells.n.sum()) == several
        _, counts = np.unique(signature, return_counts=True)
        met[several] = int((counts * (counts - 1)).sum())
    assert met[True] < met[False] / 5


@pytest.mark.parametrize("t", [Fraction(1, 2), Fraction(4, 5), Fraction(9, 10)])
@pytest.mark.parametrize("several", [False, True])
def test_cells_that_must_agree_do(t, several):
    rng = random.Random(13)
    if several and t < parity.SEVERAL:
        return
    for _ in range(300):
        a = {rng.randrange(10_000) for _ in range(rng.randint(1, 90))}
        b = set(a)
        for x in rng.sample(sorted(a), rng.randint(0, len(a) // 3)):
            b.discard(x)
        b |= {rng.randrange(10_000) for _ in range(rng.randint(0, len(a) // 4))}
        if not b or len(a & b) * t.denominator < len(a | b) * t.numerator:
            continue
        a, b = sorted((a, b), key=len)
        cells = _Cells(pa.array([sorted(a), sorted(b)]), token_sets, t, several)
        small = {int(x) for r, s, _ in cells.role(parity.SMALLER) for x in s[r == 0]}
        least = min(int(g[0]) for _, _, g in cells.role(parity.SMALLER))
        record, signature, agree = next(cells.role(parity.LARGER))
        large = {int(x) for x in signature[record == 1]}
        assert len(small & large) >= max(least, int(agree[1]))


def test_alike_nulls_repeats_empty_and_bounds(spark):
    rows = [(1, {1, 2, 3}, "x"), (2, {1, 2, 3}, "x"), (3, {1, 2, 3}, "y"), (4, set(), "z")]
    assert set(found(spark, rows, Fraction(1, 2), "alike")) == {(1, 3), (2, 3)}
    df = spark.createDataFrame([(1, [5, 5, None, 6], None), (2, [6, 5], None), (None, [5, 6], None), (3, None, None), (4, [None], None)], SETS)
    assert [tuple(r) for r in similar_pairs(df, Fraction(1, 2)).collect()] == [(1, 2, 2, 2)]
    assert similar_pairs(df.limit(0), 0.8).count() == 0
    for t in (0.3, 1.5, 1 / 3):
        with pytest.raises(ValueError):
            similar_pairs(df, t)


def test_heavy_cells(spark, monkeypatch):
    """A large group of one kind is not paired in itself; all other pairs are found."""
    monkeypatch.setattr(parity, "HEAVY", 3)
    rng = random.Random(12)
    rows = [(i, s, rng.choice(["hot", "hot", "hot", f"c{i}", None])) for i, s in enumerate(sets(rng, 150, 60, 20))]
    kind = {i: k for i, _, k in rows}
    want = {p: x for p, x in brute([r[:2] for r in rows], Fraction(1, 2)).items() if kind[p[0]] is None or kind[p[0]] != kind[p[1]]}
    df = spark.createDataFrame([(i, list(s), k) for i, s, k in rows], SETS)
    assert {(r["a"], r["b"]): (r["shared"], r["either"]) for r in similar_pairs(df, Fraction(1, 2), "alike").collect()} == want and want


def test_long_sets(spark):
    a = set(range(30_000))
    b = set(range(3_000, 31_000))
    got = found(spark, [(1, a), (2, b), (3, {7})], Fraction(4, 5))
    assert got == {(1, 2): (27_000, 31_000)}


def test_sketch_bounds_the_difference():
    rng = random.Random(1)
    for _ in range(100):
        a, b = ({rng.randrange(400) for _ in range(150)} for _ in range(2))
        record = np.r_[np.zeros(len(a), np.int64), np.ones(len(b), np.int64)]
        hashes = mix(np.array([*a, *b], np.uint64))
        bits = sketches(record, hashes, 2)
        assert sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64)) <= len(a ^ b)
        owner, signature = cells_of(record, hashes, np.zeros(len(record), np.int64))
        mine, other = set(signature[owner == 0]), set(signature[owner == 1])
        assert len(mine - other) <= len(a ^ b)
    assert band_of(np.array([1, 32, 33, 64, 65, 129])).tolist() == [0, 0, 1, 1, 2, 3]
