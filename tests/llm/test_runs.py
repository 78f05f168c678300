"""Similar sequences by common runs: the bound, and the pairs against all pairs."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from pairloom.llm import problems, runs
from pairloom.llm.parity import similar_pairs

LETTERS, TAG = "ACDEFGHIKLMNPQRSTVWY", "MGSSHHHHHHSSGLVPRGSH"
HALF = Fraction(1, 2)


def windows(s, k=5):
    return {s[i : i + k] for i in range(len(s) - k + 1) if "X" not in s[i : i + k]}


def changed(rng, s, letters, most):
    s = list(s)
    for _ in range(rng.randint(1, max(1, most))):
        i, kind = rng.randrange(len(s) + 1), rng.random()
        if kind < 0.5 and i < len(s):
            s[i] = rng.choice(letters + "X")
        elif kind < 0.7 and len(s) > 12:
            del s[i : i + rng.randint(1, 6)]
        elif kind < 0.85:
            s[i:i] = [rng.choice(letters) for _ in range(rng.randint(1, 8))]
        else:
            j = rng.randrange(len(s))
            s[i:i] = s[j : j + rng.randint(4, 20)]
    return "".join(s)


def test_common_runs_are_at_least_so_many():
    rng, regular = random.Random(3), 0
    for _ in range(6_000):
        letters, size = LETTERS[: rng.choice([2, 3, 6, 20, 20])], rng.choice([8, 12, 20, 40, 80, 200])
        a = "".join(rng.choice(letters) for _ in range(size))
        a, b = sorted((a, changed(rng, a, letters, size // 12)), key=lambda s: len(windows(s)))
        shared = len(windows(a) & windows(b))
        if not windows(a) or 2 * shared < len(windows(a) | windows(b)):
            continue
        _, _, n, own, partner = runs.runs(pa.array([a, b]))
        assert n.tolist() == [len(windows(a)), len(windows(b))]
        common = len(windows(a, 7) & windows(b, 7))
        assert common >= 2 * shared - n[0] - own[0] - partner[1]
        agree = runs.least(n, own, partner, HALF)
        if agree.all():
            regular += 1
            assert common >= agree.max()
    assert regular > 500


@pytest.mark.parametrize("letters", [LETTERS, LETTERS[:4]])
def test_pairs_of_sequences(spark, monkeypatch, letters):
    """Regular and irregular ones, of a kind and not, and a tag that many have."""
    monkeypatch.setattr(runs, "PAIRS", 100)
    rng, rows = random.Random(5), {}
    while len(rows) < 160:
        if rows and rng.random() < 0.7:
            old = rng.choice(sorted(rows))
            s = changed(rng, old, letters, len(old) // 16)
        else:
            s = (TAG if rng.random() < 0.4 else "") + "".join(rng.choice(letters) for _ in range(rng.choice([6, 10, 20, 60, 150, 300])))
        rows[s] = rng.choice([None, None, "x", "y"])
    rows = list(rows.items())
    _, _, n, own, partner = runs.runs(pa.array([s for s, _ in rows]))
    assert 0 < np.count_nonzero(runs.least(n, own, partner, HALF)) < len(rows)
    sets = [windows(s) for s, _ in rows]
    want = {
        (i, j): (len(sets[i] & sets[j]), len(sets[i] | sets[j]))
        for j in range(len(rows))
        for i in range(j)
        if sets[i] and 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j]) and (rows[i][1] is None or rows[i][1] != rows[j][1])
    }
    df = spark.createDataFrame([(i, s, kind) for i, (s, kind) in enumerate(rows)], "id long, sequence string, kind string")
    got = similar_pairs(df, HALF, "kind", column="sequence", read=problems.windows, runs=runs.runs)
    assert {(r["a"], r["b"]): (r["shared"], r["either"]) for r in got.collect()} == want and len(want) > 50


def test_unrelated_sequences_shuffle_little(spark, tmp_path):
    """Sequences that share windows by chance only, and often, as large tables do: p3_found's shuffles hold less than twelve times their letters."""
    rng = np.random.default_rng(7)
    rows = [(i, f"c{i}", "".join(rng.choice(list(LETTERS[:10]), 64))) for i in range(20_000)]
    spark.createDataFrame(rows, "row_id long, cluster_id string, sequence string").write.parquet(f"{tmp_path}/entity_sequences.parquet")

    def written():
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(spark._jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = written()
    assert problems.p3_found(spark, str(tmp_path)).count() == 0
    assert sum(n for k, n in written().items() if k not in before) < 12 * 64 * len(rows)
