"""Mixes: shares, limits and the flow."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom.llm import problems
from pairloom.llm.mixing import PART, TOKENIZER, encoder, measure, mix, parts, solve, source_name, targets_of


def test_names(spark):
    df = spark.createDataFrame([(" Review Articles ",), ("review-articles",), ("REVIEW_ARTICLES",), (None,)], "s string")
    assert [r[0] for r in df.select(source_name(F.col("s"))).collect()] == ["review_articles"] * 3 + [None]


def test_parts_keep_tokens():
    encode = encoder(TOKENIZER).encode_ordinary
    text = "The chain binds the lattice near residue 45, as Dr. Orlinde wrote. " * 4000
    assert len(text) > 2 * PART and len(parts(text)) > 2 and "".join(parts(text)) == text
    assert [t for p in parts(text) for t in encode(p)] == encode(text)
    assert parts("x" * (2 * PART + 5)) and "".join(parts("x" * (2 * PART + 5))) == "x" * (2 * PART + 5)


def check(plan, capacity, shares, repeats):
    for s in range(len(shares)):
        assert abs(sum(f for (p, t), f in plan.flows.items() if t == s) - plan.total * shares[s]) <= 1
    for p, t in capacity.items():
        assert sum(f for (q, _), f in plan.flows.items() if q == p) <= t * min(repeats[s] for s in p)


def test_solve_overlapping():
    capacity = {(0,): 1000, (1,): 10, (0, 1): 90}
    plan = solve(capacity, [0.5, 0.5], [1, 2])
    check(plan, capacity, [0.5, 0.5], [1, 2])
    assert plan.total == 220  # source 1: twice its 10 and the 90 that may be used once


def test_solve_is_maximal():
    rng = random.Random(5)
    for _ in range(20):
        k = rng.randint(2, 4)
        capacity = {}
        for _ in range(rng.randint(2, 6)):
            capacity[tuple(sorted(rng.sample(range(k), rng.randint(1, k))))] = rng.randint(1, 500)
        raw = [rng.random() + 0.1 for _ in range(k)]
        usable = {s for p in capacity for s in p}
        shares = [x / sum(raw[s] for s in usable) if s in usable else 0.0 for s, x in enumerate(raw)]
        repeats = [rng.randint(1, 3) for _ in range(k)]
        plan = solve(capacity, raw, repeats)
        for s in usable:
            assert abs(sum(f for (_, t), f in plan.flows.items() if t == s) - plan.total * shares[s]) <= k + 1
        # by the max-flow min-cut theorem some set of sources binds
        best = min(
            sum(t * min(repeats[s] for s in p) for p, t in capacity.items() if m & sum(1 << s for s in p)) / sum(shares[s] for s in usable if m >> s & 1)
            for m in range(1, 1 << k) if any(m >> s & 1 for s in usable)
        )
        assert best - k - 2 <= plan.total <= best + k + 1  # quotas are whole tokens


def test_solve_edges():
    assert solve({}, [1.0], [1]).total == 0 and solve({(0,): 5}, [1.0], [0]).total == 0
    assert solve({(0,): 5}, [0.5, 0.5], [3, 1]).total == 15  # the other source has nothing
    assert solve({(0,): 50}, [1.0], [1], total=20).total == 20


DOCS = "doc_id long, text string, source string, tokens string"


def mixed(spark, docs, targets, **more):
    return mix(measure(spark.createDataFrame(docs, DOCS), "doc_id", "text", "source").cache(), targets, **more)


def test_mix_shares_and_limits(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(5, 40))) + f" {i}", rng.choice(["A", "a ", "b", "b", "b"]), "t") for i in range(900)]
    docs += [(1000 + i, docs[i][1], "small-one", "t") for i in range(40)]
    targets = [("a", 0.4, 1), ("b", 0.4, 2), ("small_one", 0.2, 3)]
    got = mixed(spark, docs, targets).collect()
    size = {s: sum(r["uses"] * r["tokens"] for r in got if r["source"] == s) for s, _, _ in targets}
    whole = sum(size.values())
    for s, share, limit in targets:
        assert abs(size[s] / whole - share) < 0.02
        assert max(r["uses"] for r in got if r["source"] == s) <= limit
    text = {d: t for d, t, *_ in docs}
    uses = {}
    for r in got:
        uses[text[r["doc_id"]]] = uses.get(text[r["doc_id"]], 0) + r["uses"]
    limits = {"a": 1, "b": 2, "small_one": 3}
    for t, n in uses.items():
        assert n <= min(limits[s.strip().lower().replace("-", "_")] for _, x, s, _ in docs if x == t)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixed(spark, list(reversed(docs)), targets).collect()))
    assert sorted(map(tuple, got)) != sorted(map(tuple, mixed(spark, docs, targets, seed=3).collect()))


def test_mix_edges(spark):
    targets = [("a", 0.5, 2), ("none", 0.5, 2)]
    assert mixed(spark, [], targets).count() == 0 and mixed(spark, [(1, "x", "a", None)], []).count() == 0
    assert mixed(spark, [(None, "x", "a", None), (1, None, "a", None), (2, "", "a", None), (3, "x", None, None), (4, "x", "other", None)], targets).count() == 0
    got = mixed(spark, [(5, "same", "a", None), (4, "same", "a", None), (4, "same", "a", None)], targets).collect()
    assert [(r["doc_id"], r["uses"]) for r in got] == [(4, 2)]


def test_too_many_patterns_are_refused(spark, monkeypatch):
    docs = [(i, f"text {i % 50}", s, None) for i, s in enumerate(["a", "b", "c"] * 100)] + [(900 + i, f"own {s} {i}", s, None) for i, s in enumerate(["a", "b", "c"] * 30)]
    targets = [("a", 0.3, 1), ("b", 0.3, 1), ("c", 0.4, 1)]
    assert len({r["source"] for r in mixed(spark, docs, targets).collect()}) == 3
    monkeypatch.setattr("pairloom.llm.mixing.MAX_PATTERNS", 2)
    with pytest.raises(ValueError):
        mixed(spark, docs, targets)


@pytest.mark.parametrize("k", [3, 6, 10])
def test_flow_against_the_cuts(k):
    """Total and cost by the theorem of greatest flow and least cut, over all sets of sources; 1,023 patterns with ten sources."""
    rng = random.Random(k)
    for _ in range(4):
        chosen = [m for m in range(1, 1 << k) if k > 6 or rng.random() < 0.7] or [1]
        capacity = {tuple(s for s in range(k) if m >> s & 1): rng.randint(1, 400) for m in chosen}
        capacity[(0,)] = 1  # a source that binds
        repeats = [rng.randint(1, 4) for _ in range(k)]
        usable = sorted({s for p in capacity for s in p})
        raw = [rng.random() + 0.05 for _ in range(k)]
        raw[0] *= 20
        whole = sum(raw[s] for s in usable)
        plan = solve(capacity, raw, repeats)
        masks = {p: sum(1 << s for s in p) for p in capacity}
        held = [[0] * (1 << k) for _ in range(max(repeats) + 1)]  # by uses: tokens of the patterns within a set
        for p, t in capacity.items():
            for uses in range(max(repeats) + 1):
                held[uses][masks[p]] += t * min(uses, *(repeats[s] for s in p))
        for row in held:
            for s in range(k):
                for m in range(1 << k):
                    if m >> s & 1:
                        row[m] += row[m ^ 1 << s]
        everything = (1 << k) - 1

        def flow(uses, quotas):
            sums = [0] * (1 << k)
            for m in range(1, 1 << k):
                low = m & -m
                sums[m] = sums[m ^ low] + quotas[low.bit_length() - 1]
            return min(sums[m] + held[uses][everything] - held[uses][m] for m in range(1 << k))

        def quotas(total):
            return [int(raw[s] / whole * total) if s in usable else 0 for s in range(k)]

        low, high = 0, sum(t * min(repeats[s] for s in p) for p, t in capacity.items())
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if flow(-1, quotas(middle)) == sum(quotas(middle)) else (low, middle - 1)
        assert plan.total == sum(quotas(low)) > 0
        assert [sum(f for (_, s), f in plan.flows.items() if s == x) for x in range(k)] == quotas(low)
        by_use = [flow(uses, quotas(low)) for uses in range(max(repeats) + 1)]
        cost = 0
        for p, t in capacity.items():
            sent = sum(f for (q, _), f in plan.flows.items() if q == p)
            assert sent <= t * min(repeats[s] for s in p)
            cost += sum(use * max(0, min(t, sent - use * t)) for use in range(max(repeats)))
        assert cost == sum(use * (by_use[use + 1] - by_use[use]) for use in range(max(repeats)))


def test_flow_of_many_patterns_ends_soon():
    rng = random.Random(1)
    capacity = {tuple(sorted(rng.sample(range(40), rng.randint(1, 6)))): rng.randint(1, 10**9) for _ in range(15_000)}
    plan = solve(capacity, [rng.random() + 0.01 for _ in range(40)], [rng.randint(1, 8) for _ in range(40)])
    assert plan.total > 0


def test_targets(spark):
    df = spark.createDataFrame([("A b", 0.2, 3), ("a-b", 0.3, 2), ("c", None, 1), ("d", 0.5, None), (None, 0.1, 1), ("e", 0.0, 1)], "source string, target_share double, max_repeats int")
    assert targets_of(df, "source", "target_share", "max_repeats") == [("a_b", 0.5, 2), ("d", 0.5, 1)]
    with pytest.raises(ValueError):
        targets_of(spark.range(99).selectExpr("concat('s', id) s", "1.0 w", "1 r"), "s", "w", "r")


def test_p7_report(spark):
    rows = {r["source"]: r for r in problems.p7_shares(spark, "/root/testdata/sf0.01").collect()}
    there = {s: r for s, r in rows.items() if r["tokens"]}
    whole = sum(r["target_share"] for r in there.values())
    assert len(rows) == 9 and rows["patent_claims"]["tokens"] == 0
    assert all(abs(r["share"] - r["target_share"] / whole) < 0.02 and r["most_uses"] <= r["max_repeats"] for r in there.values())
