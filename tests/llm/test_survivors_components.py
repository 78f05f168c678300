"""Survivors, components and splits against brute force."""

import itertools
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pairloom.llm import problems
from pairloom.llm.components import assign_splits, components, share_out, stratify
from pairloom.llm.survivors import Alternatives, Bundle, branch_and_bound, consistent_records, survivors

CANDIDATES = "candidate_id long, pair string, assembly string, res double, n int, method string, at timestamp, other string"


def chosen(spark, rows):
    df = spark.createDataFrame(rows, CANDIDATES)
    res = F.col("res")
    bundles = [
        Bundle("resolution", ("res",), res.isNotNull() & ~F.isnan(res) & (res > 0) & (res < math.inf), res),
        Bundle("modeled", (), F.col("n") > 0, -F.col("n"), 0.0),
        Bundle("method", ("method",), F.col("method").rlike(r"\p{L}")),
    ]
    return survivors(df, ["pair"], "assembly", [F.col("assembly")], bundles, ["at"], "candidate_id")


def brute(rows):
    groups = {}
    for r in rows:
        if r[1] is not None:
            groups.setdefault(r[1], []).append(r)
    out = {}
    for pair, own in groups.items():
        best = None
        for a in {r[2] for r in own if r[2] is not None}:
            mine = sorted((r for r in own if r[2] == a), key=lambda r: (r[6] is not None, r[6] or datetime.min, r[0]))
            def last(ok):
                hit = [r for r in mine if ok(r)]
                return hit[-1] if hit else None

            res = last(lambda r: r[3] is not None and not math.isnan(r[3]) and 0 < r[3] < math.inf)
            n = last(lambda r: r[4] is not None and r[4] > 0)
            m = last(lambda r: any(c.isalpha() for c in r[5] or ""))
            rank = (res[3] if res else math.inf, -(n[4] if n else 0), a)
            if best is None or rank < best[0]:
                best = (rank, (pair, a, *(x[0] if x else -1 for x in (res, n, m))))
        if best:
            out[pair] = (*best[1], len(own))
    return out


def test_p2_against_brute_force(spark):
    rng = random.Random(11)
    for _ in range(3):
        rows = [
            (i, rng.choice(["p", "p", "p", "q", "r", None]), rng.choice(["A", "B", "C", "D", None]), rng.choice([None, math.nan, math.inf, -1.0, 0.0, 1.5, 2.0, 2.0]), rng.choice([None, 0, -2, 5, 7]),
             rng.choice([None, "", "?", "EM", "X"]), rng.choice([None, datetime(2020, 1, rng.randint(1, 4))]), "o")
            for i in range(300)
        ]
        got = {r["pair"]: (r["pair"], r["assembly"], r["resolution_row"], r["modeled_row"], r["method_row"], r["n"]) for r in chosen(spark, rows).collect()}
        assert got == brute(rows)


def test_p2_edges(spark):
    assert chosen(spark, []).count() == 0
    same = (1, "p", "A", 1.0, 1, "x", None, "o")
    r = chosen(spark, [same, same]).collect()
    assert len(r) == 1 and r[0]["n"] == 2
    assert chosen(spark, [(1, "p", None, 1.0, 1, "x", None, "o")]).count() == 0
    long = chosen(spark, [(1, "p", "A", 1.0, 1, "y" * 100_000, None, "o")]).first()
    assert len(long["method"]) == 100_000 and long["res"] == 1.0


def all_records(bundles):
    """The greatest trust of a consistent record, over all of them."""
    best = 0.0
    for picked in itertools.product(*[[None, *range(len(b))] for b in bundles]):
        known, good = {}, True
        for b, k in zip(bundles, picked):
            for a, v in (b[k][1] if k is not None else {}).items():
                good &= known.setdefault(a, v) == v
        if good:
            best = max(best, sum(b[k][0] for b, k in zip(bundles, picked) if k is not None))
    return best


def test_p2_branch_and_bound_against_all_records():
    rng = random.Random(6)
    fewer = 0
    for _ in range(400):
        bundles = [[(rng.randint(1, 9) + 0.5 * (k == 0), {a: rng.choice("xy") for a in rng.sample("pqr", rng.randint(0, 2))}) for k in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 5))]
        trust, picked, nodes = branch_and_bound(bundles)
        assert trust == all_records(bundles) == sum(b[k][0] for b, k in zip(bundles, picked) if k is not None)
        fewer += nodes < math.prod(len(b) + 1 for b in bundles)
    assert fewer > 300
    free = [[(5.0 - k, {}) for k in range(9)] for _ in range(8)]
    assert branch_and_bound(free)[2] < 30  # of 10**8 records


def test_p2_a_dependency_changes_the_record(spark):
    """Most rows say homo, but the accessions and species that go with them are those of two entities."""
    rows = [(1, "A,A", "homo", "U|V", "s|t"), (2, "A,A", "homo", "U|V", "s|t"), (3, "A,B", "hetero", "U|V", "s|t"), (4, "A,B", "hetero", None, None)]
    df = spark.createDataFrame([("p", "X-1", i, *r) for i, *r in rows] + [("p", "Y-1", 9, "Z,Z", "homo", "Q|Q", None)], "g string, a string, id long, pair string, kind string, acc string, sp string")
    own = [
        Alternatives("naming", ("pair", "kind"), F.col("pair").isNotNull(), lambda h, _: {"kind": h[1]}),
        Alternatives("partners", ("acc",), F.col("acc").isNotNull(), lambda h, _: {"kind": "hetero"} if len(set(h[0].split("|"))) > 1 else {}),
        Alternatives("origin", ("sp",), F.col("sp").isNotNull(), lambda h, _: {}),
    ]
    one = df.where("a = 'X-1'").select("g", "a").distinct()
    got = consistent_records(df, one, ["g"], "a", own, [], "id").collect()
    assert [tuple(r) for r in got] == [("p", "X-1", 4, "A,B", "hetero", 3, "U|V", 3, "s|t")]
    loose = [Alternatives(b.name, b.fields, b.present, lambda h, _: {}) for b in own]
    got = consistent_records(df, one, ["g"], "a", loose, [], "id").first()
    assert got["naming_row"] == 4  # two rows each: the later value
    refused = consistent_records(df, one, ["g"], "a", own, [], "id", lambda _: {"kind": "homo"}).first()
    assert refused["pair"] == "A,A" and refused["partners_row"] == -1 and refused["sp"] == "s|t"
    assert consistent_records(df.limit(0), one, ["g"], "a", own, [], "id").first()["naming_row"] == -1


def union_find(nodes, edges):
    up = {n: n for n in nodes}
    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in up}


def grouped(spark, nodes, edges):
    df = components(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "a string, b string"))
    return {r["id"]: r["group_id"] for r in df.collect()}


def test_p5_against_union_find(spark):
    rng = random.Random(2)
    names = [f"n{i:03d}" for i in range(200)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(110)] + [(names[0], x) for x in names[100:140]]
    assert grouped(spark, names, edges) == union_find(names, edges)
    path = [(names[i], names[i + 1]) for i in range(150)]
    rng.shuffle(path)
    assert grouped(spark, names, path) == union_find(names, path)


def test_p5_edges(spark):
    assert grouped(spark, [], []) == {}
    assert grouped(spark, ["b", None, "b"], [("b", "b"), (None, "a"), ("c", None), ("B", "é"), ("é", "B")]) == {"b": "b", "a": "a", "c": "c", "B": "B", "é": "B"}


def test_p5_hub_stays_in_place(spark, monkeypatch):
    monkeypatch.setattr("pairloom.operators.joins.join_heavy.__defaults__", ("n", 1))
    edges = [("hub", f"x{i:05d}") for i in range(3000)] + [(f"x{i:05d}", f"y{i:05d}") for i in range(0, 3000, 3)]
    got = grouped(spark, [], edges)
    assert set(got.values()) == {"hub"} and len(got) == 4001


def test_p5_equal_components_at_once_as_one_by_one():
    rng = random.Random(3)
    for _ in range(500):
        need = [[float(rng.randint(-20, 200)), 50.0] for _ in range(rng.randint(1, 4))]
        weight, count = float(rng.randint(1, 9)), rng.randint(0, 150)
        lowered = [list(n) for n in need]
        taken = share_out(lowered, 0, (weight, 1.0), count, (300.0, 100.0))
        assert sum(taken) == count and lowered == [[a - weight * t, b - t] for (a, b), t in zip(need, taken)]
        now = [n[0] for n in need]
        for _ in range(count):
            now[now.index(max(now))] -= weight
        assert all(abs(a - b[0]) <= 2 * weight for a, b in zip(now, lowered))  # no need is further from the greedy level than two components


def test_p5_stratify_reaches_shares():
    rng = random.Random(4)
    vectors = [tuple(v) for v in {(float(rng.randint(0, 9)), float(rng.random() < 0.1), float(rng.randint(1, 3))) for _ in range(800)}] + [(300.0, 1.0, 100.0)]
    counts = [rng.choice([1, 2, 40]) for _ in vectors[:-1]] + [1]
    shares = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]
    placed = stratify(vectors, counts, shares)
    assert [sum(p) for p in placed] == counts
    for k in range(3):
        whole = sum(v[k] * c for v, c in zip(vectors, counts))
        for s, (_, share) in enumerate(shares):
            assert abs(sum(v[k] * p[s] for v, p in zip(vectors, placed)) / whole - share) < 0.01, (k, s)


def test_p5_assign(spark):
    groups = spark.createDataFrame([(f"g{i}",) for i in range(500)] + [(None,), ("g1",)], "group_id string")
    weights = spark.createDataFrame([(f"g{i}", "a", 1 + i % 5) for i in range(500)] + [(f"g{i}", "rare", 1) for i in range(0, 500, 25)] + [("g1", None, 5), ("g1", "a", None)], "group_id string, label string, weight long")
    got = assign_splits(groups, weights, [("train", 0.8), ("test", 0.2)]).collect()
    assert len(got) == 500 and len({r["group_id"] for r in got}) == 500
    rare = [r for r in got if int(r["group_id"][1:]) % 25 == 0]
    assert sum(r["split"] == "test" for r in rare) == 4
    assert abs(sum(1 + int(r["group_id"][1:]) % 5 for r in got if r["split"] == "test") / 1500 - 0.2) < 0.01
    assert {r["split"] for r in assign_splits(groups, weights.limit(0), [("train", 0.8), ("test", 0.2)]).collect()} == {"train"}
    assert assign_splits(groups.limit(0), weights.limit(0), [("train", 1.0)]).count() == 0
    with pytest.raises(ValueError):
        assign_splits(groups, weights, [("train", 0.0)])


def test_p5_whole_tables(spark, sf):
    split = {r["cluster_id"]: (r["group_id"], r["split"]) for r in problems.p5_splits(spark, sf).collect()}
    by = {}
    for g, s in split.values():
        by.setdefault(g, set()).add(s)
    assert all(len(s) == 1 for s in by.values()) and {r["cluster_id"] for r in problems.p5_found(spark, sf).collect()} == set(split)


def test_p2_records_hold_the_values_of_their_rows(spark, sf):
    rows = {r["candidate_id"]: r for r in problems.table(spark, sf, "candidate").collect()}
    found = {(r["cluster_1"], r["cluster_2"]): r for r in problems.p2_found(spark, sf).collect()}
    records = problems.p2_records(spark, sf).collect()
    assert len(records) == len(found)
    for r in records:
        same = found[r["cluster_1"], r["cluster_2"]]
        assert all(r[k] == same[k] for k in same.asDict())
        for bundle, fields in (("resolution", ["resolution_best_angstrom"]), ("method", ["experimental_method"]), ("naming", ["entity_pair", "dimer_type"]), ("partners", ["uniprot_pair"]), ("origin", ["species_pair", "taxonomy_pair"]), ("place", ["download_url", "local_filename"])):
            row = rows.get(r[f"{bundle}_row"])
            assert row is None or (all(r[f] == row[f] for f in fields) and row["assembly_id"].upper() == r["assembly_id"])
