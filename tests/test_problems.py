"""Nested records and packed fields: brute force, round trips and edge cases."""

import json
import math
import random
from collections import Counter

import pytest

from pairloom.operators.packed import MULTI, PAIR, Field, pair_columns, posterior, unpack, values, viterbi
from pairloom.operators.shredding import Child, child_keys, entity_table, needed_paths, shred, unreadable, walk
from pairloom.plans import problems


def brute_children(payload):
    """What p1_found gives of one payload, written down directly."""
    try:
        top = json.loads(payload)
    except (TypeError, ValueError):
        return
    def several(x):
        return x if isinstance(x, list) else [x]

    def text(x):
        return None if x is None or isinstance(x, (dict, list)) else str(x)

    for x in top["data"]["assemblies"] if isinstance(top, dict) and "data" in top else [top]:
        if not isinstance(x, dict):
            continue
        for i, e in enumerate(several((x.get("entry") or {}).get("polymer_entities"))):
            if isinstance(e, dict):
                yield "entity", 0, i, text(e.get("rcsb_id"))
                for name, field, key in (("membership", "rcsb_polymer_entity_group_membership", "group_id"), ("organism", "rcsb_entity_source_organism", "ncbi_taxonomy_id")):
                    for j, m in enumerate(several(e.get(field))):
                        if isinstance(m, dict):
                            for v in several(m.get(key)):
                                yield name, i, j, text(v)
        for i, g in enumerate(several(x.get("pdbx_struct_assembly_gen"))):
            if isinstance(g, dict):
                tokens = [t.strip() for v in several(g.get("asym_id_list")) if v is not None for t in str(v).split(",") if t.strip()]
                for j, t in enumerate(tokens):
                    yield "gen", i, j, t


def test_p1_against_brute_force(spark, sf):
    want = Counter()
    for r in problems.table(spark, sf, "assembly").collect():
        want.update((r["landing_id"], *x) for x in brute_children(r["payload"]) if x[3] and x[3].strip())
    got = Counter(tuple(r) for r in problems.p1_found(spark, sf).select("landing_id", "child", "parent_pos", "child_pos", "key_text").collect())
    assert got == want and sum(got.values()) > 300


def test_walk_numbers_and_envelope():
    rows = list(walk({"d": {"x": [{"a": 1}, None, {"a": "t"}]}}, ("d", "x")))
    assert [(r[0], r[1], r[2], r[3], r[5], r[6], r[7]) for r in rows] == [
        (0, -1, -1, "", 0, "object", None), (1, 0, 0, "a", 0, "string", "1"), (2, -1, -1, "", 1, "null", None), (3, -1, -1, "", 2, "object", None), (4, 3, 3, "a", 0, "string", "t"),
    ]


KINDS = [Child("e", "x.es", "id"), Child("m", "x.es.ms", "g", "x.es"), Child("t", "gs", "l", tokens=True)]


def children(spark, rows, **more):
    df = spark.createDataFrame(rows, "k long, p string, doc string, node string")
    return sorted(tuple(r) for r in child_keys(shred(df, "k", "p", **more), KINDS).collect())


def test_p1_shapes(spark):
    p = {"x": {"es": [{"id": "a", "ms": {"g": 7}}, None, {"id": " ", "ms": [{"g": ["u", None, "v"]}, {"g": ""}]}]}, "gs": {"l": ["A, B", None, ["C"]]}}
    got = children(spark, [(1, json.dumps(p), "d", "n")])
    assert got == [(1, "e", 0, 0, "a"), (1, "m", 0, 0, "7"), (1, "m", 2, 0, "u"), (1, "m", 2, 0, "v"), (1, "t", 0, 0, "A"), (1, "t", 0, 1, "B"), (1, "t", 0, 2, "C")]


def test_p1_nulls_repeats_empty_and_deep(spark):
    good = json.dumps({"x": {"es": [{"id": "a"}]}})
    deep = "[" * 100_000
    rows = [(1, good, None, None), (1, good, None, None), (None, good, None, None), (2, None, None, None), (3, "", None, None), (4, "{", None, None), (5, deep, None, None), (6, "[]", None, None), (7, "3", None, None)]
    assert children(spark, rows) == [(1, "e", 0, 0, "a")]
    assert children(spark, []) == []
    df = spark.createDataFrame(rows, "k long, p string, a string, b string")
    assert sorted(r["doc"] for r in unreadable(df, "k", "p").collect()) == [2, 3, 4, 5]
    long = json.dumps({"x": {"es": [{"id": "z" * 200_000}]}})
    assert len(children(spark, [(9, long, None, None)])[0][4]) == 200_000


def test_p1_entity_table(spark):
    p = {"x": {"es": [{"id": "a", "in": {"deep": {"v": 3}}, "many": [1, None, "2"]}, {"other": 1}]}}
    df = spark.createDataFrame([(1, json.dumps(p))], "k long, p string")
    rows = entity_table(shred(df, "k", "p"), "x.es", {"id": "id", "v": "in.deep.v", "many": "many"}).orderBy("pos").collect()
    assert [(r["pos"], r["id"], r["v"], r["many"]) for r in rows] == [(0, "a", "3", "1;2"), (1, None, None, None)]
    assert needed_paths(KINDS) == {"x.es", "x.es.id", "x.es.ms", "x.es.ms.g", "gs", "gs.l"}


def split(text, mode):
    return list(values(text, mode, lambda _: None))


@pytest.mark.parametrize(
    "text, want",
    [
        (" A\t, B\xa0", [(1, 1, "A"), (2, 1, "B")]), ('"A_1, B_2"', [(1, 1, "A_1"), (2, 1, "B_2")]), ('["A", "B"]', [(1, 1, "A"), (2, 1, "B")]),
        ("'A'; 'B'", [(1, 1, "A"), (2, 1, "B")]), ("A B", [(1, 1, "A"), (2, 1, "B")]), ("A\tB", [(1, 1, "A"), (2, 1, "B")]), ("A，B", [(1, 1, "A"), (2, 1, "B")]),
        ("A;", [(1, 1, "A")]), (",B", [(2, 1, "B")]), ("-,B", [(2, 1, "B")]), (" , ", []), ("-", []), ("", []), (None, []), ("A, ?", [(1, 1, "A")]),
        ("A,B,C", [(1, 1, "A"), (2, 1, "B"), (2, 2, "C")]), ("A,,B", [(1, 1, "A"), (2, 1, "B")]), ('"A"|"B"', [(1, 1, "A"), (2, 1, "B")]), ('"A" "B"', [(1, 1, "A"), (2, 1, "B")]),
    ],
)
def test_p4_pairs(text, want):
    assert split(text, PAIR) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("a;b|c", [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]), ('["a","b"]｜c,', [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]), ("a + b |  c//d", [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (2, 2, "d")]),
        ("|", []), ("| a", [(2, 1, "a")]), ('x y; "L (s T; c)" | z', [(1, 1, "x y"), (1, 2, "L (s T; c)"), (2, 1, "z")]), ('"D ""m"" a";|B o\'k', [(1, 1, 'D "m" a'), (2, 1, "B o'k")]),
        ('a; "v|6"|b', [(1, 1, "a"), (1, 2, "v|6"), (2, 1, "b")]), ("a;;b¦", [(1, 1, "a"), (1, 2, "b")]), ('"open|b', [(1, 1, '"open'), (2, 1, "b")]),
    ],
)
def test_p4_sides(text, want):
    assert split(text, MULTI) == want


def test_p4_round_trip():
    """Packed by random rules and unpacked again."""
    rng = random.Random(3)
    alphabet = "abcXYZ019é漢"
    for _ in range(600):
        sides = [["".join(rng.choices(alphabet, k=rng.randint(1, 6))) for _ in range(rng.randint(0, 3))] for _ in range(2)]
        def pack(side):
            if side and rng.random() < 0.2:
                return "[" + rng.choice([",", ", "]).join(f'"{v}"' for v in side) + "]"
            sep = rng.choice([";", ",", "; ", " / ", " + ", ", ", " ;"])
            out = []
            for v in side:
                if rng.random() < 0.3:
                    v = f'"{v}"'
                out.append(v)
            return sep.join(out) + (rng.choice(["", "", sep]) if side else "")

        bar = rng.choice(["|", " | ", "¦", "｜", "|  "])
        text = pack(sides[0]) + bar + pack(sides[1])
        want = [(s, n, v) for s, side in enumerate(sides, 1) for n, v in enumerate(side, 1)]
        assert split(text, MULTI) == want, text


FIELDS = [Field("t", "f", "k", MULTI)]


def unpacked(spark, rows, fields=FIELDS, schema="k long, f string, value string, side_no string"):
    return sorted((r["row_id"] if r["row_id"] is not None else -1, r["side_no"], r["value_no"], r["part_value"]) for r in unpack({"t": spark.createDataFrame(rows, schema)}, fields).collect())


def test_p4_contested_by_the_column(spark):
    """A separator inside a value that the column knows as quoted does not cut; unknown ones do."""
    rows = [(i, '"Galvia dorosa, subgroup 7"|x', None, None) for i in range(30)] + [(100, "Galvia dorosa, subgroup 7;y|z", None, None), (101, "Galvia dorosa, subgroup 8|z", None, None)]
    got = unpacked(spark, rows)
    assert [x[1:] for x in got if x[0] == 100] == [(1, 1, "Galvia dorosa, subgroup 7"), (1, 2, "y"), (2, 1, "z")]
    assert [x[1:] for x in got if x[0] == 101] == [(1, 1, "Galvia dorosa"), (1, 2, "subgroup 8"), (2, 1, "z")]


def test_p4_white_space_contested(spark):
    """White space cuts where all parts are frequent values and the whole is not."""
    rows = [(i, f"P1;P2|P{i % 3}", None, None) for i in range(60)] + [(100, "P1 P2|P0", None, None)] + [(i, "Fen sicba|Fen alta", None, None) for i in range(200, 260)]
    got = unpacked(spark, rows)
    assert [x[1:] for x in got if x[0] == 100] == [(1, 1, "P1"), (1, 2, "P2"), (2, 1, "P0")]
    assert [x[1:] for x in got if x[0] == 200] == [(1, 1, "Fen sicba"), (2, 1, "Fen alta")]


def test_p4_joined_decisions_equal_sent_ones(spark, monkeypatch):
    rows = [(i, '"a, b"|x', None, None) for i in range(9)] + [(50, "a, b;c|y", None, None), (51, "d|e;f", None, None)]
    sent = unpacked(spark, rows)
    monkeypatch.setattr("pairloom.operators.packed.BROADCAST_ROWS", 0)
    assert unpacked(spark, rows) == sent and (50, 1, 1, "a, b") in sent


def test_p4_nulls_repeats_empty_long(spark):
    assert unpacked(spark, [(None, "a|b", None, None), (1, None, None, None), (2, "a", "v", "s"), (2, "a", "v", "s")]) == [(-1, 1, 1, "a"), (-1, 2, 1, "b"), (2, 1, 1, "a"), (2, 1, 1, "a")]
    assert unpacked(spark, []) == []
    assert len(unpacked(spark, [(1, ";".join(f"v{i}" for i in range(3000)) + "|x", None, None)])) == 3001


def test_p4_whole_table(spark, sf):
    got = problems.p4_found(spark, sf).collect()
    assert len(got) > 1000 and {r["side_no"] for r in got} == {1, 2} and all(r["part_value"] == r["part_value"].strip() for r in got)


def test_pair_columns(spark):
    df = spark.createDataFrame([(1, "A, B"), (2, None), (3, ",B")], "k int, pair string")
    assert [tuple(r) for r in pair_columns(df, "pair").orderBy("k").collect()] == [(1, "A, B", "A", "B"), (2, None, None, None), (3, ",B", None, "B")]


def test_lattice_paths():
    segments = [(0, 0, math.log(0.5)), (1, 1, math.log(0.5)), (0, 1, math.log(0.75))]
    assert viterbi(segments) == [(0, 1)]
    assert [round(p, 6) for p in posterior(segments)] == [0.25, 0.25, 0.75]
    assert viterbi([]) == []


def rebuilt(nodes):
    """The payload that the rows of one document came from."""
    made, top = {}, None
    for r in sorted(nodes, key=lambda r: r["node"]):
        value = {"object": dict, "array": list}.get(r["kind"], lambda s=r["scalar"]: s)()
        made[r["node"]] = value
        above = made.get(r["parent"])
        if above is None:
            top = value
        elif isinstance(above, dict):
            above[r["label"]] = value
        else:
            assert len(above) == r["ordinal"]
            above.append(value)
    return top


def test_p1_round_trip(spark, sf):
    """The adjacency table holds the whole document: it can be built again from it."""
    docs = problems.table(spark, sf, "assembly").select("landing_id", "payload").collect()
    rows = {}
    for r in problems.p1_nodes(spark, sf).collect():
        rows.setdefault(r["landing_id"], []).append(r)

    def as_text(x):
        if isinstance(x, dict):
            return {k: as_text(v) for k, v in x.items()}
        if isinstance(x, list):
            return [as_text(v) for v in x]
        return x if x is None or isinstance(x, str) else ("true" if x else "false")

    whole = 0
    for d in docs:
        try:
            value = json.loads(d["payload"], parse_int=str, parse_float=str)
        except (TypeError, ValueError):
            assert d["landing_id"] not in rows
            continue
        value = value["data"]["assemblies"][0] if isinstance(value, dict) and "data" in value else value
        assert rebuilt(rows[d["landing_id"]]) == as_text(value)
        whole += 1
    assert whole > 40
