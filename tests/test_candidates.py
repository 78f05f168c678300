"""Candidate derivation: fixtures derived by hand."""

import json

import pytest

from pairloom.operators.candidates import base_columns, candidates, derive, rejects
from pairloom.operators.representatives import select_representatives
from pairloom.plans.curation import curate
from pairloom.schemas import CANDIDATE_COLUMNS


def entity(id="1ABC_1", chains="A", type="Protein", **more):
    return {"rcsb_id": id, "entity_poly": {"rcsb_entity_polymer_type": type}, "rcsb_polymer_entity_container_identifiers": {"asym_ids": chains}} | more


def member(cutoff, group, method="sequence_identity"):
    return {"aggregation_method": method, "similarity_cutoff": cutoff, "group_id": group}


def doc(id="1abc-1", entities=None, gens=None, info=None, resolution=None, method=None, **more):
    entities = [entity()] if entities is None else entities
    return {
        "rcsb_id": id,
        "rcsb_assembly_info": info or {"polymer_entity_instance_count": 2, "polymer_entity_instance_count_protein": 2},
        "pdbx_struct_assembly_gen": [{"asym_id_list": "A,B"}] if gens is None else gens,
        "entry": {"rcsb_entry_info": {"resolution_combined": resolution, "experimental_method": method}, "polymer_entities": entities},
    } | more


@pytest.fixture(scope="module")
def run(spark):
    def go(*docs):
        rows = [(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)]
        out = derive(spark.createDataFrame(rows, "n int, payload string"), files_base="http://files.example/x/").orderBy("n").collect()
        return [r.asDict() for r in out]

    return go


def test_m1_ids(run):
    a, b, c, d = run(doc("1abc-2"), doc("a-b-3"), doc("nodash"), doc(None))
    assert (a["pdb_id"], a["assembly_number"]) == ("1ABC", "2") and (b["pdb_id"], b["assembly_number"]) == ("A-B", "3")
    assert c["reject"] == d["reject"] == "no_id"
    assert a["local_filename"] == "1abc-assembly2.cif.gz" and a["download_url"] == "http://files.example/x/1abc-assembly2.cif.gz"


def test_m2_h4_h15_resolution(run):
    got = [r["rank_resolution"] for r in run(*[doc(resolution=x) for x in ([2.5, None, 1.9], [], None, 1.8, 0, ["x"], "1.5", ["2.25"], [0, 3])])]
    inf = float("inf")
    assert got == [1.9, inf, inf, 1.8, inf, inf, inf, 2.25, 0.0]


def test_m16_infinity_is_empty(run):
    assert run(doc(resolution=None))[0]["resolution_best_angstrom"] is None


def test_m3_method(run):
    assert [r["experimental_method"] for r in run(doc(method="X-ray"), doc(method=["EM", None, "NMR"]), doc(method=None), doc(method=["A", "A"]))] == ["X-ray", "EM;NMR", "", "A;A"]


def test_m4_chain_lists(run):
    for gens in ([{"asym_id_list": " A, B,,C "}], [{"asym_id_list": ["A,B", "C"]}], [{"asym_id_list": [["A"], ["B", "C"]]}]):
        r = run(doc(entities=[entity("E_1", "A"), entity("E_2", ["C"])], gens=gens))[0]
        assert r["entity_pair"] == "E_1,E_2"
    assert run(doc(gens=[{"asym_id_list": None}]))[0]["reject"] == "entity_count"


def test_m5_h7_cutoff(run):
    groups = [member(95, "g1"), member("100.0", "g2"), member(100.0, "g3"), member(100, "g4")]
    r = run(doc(entities=[entity(rcsb_polymer_entity_group_membership=groups)]))[0]
    assert r["cluster_pair_100pct"] == "g3,g3"
    r = run(doc(entities=[entity(rcsb_polymer_entity_group_membership=[member("100", "g"), member(100, "h")])]))[0]
    assert r["cluster_pair_100pct"] == "g,g"
    r = run(doc(entities=[entity(rcsb_polymer_entity_group_membership=[member(100.9, "t", "other"), member(100.9, "g")])]))[0]
    assert r["cluster_pair_100pct"] == "g,g"


def test_m6_singleton(run):
    assert run(doc())[0]["cluster_pair_100pct"] == "singleton:1ABC_1,singleton:1ABC_1"
    assert run(doc(entities=[entity(id=None)]))[0]["reject"] == "entity_count"  # an entity without id takes no part


def test_m7_accessions(run):
    own = [{"rcsb_id": "P2"}, {"rcsb_uniprot_container_identifiers": {"uniprot_id": "P1"}}]
    refs = {"asym_ids": "A", "reference_sequence_identifiers": [{"database_name": "UniProt", "database_accession": "Q9"}, {"database_name": "GenBank", "database_accession": "Z"}]}
    a, b = run(doc(entities=[entity(uniprots=own)]), doc(entities=[entity(uniprots=[], rcsb_polymer_entity_container_identifiers=refs)]))
    assert (a["uniprot_1"], a["uniprot_pair"], b["uniprot_1"]) == ("P1;P2", "P1;P2|P1;P2", "Q9")


def test_m8_organisms(run):
    orgs = [{"ncbi_taxonomy_id": 9606, "ncbi_scientific_name": "b"}, {"ncbi_taxonomy_id": [10090, 0], "ncbi_scientific_name": ["a", "", None]}, None]
    r = run(doc(entities=[entity(rcsb_entity_source_organism=orgs)]))[0]
    assert (r["taxonomy_1"], r["species_1"]) == ("10090;9606", "a;b")


def hetero():
    return [entity("X_1", "A", rcsb_polymer_entity_group_membership=[member(100, "c9")]), entity("X_2", "B", rcsb_polymer_entity_group_membership=[member(100, "c1")])]


def test_m9_h10_pairs(run):
    r = run(doc(entities=hetero()))[0]
    assert (r["dimer_type"], r["entity_pair"], r["cluster_pair_100pct"], r["entity_clusters"]) == ("hetero", "X_1,X_2", "c1,c9", "c9,c1")


def test_m14_counts(run):
    def info(a, b):
        return {"polymer_entity_instance_count": a, "polymer_entity_instance_count_protein": b}

    got = [r["reject"] for r in run(doc(info=info(2, None)), doc(info=info(3, 2)), doc(info=info("2", 2)), doc(info=info(2.0, 2)))]
    assert got == ["instance_count", "instance_count", "instance_count", None]


def test_m15_h20_last_entity_wins(run):
    r = run(doc(entities=[entity("E_1", "A,B"), entity("E_2", "B")], gens=[{"asym_id_list": "B"}]))[0]
    assert r["entity_pair"] == "E_2,E_2" and r["dimer_type"] == "homo"


def test_h16_null_elements(run):
    r = run(doc(entities=[None, entity()], gens=[None, {"asym_id_list": ["A", None]}]))[0]
    assert r["reject"] is None


def test_f6_f7_type_and_count(run):
    a, b = run(doc(entities=[entity(type="DNA")]), doc(entities=[entity("E_1", "A"), entity("E_2", "B"), entity("E_3", "C")], gens=[{"asym_id_list": "A,B,C"}]))
    assert a["reject"] == b["reject"] == "entity_count"


def test_unreadable_empty_and_extra_columns(spark, run):
    assert [r["reject"] for r in run("{", None, "", "[1]", "3")] == ["unreadable"] * 5
    rows = spark.createDataFrame([(json.dumps(doc()), "x", "y")], "payload string, pdb_id string, other string")
    r = derive(rows).first()
    assert r["pdb_id"] == "1ABC" and r["other"] == "y"
    assert derive(spark.createDataFrame([], "payload string")).count() == 0


def test_p10_defaults(run):
    info = {"polymer_entity_instance_count": 2, "polymer_entity_instance_count_protein": 2, "modeled_polymer_monomer_count": 77}
    a, b = run(doc(info=info, pdbx_struct_assembly={"oligomeric_count": 2}), doc(pdbx_struct_assembly={"oligomeric_count": 0}))
    assert (a["modeled_polymer_monomer_count"], a["oligomeric_count"], b["modeled_polymer_monomer_count"], b["oligomeric_count"]) == (77, "2", 0, "")


def chosen(spark, rows):
    names = ["pdb_id", "assembly_number", "cluster_pair_100pct", "resolution_best_angstrom", "modeled_polymer_monomer_count"]
    df = spark.createDataFrame(rows, "pdb_id string, assembly_number string, cluster_pair_100pct string, resolution_best_angstrom double, modeled_polymer_monomer_count int")
    return [tuple(r) for r in select_representatives(df).select(*names).collect()]


def test_m11_m12_h14_h15_rank(spark):
    assert chosen(spark, [("A", "1", "p", 2.0, 100), ("B", "1", "p", 2.0, 150), ("C", "1", "p", None, 900), ("D", "1", "p", float("nan"), 999)])[0][0] == "B"
    assert chosen(spark, [("A", "2", "p", 2.0, 1), ("A", "10", "p", 2.0, 1)])[0][1] == "10"
    assert len(chosen(spark, [("A", "1", "p", 2.0, 1)] * 3)) == 1
    assert chosen(spark, []) == []


def test_m13_h13_homo_and_hetero_compete(spark):
    same = [member(100, "c1")]
    two = [entity("Y_1", "A", rcsb_polymer_entity_group_membership=same), entity("Y_2", "B", rcsb_polymer_entity_group_membership=same)]
    docs = [doc("1AAA-1", entities=[entity("Z_1", "A,B", rcsb_polymer_entity_group_membership=same)], resolution=3.0), doc("1BBB-1", entities=two, resolution=2.0)]
    out = curate(spark.createDataFrame([(json.dumps(d),) for d in docs], "payload string"))
    assert [r["dimer_type"] for r in out.selected.collect()] == ["hetero"]
    assert out.candidates.columns[:21] == CANDIDATE_COLUMNS and out.rejects.count() == 0


def test_plan_of_representatives(spark, sf):
    """The group limit works before the shuffle, and nothing is a cartesian product."""
    from pairloom.plans.analogues import q12_representatives

    plan = q12_representatives(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Cartesian" not in plan and "NestedLoop" not in plan


def test_base_columns_and_rejects(spark):
    d = derive(spark.createDataFrame([(json.dumps(doc()),), ("x",)], "payload string"))
    assert len(base_columns(candidates(d)).columns) == 12 and rejects(d).count() == 1
