"""Structure files, sequences, masks, FASTA and profiles: fixtures derived by hand."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions.residues import mask, one_letter
from pairloom.operators import profile
from pairloom.operators.clustering import cluster, common_letters, greedy
from pairloom.operators.extraction import extract, first_entities, overflow, unnumbered
from pairloom.operators.fasta import fasta_records, group_sequences, several_clusters, several_sequences, write_fasta
from pairloom.operators.ordinals import with_ordinal
from pairloom.sources import mmcif
from pairloom.sources.tsv import NA_TOKENS, read_tsv, write_tsv

CIF = """data_X
#
loop_
_struct_asym.id
_struct_asym.entity_id
A 1
B 1
C 3
loop_
_entity_poly_seq.entity_id
_entity_poly_seq.num
_entity_poly_seq.mon_id
1 1 MET
1 2 ALA
1 3 'XYZ'
1 4 GLY
3 1 TRP
_note.text
;a text block
loop_
;
loop_
_atom_site.group_PDB
_atom_site.label_asym_id
_atom_site.label_seq_id
ATOM A 1
ATOM A 1
ATOM A 2
ATOM A 4
ATOM B 1
ATOM B 2
ATOM B 3
ATOM B 4
ATOM B 5
ATOM C 0
ATOM C .
loop_
_pdbx_entity_remapping.new
_pdbx_entity_remapping.orig
1 1
3 2
"""


@pytest.fixture(scope="module")
def structures(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cif")
    (folder / "1xxx-assembly1.cif.gz").write_bytes(gzip.compress(CIF.encode()))
    (folder / "1two-assembly1.cif").write_text(CIF + "data_Y\n")
    (folder / "1bad-assembly1.cif.gz").write_bytes(b"\x1f\x8bnonsense")
    (folder / "1emp-assembly1.cif").write_text("# nothing\n")
    return mmcif.read_structures(spark, str(folder)).cache()


SELECTED = "pdb_id string, assembly_number string, entity_pair string, cluster_pair_100pct string, entity_clusters string"


def test_mmcif_rows():
    rows = mmcif.rows(CIF)
    assert ("remap", 1, "3", "2") in rows and ("poly_seq", 2, "1", "XYZ") in rows
    assert [r[2:] for r in rows if r[0] == "residue"].count(("A", "1")) == 1


def test_s9_exactly_one_block_and_bad_files(structures):
    bad = {r["file"] for r in structures.where("category = 'error'").collect()}
    assert bad == {"1two-assembly1.cif", "1bad-assembly1.cif.gz", "1emp-assembly1.cif"}  # the last holds a comment only


def test_mmcif_quotes_and_single_items():
    rows = mmcif.rows("data_a\n_struct_asym.id 'A''b' # c\n_struct_asym.entity_id \"it's\"\n")
    assert rows == [("asym", 0, "A''b", "it's")]
    with pytest.raises(mmcif.BadFile):
        mmcif.rows("data_a\nloop_\n_struct_asym.id\n_struct_asym.entity_id\nA\n")
    with pytest.raises(mmcif.BadFile):
        mmcif.rows("data_a\n_x.y\n;open")


def test_m17_m18_m19_m20_h11_h17_h18(spark, structures):
    rows = [("1XXX", "1", "1XXX_1,1XXX_2", "c1,c2", "c2,c1"), ("9NON", "1", "9NON_1,9NON_1", "c5,c5", "c5,c5"), ("1XXX", "1", "1XXX_9,1XXX_", "c7,c8", "c7,c8")]
    got = {r["entity_name"]: r for r in extract(spark.createDataFrame(rows, SELECTED), structures).collect()}
    assert got["1XXX_1"]["sequence"] == "MAXG" and got["1XXX_1"]["binary_mask"] == "A: 1101; B: 1111;"
    assert got["1XXX_2"]["sequence"] == "W" and got["1XXX_2"]["binary_mask"] == "C: 0;"
    assert got["9NON_1"]["sequence"] == "-" and got["9NON_1"]["binary_mask"] is None
    assert got["1XXX_9"]["sequence"] == "-" and got["1XXX_9"]["binary_mask"] == ""
    assert {(r["asym_id"], r["beyond"]) for r in overflow(structures).collect()} == {("B", 1)}


def test_h5_names_without_number(spark, structures):
    df = spark.createDataFrame([("1XXX", "1", "noname,1XXX_1", "a,b", "a,b")], SELECTED)
    assert [r["entity_name"] for r in extract(df, structures).collect()] == ["1XXX_1"]
    assert [r["entity"] for r in unnumbered(df).collect()] == ["noname"]


def test_m10_h10_aligned(spark):
    df = spark.createDataFrame([("X", "1", "X_1,X_2", "c1,c9", "c9,c1")], SELECTED)
    def clusters(aligned):
        return {r["entity"]: r["cluster_id"] for r in first_entities(df, ["pdb_id", "assembly_number"], aligned=aligned).collect()}

    assert clusters(False) == {"X_1": "c1", "X_2": "c9"} and clusters(True) == {"X_1": "c9", "X_2": "c1"}


def test_m21_h26_first_row_wins(spark):
    df = spark.createDataFrame([("B", "1", "E_1, E_2", "c1,c2", None), ("A", "1", "E_1,E_3", "c3,c4", None), ("A", "2", None, None, None), ("A", "3", " , ", "x", None)], SELECTED)
    got = {r["entity"]: (r["file"], r["cluster_id"]) for r in first_entities(df, ["pdb_id", "assembly_number"]).collect()}
    assert got == {"E_1": ("a-assembly1.cif.gz", "c3"), "E_2": ("b-assembly1.cif.gz", "c2"), "E_3": ("a-assembly1.cif.gz", "c4")}


def test_h8_h24_masks_and_letters(spark):
    df = spark.createDataFrame([([1, 2, 4, 4, 9, 0], 4), ([], 0), ([], 3), ([3], 3)], "p array<int>, n int")
    assert [r[0] for r in df.select(mask(F.col("p"), F.col("n"))).collect()] == ["1101", "", "000", "001"]
    codes = spark.createDataFrame([(["ALA", "MSE", "QQQ", None, "gly"],), ([],)], "c array<string>")
    assert [r[0] for r in codes.select(one_letter(F.col("c"))).collect()] == ["AMXXG", ""]


SEQ = "ord int, sequence string, entity_name string, cluster_id string"


def test_m22_h6_h12_h21_fasta(spark, tmp_path):
    df = spark.createDataFrame([(1, "B", "e1", "c1"), (2, "A", "e2", "c2"), (3, "B", "e3", "c1"), (4, "B", "e1", "c3"), (5, None, "e9", "c9"), (6, "-", "m", "c4")], SEQ)
    groups = group_sequences(df, "ord")
    records = fasta_records(groups)
    assert [(r["header"], r["sequence"]) for r in records.orderBy("ordinal").collect()] == [(">0;c4;m", "-"), (">1;c2;e2", "A"), (">2;c1 c3;e1 e3", "B")]
    assert [r["sequence"] for r in several_clusters(groups).collect()] == ["B"]
    assert several_sequences(df).count() == 0
    assert group_sequences(df, "ord", drop_missing=True).count() == 2
    write_fasta(records, str(tmp_path / "f"), one_file=True)
    text = "".join(p.read_text() for p in (tmp_path / "f").glob("part*"))
    assert text == ">0;c4;m\n-\n>1;c2;e2\nA\n>2;c1 c3;e1 e3\nB\n"
    assert fasta_records(group_sequences(df.limit(0), "ord")).count() == 0


def test_ordinals(spark):
    words = [f"w{i * 7919 % 1000:04d}" for i in range(1000)]
    got = with_ordinal(spark.createDataFrame([(w,) for w in words], "w string"), ["w"]).collect()
    assert {r["w"]: r["ordinal"] for r in got} == {w: i for i, w in enumerate(sorted(words))}


def test_m23_h1_h2_h3_tsv(spark, tmp_path):
    df = spark.createDataFrame([("1E10", "NA", None, 'a "q"\tb'), ("2", "x", "", "y")], "pdb_id string, sequence string, empty string, text string")
    write_tsv(df, str(tmp_path / "t"), one_file=True)
    raw = b"".join(p.read_bytes() for p in (tmp_path / "t").glob("part*.csv"))
    assert raw == b'pdb_id\tsequence\tempty\ttext\r\n1E10\tNA\t\t"a ""q""\tb"\r\n2\tx\t\ty\r\n'
    back = read_tsv(spark, str(tmp_path / "t"), df.schema).orderBy("pdb_id").collect()
    assert back[0]["pdb_id"] == "1E10" and back[0]["sequence"] == "NA" and back[0]["text"] == 'a "q"\tb' and back[0]["empty"] is None
    assert read_tsv(spark, str(tmp_path / "t"), df.schema, NA_TOKENS).where("sequence is null").count() == 1


def test_m24_h9_describe(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,), (None,)], "n int")
    r = profile.describe(df, "n").first()
    assert (r["count"], r["q25"], r["q50"], r["q75"], r["min"], r["max"]) == (4, 1.75, 2.5, 4.75, 1, 10)
    assert profile.describe(df.limit(0), "n").first()["count"] == 0


def test_m25_letter_share(spark):
    got = {r["length"]: r["mean_percent"] for r in profile.letter_share_by_length(spark.createDataFrame([("AXXB",), ("XAAA",), (None,), ("",)], "s string"), "s").collect()}
    assert got[4] == 37.5 and got[5] == 0 and len(got) == 50


def test_m26_h28_rows_naming(spark):
    df = spark.createDataFrame([("X_1,X_2",), ("X_2, X_3",), ("X_2,X_2",), (None,)], "entity_pair string")
    names = spark.createDataFrame([("X_2",), ("X_2",), (" X_3",)], "entity string")
    assert sorted(r[0] for r in profile.rows_naming(df, "entity_pair", names, "entity").collect()) == ["X_1,X_2", "X_2, X_3", "X_2,X_2"]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0,), (10,), (5,), (None,)], "n int")
    got = {r["bin"]: r["n"] for r in profile.histogram(df, "n", 10).collect()}
    assert (got[1], got[6], got[10]) == (1, 1, 1) and sum(got.values()) == 3
    assert {r["n"] for r in profile.histogram(spark.createDataFrame([(3,), (3,)], "n int"), "n", 2).collect()} == {0, 2}
    assert profile.histogram(df.limit(0), "n").count() == 0


def test_counts_shares_cutoffs(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "v string, n int")
    assert [tuple(r) for r in profile.value_counts(df, "v").collect()] == [("a", 2), ("b", 1)]
    assert [r["percent"] for r in profile.shares(df, "v").collect()] == [66.7, 33.3]
    assert tuple(profile.cutoffs(df, "n", 2, 2).first()) == (2, 1)
    assert [r["n"] for r in profile.duplicates(df, "v", ["n"]).collect()] == [2]
    many = spark.createDataFrame([("a" if i % 3 else None, i // 2) for i in range(600)], "v string, n int")
    assert profile.duplicates(many, "v", ["n"], 4).count() == 598 and profile.duplicates(many.limit(0), "v", ["n"]).count() == 0


def test_c1_greedy_against_sequential(spark):
    rng = random.Random(5)
    for n, p in ((30, 0.1), (40, 0.3), (12, 1.0)):
        edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p] + [(i, i + 1) for i in range(4)]
        near = {}
        for a, b in edges:
            near.setdefault(b, set()).add(a)
        want, reps = {}, []
        for x in range(n):
            first = next((r for r in reps if r in near.get(x, ())), None)
            want[x] = x if first is None else first
            if first is None:
                reps.append(x)
        got = greedy(spark.range(n), spark.createDataFrame(edges, "a long, b long"))
        assert {r["id"]: r["representative"] for r in got.collect()} == want


def test_c1_clusters(spark):
    base = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQAPILSRVGDGTQDNLSGAEKAVQVKVKALPDAQFEVVHSLAKWKRQTLGQHDFSAGEGLYTHMKALRPDEDRL"
    small = base[:40] + "W" + base[41:100]
    other = base[::-1]
    df = spark.createDataFrame([(base,), (base,), (small,), (other,), ("SHORT",), (None,), ("",)], "sequence string")
    got = {r["sequence"]: r["representative"] for r in cluster(df).collect()}
    assert got == {base: base, small: base, other: other}
    assert cluster(df.limit(0)).count() == 0


def test_common_letters():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("ABCD", k=rng.randint(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert common_letters(a, b) == t[-1][-1]
