"""The command line and the stream, end to end."""

import json

from pairloom.cli import main
from pairloom.plans.curation import curate, latest_documents
from pairloom.streaming.representatives import follow, latest_version, merge, read_landed, windowed_counts
from tests.test_candidates import doc, entity, member
from tests.test_extraction import CIF


def landed(n):
    same = [member(100, f"c{n % 3}")]
    return [doc(f"1AA{i}-1", entities=[entity(f"1AA{i}_1", "A,B", rcsb_polymer_entity_group_membership=same)], resolution=float(n + i)) for i in range(3)] + ["broken"]


def write(path, docs):
    path.write_text("".join((d if isinstance(d, str) else json.dumps(d)) + "\n" for d in docs))


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(6):
        write(tmp_path / f"in/f{n}.json", landed(n))
    stream = follow(read_landed(spark, str(tmp_path / "in"), 2), str(tmp_path / "best"), str(tmp_path / "ckpt"), availableNow=True)
    stream.awaitTermination(120)
    number, got = latest_version(spark, str(tmp_path / "best"))
    whole = curate(spark.read.text(str(tmp_path / "in")).withColumnRenamed("value", "payload")).selected
    assert number == 2 and sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.count() == 3
    merge(spark.createDataFrame([("x",)], "payload string"), str(tmp_path / "best"), 1)  # run again: nothing to do
    assert latest_version(spark, str(tmp_path / "best"))[0] == 2


def test_windowed_counts(spark):
    df = spark.createDataFrame([(json.dumps(doc()), "2024-01-01 10:00:00"), ("x", "2024-01-01 11:00:00"), ("x", "2024-01-03 11:00:00")], "payload string, t string")
    rows = windowed_counts(df.selectExpr("payload", "cast(t as timestamp) fetched_at")).orderBy("start").collect()
    assert [(r["documents"], r["rejected"]) for r in rows] == [(2, 1), (1, 1)]


def test_cli(spark, tmp_path):
    good = doc("1xxx-1", entities=[entity("1XXX_1", "A,B", rcsb_polymer_entity_group_membership=[member(100, "c1")])], resolution=1.5)
    write(tmp_path / "docs.json", [good, "broken"])
    out = tmp_path / "out"
    assert main(["curate", "--documents", str(tmp_path / "docs.json"), "--outdir", str(out), "--no-download", "--one-file"], spark) == 0
    text = b"".join(p.read_bytes() for p in (out / "selected_assemblies.tsv").glob("*.csv"))
    assert text.startswith(b"assembly_id\tpdb_id\t") and text.count(b"\r\n") == 2
    (tmp_path / "cif").mkdir()
    (tmp_path / "cif/1xxx-assembly1.cif").write_text(CIF)
    (tmp_path / "cif/1xxx-assembly1.cif").rename(tmp_path / "cif/1xxx-assembly1.cif.gz")  # not zipped, whatever its name
    main(["extract", "--selected", str(out / "selected_assemblies.tsv"), "--structures", str(tmp_path / "cif"), "--out", str(out / "seq.tsv"), "--one-file"], spark)
    text = b"".join(p.read_bytes() for p in (out / "seq.tsv").glob("*.csv")).decode()
    assert text.splitlines() == ["entity_name\tcluster_id\tsequence\tbinary_mask", "1XXX_1\tc1\tMAXG\tA: 1101; B: 1111;"]
    main(["fasta", "--sequences", str(out / "seq.tsv"), "--out", str(out / "fasta"), "--one-file"], spark)
    assert "".join(p.read_text() for p in (out / "fasta").glob("part*")) == ">0;c1;1XXX_1\nMAXG\n"
    main(["cluster", "--sequences", str(out / "seq.tsv"), "--out", str(out / "clusters")], spark)
    assert spark.read.parquet(str(out / "clusters")).count() == 0


def test_latest_documents(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("A", 2, 2, "y"), ("A", 2, 3, "z"), (None, 1, 4, "n")], "assembly_id string, fetched_at int, landing_id int, payload string")
    assert sorted(r["payload"] for r in latest_documents(df).collect()) == ["n", "z"]
