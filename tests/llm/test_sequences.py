"""p3_sequences: every row with residues has a class, whatever its cluster and length."""

import hashlib

from pairloom.llm import problems


def test_p3_sequences_without_cluster_and_short_ones(spark, tmp_path):
    one, two = "MKTAYIAKQRQISFVKSHFSRQ", "MKTAYIAKQRQISFVKSHFSRW"
    rows = [(1, None, one), (2, "c1", two), (3, "c2", "MKT"), (4, None, "m-kt"), (5, "c3", None), (6, "c4", "-"), (7, None, "XXXXXX"), (8, "c5", one.lower())]
    spark.createDataFrame(rows, "row_id long, cluster_id string, sequence string").write.parquet(f"{tmp_path}/entity_sequences.parquet")

    def name(s):
        return hashlib.sha256(s.encode()).hexdigest()

    got = {r["row_id"]: (r["class_id"], r["links"]) for r in problems.p3_sequences(spark, str(tmp_path)).collect()}
    assert got == {1: (name(one), 1), 2: (name(two), 1), 3: (name("MKT"), 0), 4: (name("MKT"), 0), 5: (None, 0), 6: (None, 0), 7: (name("XXXXXX"), 0), 8: (name(one), 1)}


def test_p3_sequences_only_without_cluster(spark, tmp_path):
    rows = [(1, None, "MKTAYIAKQR"), (2, None, "MKTAYIAKQRW")]
    spark.createDataFrame(rows, "row_id long, cluster_id string, sequence string").write.parquet(f"{tmp_path}/entity_sequences.parquet")
    assert sorted((r["row_id"], r["class_id"] is None, r["links"]) for r in problems.p3_sequences(spark, str(tmp_path)).collect()) == [(1, False, 1), (2, False, 1)]
