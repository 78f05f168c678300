"""Documents that lie in the response envelope data.assemblies."""

import datetime
import json

import pytest

from pairloom.operators.candidates import derive
from pairloom.plans import domain
from pairloom.streaming.representatives import latest_version, merge
from tests.compare import both
from tests.test_candidates import doc, entity


def around(x):
    return json.dumps({"data": {"assemblies": x}})


def whole(name, **more):
    return doc(f"{name}-1", entities=[entity(f"{name}_1", "A,B")], **more)


def test_derive_opens_the_envelope(spark):
    texts = [json.dumps(whole("1AAA")), around([whole("1BBB")]), around(whole("1CCC")), around([whole("1DDD"), None, 3, whole("1EEE")]), around([]), around(None), json.dumps({"data": {"other": 1}}), json.dumps({"data": [1]})]
    rows = derive(spark.createDataFrame(list(enumerate(texts)), "n int, payload string")).select("n", "assembly_id", "reject").collect()
    got = sorted((r["n"], r["assembly_id"], r["reject"] or "") for r in rows)
    bad = "unreadable"
    assert got == [
        (0, "1AAA-1", ""), (1, "1BBB-1", ""), (2, "1CCC-1", ""), (3, "", bad), (3, "", bad), (3, "1DDD-1", ""), (3, "1EEE-1", ""), (4, "", bad), (5, "", bad), (6, "", "no_id"), (7, "", "no_id"),
    ]


def test_enveloped_payloads_in_d01_d02_d03(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [
        (1, "1AAA-1", day, json.dumps(whole("1AAA", resolution=3.0))), (2, "1AAA-1", day + datetime.timedelta(1), around([whole("1AAA", resolution=2.0)])),
        (3, "1BBB-1", day, around(whole("1BBB"))), (4, "1CCC-1", day, around([whole("1CCC", gens=[])])),
    ]
    spark.createDataFrame(rows, "landing_id long, assembly_id string, fetched_at timestamp, payload string").write.parquet(f"{tmp_path}/assembly.parquet")
    assert sorted((r["landing_id"], r["assembly_id"]) for r in domain.d01_candidates(spark, str(tmp_path)).collect()) == [(1, "1AAA-1"), (2, "1AAA-1"), (3, "1BBB-1")]
    assert [tuple(r) for r in domain.d02_rejects(spark, str(tmp_path)).collect()] == [("entity_count", 1)]
    assert sorted((r["assembly_id"], r["resolution_best_angstrom"]) for r in domain.d03_selected(spark, str(tmp_path)).collect()) == [("1AAA-1", 2.0), ("1BBB-1", None)]


def test_stream_merge_opens_the_envelope(spark, tmp_path):
    merge(spark.createDataFrame([(around([whole("1AAA"), whole("1BBB")]),)], "payload string"), f"{tmp_path}/t", 0)
    assert sorted(r["assembly_id"] for r in latest_version(spark, f"{tmp_path}/t")[1].collect()) == ["1AAA-1", "1BBB-1"]


@pytest.mark.parametrize("name", ["d01_candidates", "d02_rejects", "d03_selected"])
def test_derivation_against_sql_with_many_envelopes(spark, name):
    """sf0.01 has many enveloped payloads; the rules are stated anew in SQL."""
    got, want = both(spark, "/root/testdata/sf0.01", domain.QUERIES[name], domain.SQL[name])
    assert got == want and (len(got) > 300 or name == "d02_rejects")
