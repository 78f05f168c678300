"""The archive's requests against a server on this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from pairloom.sources import archive


class Handler(BaseHTTPRequestHandler):
    fails: dict = {}

    def log_message(self, *_):
        pass

    def answer(self, body: bytes, status=200):
        self.send_response(status)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def do_POST(self):
        data = json.loads(self.rfile.read(int(self.headers["Content-Length"])) or b"{}")
        left = self.fails.get(self.path, [])
        if left:
            return self.answer(b"x", left.pop(0))
        if self.path == "/empty":
            return self.answer(b"")
        if self.path == "/errors":
            return self.answer(b'{"errors": ["no"]}')
        if self.path == "/search":
            few = len(data["query"]["nodes"]) == 4
            return self.answer(json.dumps({"result_set": ["b-1", {"identifier": "a-2"}, "B-1"][: 1 if few else 3]}).encode())
        ids = data.get("variables", {}).get("ids", [])
        self.answer(json.dumps({"data": {"assemblies": [{"rcsb_id": i} for i in ids if i != "GONE"] + [None]}}).encode())

    def do_GET(self):
        left = self.fails.get(self.path, [])
        self.answer(b"x" * 3_000_000, left.pop(0)) if left else self.answer(b"y" * 3_000_000)


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_s5_retries(url):
    waits = []
    Handler.fails["/ok"] = [500, 429, 408]
    assert archive.post_json(url + "/ok", {}, wait=waits.append) == {"data": {"assemblies": [None]}} and waits == [1, 2, 4]
    assert archive.post_json(url + "/empty", {}) == {}
    Handler.fails["/bad"] = [404, 500]
    with pytest.raises(archive.Fatal):
        archive.post_json(url + "/bad", {}, wait=waits.append)
    Handler.fails["/never"] = [500] * 9
    waits.clear()
    with pytest.raises(RuntimeError):
        archive.post_json(url + "/never", {}, wait=waits.append)
    assert waits == [1, 2, 4, 8]


def test_s6_k5_downloads(url, tmp_path, spark):
    Handler.fails["/f"] = [503]
    archive.fetch_file(url + "/f", str(tmp_path / "d/f.gz"), wait=lambda _: None)
    assert (tmp_path / "d/f.gz").stat().st_size == 3_000_000 and [p.name for p in (tmp_path / "d").iterdir()] == ["f.gz"]
    Handler.fails["/g"] = [404]
    with pytest.raises(archive.Fatal):
        archive.fetch_file(url + "/g", str(tmp_path / "d/g.gz"), wait=lambda _: None)
    rows = spark.createDataFrame([(url + "/f", "f.gz"), (url + "/h", "h.gz"), (url + "/h", "h.gz")], "download_url string, local_filename string")
    todo = archive.missing_files(rows, archive.listed_files(spark, str(tmp_path / "d")))
    assert {r["local_filename"] for r in todo.collect()} == {"h.gz"}
    archive.download_files(todo, str(tmp_path / "d"))
    assert (tmp_path / "d/h.gz").stat().st_size == 3_000_000


def test_s1_s2_f1_f2_f3_search():
    body = archive.search_body()
    assert len(body["query"]["nodes"]) == 3 and len(archive.search_body(True)["query"]["nodes"]) == 4
    assert body["request_options"]["results_content_type"] == ["experimental"]
    assert archive.hit_ids({"result_set": ["b-1", {"identifier": "a-1"}, {"x": 1}, None, "B-1"]}) == ["A-1", "B-1"] and archive.hit_ids({}) == []


def test_s1_search_source(url, spark):
    assert [r["assembly_id"] for r in archive.search_ids(spark, url + "/search").collect()] == ["A-2", "B-1"]
    assert [r["assembly_id"] for r in archive.search_ids(spark, url + "/search", True).collect()] == ["B-1"]


def test_s3_s4_documents(url, spark):
    query = archive.metadata_query()
    assert "resolution_combined" in query and "oper_expression" not in query
    got = archive.read_documents(spark, url + "/docs", ["A", "B", "GONE", "C"], batch_size=3)
    assert got.rdd.getNumPartitions() == 2
    assert sorted(json.loads(r["payload"])["rcsb_id"] for r in got.collect()) == ["A", "B", "C"]
    with pytest.raises(archive.Fatal):
        archive.documents_of({"errors": ["x"]})
    assert archive.documents_of({"data": None}) == [] and archive.documents_of({}) == []


def test_p13_o6_batches_and_limit(spark):
    ids = spark.createDataFrame([(f"I{i:02d}",) for i in range(7)] + [("I00",), (None,)], "assembly_id string")
    got = {r["batch_no"]: r["ids"] for r in archive.batches(ids, 3).collect()}
    assert [len(got[k]) for k in (1, 2, 3)] == [3, 3, 1] and got[1] == ["I00", "I01", "I02"]
    assert archive.limit_ids(ids.where("assembly_id is not null"), 2).count() == 2 and archive.limit_ids(ids, 0).count() == 9
    with pytest.raises(ValueError):
        archive.limit_ids(ids, -1)
    with pytest.raises(ValueError):
        archive.batches(ids, 0)


def test_search_limit_batches_and_documents_are_one_plan(spark, url):
    ids = archive.distinct_ids(archive.search_ids(spark, url + "/search"))
    assert [r[0] for r in ids.collect()] == ["A-2", "B-1"]
    got = archive.fetch_documents(archive.batches(spark.createDataFrame([("A",), ("B",), ("GONE",), ("C",)], "assembly_id string"), 3), url + "/docs").collect()
    want = archive.read_documents(spark, url + "/docs", ["A", "B", "C", "GONE"], batch_size=3).collect()
    assert sorted(r["payload"] for r in got) == sorted(r["payload"] for r in want) and got
    assert archive.fetch_documents(archive.batches(ids.limit(0), 3), url + "/docs").count() == 0


def test_search_expressions_on_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", None)], "x string, n int")
    leaves = [archive.condition("x", "exact_match", "a"), archive.condition("n", "less_or_equal", 1)]
    assert rows.where(archive.as_column(archive.conjunction(leaves))).count() == 1
    either = {"type": "group", "logical_operator": "or", "nodes": leaves}
    assert rows.where(archive.as_column(either)).count() == 2 and rows.where(archive.as_column(archive.conjunction([]))).count() == 4
