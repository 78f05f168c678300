"""A structure archive's search, metadata and files over HTTP. Addresses are parameters; nothing here runs by itself."""

from __future__ import annotations

import json
import operator
import os
import time
from collections.abc import Callable, Iterator
from functools import reduce
from urllib import error as url_error
from urllib import request as url_request

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pairloom.schemas import ASSEMBLY_FIELDS, selection

RETRIED_STATUS = (408, 429)
CHUNK = 1 << 20


class Fatal(RuntimeError):
    """A request that no repetition can mend."""


def attempts(action: Callable[[], object], what: str, retries: int, also: tuple[type[BaseException], ...] = (), wait: Callable[[float], None] = time.sleep):
    """Runs ``action`` up to ``retries`` times; waits 1, 2, 4 ... seconds after each failure."""
    last: BaseException | None = None
    for n in range(retries):
        try:
            return action()
        except url_error.HTTPError as e:
            if 400 <= e.code < 500 and e.code not in RETRIED_STATUS:
                raise Fatal(f"{what}: HTTP {e.code}") from e
            last = e
        except (url_error.URLError, TimeoutError, *also) as e:
            last = e
        wait(2.0**n)
    raise RuntimeError(f"{what}: {last!r}") from last


def post_json(url: str, body: dict, *, timeout: int = 120, retries: int = 4, wait: Callable[[float], None] = time.sleep) -> dict:
    """The JSON answer of a POST; an empty answer is {}."""
    request = url_request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Accept": "application/json"}, method="POST")

    def once() -> dict:
        with url_request.urlopen(request, timeout=timeout) as answer:
            data = answer.read()
        return json.loads(data) if data else {}

    return attempts(once, f"POST {url}", retries, (json.JSONDecodeError,), wait)


def fetch_file(url: str, path: str, *, timeout: int = 120, retries: int = 4, wait: Callable[[float], None] = time.sleep) -> None:
    """Downloads to a temporary name in the same folder and renames it when whole."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = path + ".tmp"

    def once() -> None:
        try:
            with url_request.urlopen(url, timeout=timeout) as answer, open(part, "wb") as out:
                while data := answer.read(CHUNK):
                    out.write(data)
            os.replace(part, path)
        finally:
            if os.path.exists(part):
                os.remove(part)

    attempts(once, f"GET {url}", retries, (), wait)


# The archive's attribute names and the values that candidates must have.
CONDITIONS = (
    ("rcsb_entry_info.selected_polymer_entity_types", "exact_match", "Protein (only)"),
    ("rcsb_assembly_info.polymer_entity_instance_count", "equals", 2),
    ("rcsb_struct_symmetry.kind", "exact_match", "Global Symmetry"),
)
NO_LIGANDS = ("rcsb_assembly_info.nonpolymer_entity_instance_count", "equals", 0)


def condition(attribute: str, operator: str, value) -> dict:
    """One leaf of the search expression."""
    return {"type": "terminal", "service": "text", "parameters": {"attribute": attribute, "operator": operator, "value": value}}


def conjunction(leaves: list[dict]) -> dict:
    """All of the leaves must hold."""
    return {"type": "group", "logical_operator": "and", "nodes": leaves}


def as_column(query: dict, columns: Callable[[str], Column] = F.col) -> Column:
    """A search expression as a condition on landed rows: what the archive would evaluate, evaluated here.

    ``columns`` gives an attribute's column. Used as a filter: a missing value fulfils no
    condition, and a group without conditions holds for every row.
    """
    if query["type"] == "group":
        parts = [as_column(q, columns) for q in query["nodes"]]
        return reduce(operator.and_ if query["logical_operator"] == "and" else operator.or_, parts) if parts else F.lit(True)
    p = query["parameters"]
    compare = {"exact_match": operator.eq, "equals": operator.eq, "less": operator.lt, "less_or_equal": operator.le, "greater": operator.gt, "greater_or_equal": operator.ge}
    return compare[p["operator"]](columns(p["attribute"]), p["value"])


def search_body(no_ligands: bool = False) -> dict:
    """The whole search: all conditions must hold; experimental structures only, all hits, compact."""
    leaves = [condition(*c) for c in (*CONDITIONS, *([NO_LIGANDS] if no_ligands else []))]
    options = {"return_all_hits": True, "results_content_type": ["experimental"], "results_verbosity": "compact"}
    return {"query": conjunction(leaves), "return_type": "assembly", "request_options": options}


def hit_ids(answer: dict) -> list[str]:
    """Distinct upper-case ids in order, of hits given as texts or as objects with an identifier."""
    hits = answer.get("result_set") or []
    names = (h if isinstance(h, str) else h.get("identifier") if isinstance(h, dict) else None for h in hits)
    return sorted({str(n).upper() for n in names if n})


def distinct_ids(rows: DataFrame, id: str = "assembly_id") -> DataFrame:
    """The distinct upper-case ids in order; nulls and empty ids are left out."""
    return rows.select(F.upper(id).alias("assembly_id")).where("assembly_id <> ''").distinct().orderBy("assembly_id")


def metadata_query() -> str:
    """The request for the documents of a list of ids, with just the fields that are used."""
    return "query Documents($ids: [String!]!) {\n  assemblies(assembly_ids: $ids) {\n" + selection(ASSEMBLY_FIELDS, 4) + "\n  }\n}"


def documents_of(answer: dict) -> list:
    """The documents of a metadata answer; an answer with errors raises."""
    if answer.get("errors"):
        raise Fatal("the archive answered with errors: " + json.dumps(answer["errors"])[:2000])
    return (answer.get("data") or {}).get("assemblies") or []


def batches(ids: DataFrame, size: int, id: str = "assembly_id") -> DataFrame:
    """(batch_no from 1, ids): ``size`` ids each in order of the ids, the last one short."""
    if size < 1:
        raise ValueError("the batch size must be at least 1")
    from pairloom.operators.ordinals import with_ordinal

    numbered = with_ordinal(ids.select(id).where(F.col(id).isNotNull()).distinct(), [id], "n")
    return numbered.groupBy((F.floor(F.col("n") / size) + 1).alias("batch_no")).agg(F.sort_array(F.collect_list(id)).alias("ids"))


def limit_ids(ids: DataFrame, n: int, id: str = "assembly_id") -> DataFrame:
    """The first ``n`` ids in order; 0 takes all; a negative number is refused."""
    if n < 0:
        raise ValueError("the limit must not be negative")
    return ids.orderBy(id).limit(n) if n else ids


class _Search(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"]
        self.no_ligands = str(options.get("no_ligands", "false")).lower() == "true"
        self.retries = int(options.get("retries", 4))

    def read(self, partition) -> Iterator[tuple]:
        yield from ((i,) for i in hit_ids(post_json(self.url, search_body(self.no_ligands), retries=self.retries)))


class ArchiveSearch(DataSource):
    """``spark.read.format("archive_search")`` with options ``url`` and ``no_ligands``: one row an
    assembly that meets the conditions (column ``assembly_id``), distinct, upper case, in order.
    The conditions are evaluated by the archive; the answer comes in one piece, as one partition."""

    @classmethod
    def name(cls) -> str:
        return "archive_search"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("assembly_id", T.StringType())])

    def reader(self, schema: T.StructType) -> _Search:
        return _Search(self.options)


def search_ids(spark: SparkSession, url: str, no_ligands: bool = False) -> DataFrame:
    spark.dataSource.register(ArchiveSearch)
    return spark.read.format("archive_search").options(url=url, no_ligands=str(no_ligands).lower()).load()


class _Batch(InputPartition):
    def __init__(self, ids: list[str]):
        super().__init__(ids)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"]
        self.ids = json.loads(options["ids"])
        self.size = int(options.get("batch_size", 200))
        self.retries = int(options.get("retries", 4))

    def partitions(self) -> list[_Batch]:
        return [_Batch(self.ids[i : i + self.size]) for i in range(0, len(self.ids), self.size)]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        answer = post_json(self.url, {"query": metadata_query(), "variables": {"ids": partition.value}}, retries=self.retries)
        for doc in documents_of(answer):
            if doc is not None:
                yield (json.dumps(doc),)


class ArchiveDocuments(DataSource):
    """``spark.read.format("archive_documents")`` with options ``url``, ``ids`` (a JSON list) and
    ``batch_size``: one partition a batch, one row a returned document (column ``payload``)."""

    @classmethod
    def name(cls) -> str:
        return "archive_documents"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("payload", T.StringType())])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options)


def read_documents(spark: SparkSession, url: str, ids: list[str], batch_size: int = 200) -> DataFrame:
    spark.dataSource.register(ArchiveDocuments)
    return spark.read.format("archive_documents").options(url=url, ids=json.dumps(ids), batch_size=str(batch_size)).load()


def fetch_documents(batched: DataFrame, url: str, retries: int = 4) -> DataFrame:
    """(payload): the documents of the ids in ``batched`` (column ``ids``, see ``batches``), one request a batch, sent by the
    tasks. Ids that the archive doesn't know give no row. Every reading of the result asks again, so it should be stored."""

    def run(parts):
        for part in parts:
            found = []
            for ids in part.column(0).to_pylist():
                answer = post_json(url, {"query": metadata_query(), "variables": {"ids": ids}}, retries=retries)
                found += [json.dumps(doc) for doc in documents_of(answer) if doc is not None]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["payload"])

    return batched.select("ids").mapInArrow(run, "payload string")


def missing_files(selected: DataFrame, present: DataFrame) -> DataFrame:
    """The rows whose ``local_filename`` isn't among the non-empty files of ``present`` (file, size)."""
    there = present.where("size > 0").select(F.col("file").alias("local_filename"))
    return selected.join(there, "local_filename", "left_anti")


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size) of the files below ``path``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return found.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("size"))


def download_files(rows: DataFrame, folder: str, retries: int = 4) -> None:
    """Fetches ``download_url`` of every row into ``folder`` (shared by all executors)."""

    def run(part) -> None:
        for r in part:
            fetch_file(r["download_url"], os.path.join(folder, r["local_filename"]), retries=retries)

    rows.select("download_url", "local_filename").distinct().foreachPartition(run)
