"""Deeply nested records to flat tables, over an adjacency table of their nodes.

``shred`` walks each JSON text once and stores a row for every node: the node, its parent,
its label, its ordinal and, for leaves, the scalar. ``child_keys`` and ``entity_table`` then
join object nodes with their scalar children and pivot them into one table per kind of object,
each row linked to its document and to its parent object.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.text import split_ids, strip
from pairloom.session import spread

OBJECT, ARRAY, STRING, NUMBER, BOOLEAN, NULL = "object", "array", "string", "number", "boolean", "null"


class _Number(str):
    """A number as it is written, so that 100 and 100.0 stay apart."""


def parse(text: str | None):
    """The value of a JSON text with numbers as written; ValueError if it can't be read."""
    if text is None:
        raise ValueError("null")
    try:
        return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    except RecursionError:
        raise ValueError("nested too deeply") from None


def _kind(value) -> str:
    if isinstance(value, dict):
        return OBJECT
    if isinstance(value, list):
        return ARRAY
    if isinstance(value, _Number):
        return NUMBER
    if isinstance(value, bool):
        return BOOLEAN
    return NULL if value is None else STRING


def roots(value, envelope: tuple[str, ...]) -> list:
    """The documents of a payload: itself, or what lies in the envelope left around it."""
    inner = value
    for label in envelope:
        if not isinstance(inner, dict) or label not in inner:
            return [value]
        inner = inner[label]
    return inner if isinstance(inner, list) else [inner]


def walk(value, envelope: tuple[str, ...] = (), keep: frozenset[str] | None = None) -> Iterator[tuple]:
    """(node, parent, owner, path, label, ordinal, kind, scalar) in document order.

    ``parent`` is the container a node stands in, ``owner`` the nearest object around it (-1:
    none), ``path`` the labels from the root without array steps, ``ordinal`` the place in the
    array (0 outside of arrays). With ``keep`` only nodes of these paths are given.
    """
    number = 0
    stack = [(x, -1, -1, "", None, i) for i, x in reversed(list(enumerate(roots(value, envelope))))]
    while stack:
        item, parent, owner, path, label, ordinal = stack.pop()
        node, number, kind = number, number + 1, _kind(item)
        if keep is None or path in keep:
            scalar = None if kind in (OBJECT, ARRAY, NULL) else ("true" if item else "false") if kind == BOOLEAN else str(item)
            yield node, parent, owner, path, label, ordinal, kind, scalar
        if kind == OBJECT:
            dot = path + "." if path else ""
            stack.extend((x, node, node, dot + k, k, 0) for k, x in reversed(item.items()))
        elif kind == ARRAY:
            stack.extend((x, node, owner, path, label, i) for i, x in zip(range(len(item) - 1, -1, -1), reversed(item)))


def _node_schema(key: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc", key),
            T.StructField("node", T.IntegerType()),
            T.StructField("parent", T.IntegerType()),
            T.StructField("owner", T.IntegerType()),
            T.StructField("path", T.StringType()),
            T.StructField("label", T.StringType()),
            T.StructField("ordinal", T.IntegerType()),
            T.StructField("kind", T.StringType()),
            T.StructField("scalar", T.StringType()),
        ]
    )


def shred(
    df: DataFrame, key: str, payload: str, *, envelope: tuple[str, ...] = (), keep: Iterable[str] | None = None, unique: bool = False
) -> DataFrame:
    """The adjacency table of the JSON texts in ``payload``: one row a node.

    ``doc`` holds ``key``. Texts that can't be read, null texts and rows without a key give no
    node (see ``unreadable``). Several rows with one key: with ``unique`` the caller states
    that there are none; without it one of them, the smallest text, is taken. Other columns of
    ``df`` are not read.
    """
    rows = df.select(F.col(key).alias("doc"), F.col(payload).cast("string").alias("payload")).where("doc is not null")
    if not unique:
        rows = rows.groupBy("doc").agg(F.min("payload").alias("payload"))
    rows = spread(rows)
    schema = _node_schema(rows.schema["doc"].dataType)
    wanted = None if keep is None else frozenset(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            out: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    value = parse(text)
                except ValueError:
                    continue
                before = len(out)
                out.extend(walk(value, envelope, wanted))
                at.extend([i] * (len(out) - before))
                if len(out) > 200_000:
                    yield _batch(batch, at, out)
                    at, out = [], []
            if out:
                yield _batch(batch, at, out)

    return rows.mapInArrow(run, schema)


def _batch(batch: pa.RecordBatch, at: list[int], out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
    names = ["node", "parent", "owner", "path", "label", "ordinal", "kind", "scalar"]
    columns = [pa.array(x, k) for x, k in zip(zip(*out), kinds)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["doc", *names])


def unreadable(df: DataFrame, key: str, payload: str) -> DataFrame:
    """The keys of rows whose payload is null or can't be read, with the reason."""
    rows = df.select(F.col(key).alias("doc"), F.col(payload).cast("string").alias("payload"))
    schema = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), T.StructField("reason", T.StringType())])

    def run(batches):
        for batch in batches:
            at, why = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    parse(text)
                except ValueError as e:
                    at.append(i)
                    why.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(why, pa.string())], ["doc", "reason"])

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Child:
    """A kind of child element: where its objects lie and which scalar is its key.

    ``parent_path`` is the path of the object that its ``parent_pos`` counts; with ``tokens``
    the key's comma texts are split, each token is a row and ``child_pos`` counts tokens,
    ``parent_pos`` being the object's own place.
    """

    name: str
    path: str
    key: str
    parent_path: str | None = None
    tokens: bool = False

    @property
    def key_path(self) -> str:
        return f"{self.path}.{self.key}"


def needed_paths(children: Iterable[Child]) -> set[str]:
    return {p for c in children for p in (c.path, c.key_path, c.parent_path) if p is not None}


def child_keys(nodes: DataFrame, children: list[Child]) -> DataFrame:
    """(doc, child, parent_pos, child_pos, key_text): one row per key value of a child element.

    Null and blank values give no row but count as places. Object nodes meet their scalar
    children on (doc, owner) and their parent object on (doc, node).
    """
    def of(field: Column, value) -> Column:
        return F.coalesce(*[F.when(field == c.path, F.lit(value(c))) for c in children])

    objects = nodes.where((F.col("kind") == OBJECT) & F.col("path").isin([c.path for c in children])).select(
        "doc", "node", F.col("owner").alias("above"), "path", F.col("ordinal").alias("pos"), of(F.col("path"), lambda c: c.key_path).alias("key_path")
    )
    scalars = nodes.where(F.col("kind").isin(STRING, NUMBER, BOOLEAN) & F.col("path").isin([c.key_path for c in children])).where(strip("scalar") != "")
    scalars = scalars.select("doc", F.col("owner").alias("node"), F.col("path").alias("key_path"), F.col("node").alias("leaf"), "scalar")
    found = objects.join(scalars, ["doc", "node", "key_path"])
    parents = nodes.where((F.col("kind") == OBJECT) & F.col("path").isin([c.parent_path for c in children if c.parent_path])).select(
        "doc", F.col("node").alias("above"), F.col("ordinal").alias("above_pos")
    )
    linked = [c.path for c in children if c.parent_path]
    up = F.when(F.col("path").isin(linked), F.col("above"))
    found = found.withColumn("above", up).join(parents, ["doc", "above"], "left")
    plain = found.where(~F.col("path").isin([c.path for c in children if c.tokens])).select(
        "doc", of(F.col("path"), lambda c: c.name).alias("child"), F.coalesce("above_pos", F.lit(0)).alias("parent_pos"), F.col("pos").alias("child_pos"), F.col("scalar").alias("key_text")
    )
    if not any(c.tokens for c in children):
        return plain
    tokens = found.where(F.col("path").isin([c.path for c in children if c.tokens]))
    tokens = tokens.select("doc", "node", "path", "pos", "leaf", F.posexplode(split_ids(F.col("scalar"))).alias("at", "key_text"))
    order = Window.partitionBy("doc", "node").orderBy("leaf", "at")
    tokens = tokens.select(
        "doc", of(F.col("path"), lambda c: c.name).alias("child"), F.col("pos").alias("parent_pos"), (F.row_number().over(order) - 1).alias("child_pos"), "key_text"
    )
    return plain.unionByName(tokens)


def entity_table(nodes: DataFrame, path: str, columns: Mapping[str, str]) -> DataFrame:
    """The objects of ``path`` as a flat table: doc, node, parent_node, pos and ``columns``.

    ``columns`` maps a column's name to the label of a scalar child, or to a dotted path below
    the object. A field that holds a list gives its values in order, joined by ``;``; a missing
    or null field gives null. Objects without any of the fields keep their row.
    """
    objects = nodes.where((F.col("kind") == OBJECT) & (F.col("path") == path)).select(
        "doc", "node", F.col("owner").alias("parent_node"), F.col("ordinal").alias("pos")
    )
    prefix = path + "." if path else ""
    direct = {n: p for n, p in columns.items() if "." not in p}
    deep = {n: p for n, p in columns.items() if "." in p}
    scalars = nodes.where(F.col("kind").isin(STRING, NUMBER, BOOLEAN) & F.col("path").isin([prefix + p for p in direct.values()]))
    scalars = scalars.select("doc", F.col("owner").alias("node"), F.col("path").alias("field"), F.col("node").alias("leaf"), "scalar")
    for p in deep.values():  # climb from the leaf's owner to the object, one join a level
        part = nodes.where(F.col("kind").isin(STRING, NUMBER, BOOLEAN) & (F.col("path") == prefix + p)).select(
            "doc", F.col("owner").alias("node"), F.col("path").alias("field"), F.col("node").alias("leaf"), "scalar"
        )
        labels = p.split(".")[:-1]
        for depth in range(len(labels), 0, -1):
            step = nodes.where((F.col("kind") == OBJECT) & (F.col("path") == prefix + ".".join(labels[:depth]))).select("doc", "node", F.col("owner").alias("up"))
            part = part.join(step, ["doc", "node"]).drop("node").withColumnRenamed("up", "node")
        scalars = scalars.unionByName(part)
    def pick(p: str) -> Column:
        values = F.array_sort(F.collect_list(F.when(F.col("field") == prefix + p, F.struct("leaf", "scalar"))))
        return F.when(F.size(values) > 0, F.array_join(F.transform(values, lambda x: x["scalar"]), ";"))

    wide = scalars.groupBy("doc", "node").agg(*[pick(p).alias(n) for n, p in columns.items()])
    return objects.join(wide, ["doc", "node"], "left")
