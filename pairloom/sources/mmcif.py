"""Structure files in mmCIF form as rows of the few categories that sequences are taken from.

Every file is read and parsed once, in one task, plain or gzipped. Categories: ``remap``
(new entity, original entity), ``asym`` (chain, entity), ``poly_seq`` (entity, residue name),
``residue`` (chain, residue number; once for each pair) and ``error`` (reason, null).
"""

from __future__ import annotations

import gzip
import posixpath
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pairloom.schemas import STRUCTURE_ROWS

_TOKEN = re.compile(r"""'(?:[^']|'(?=\S))*'(?=\s|$)|"(?:[^"]|"(?=\S))*"(?=\s|$)|#.*|\S+""")
#: Category, and its two columns (None: the first and second, whatever their names).
WANTED = {
    "_pdbx_entity_remapping": ("remap", None),
    "_struct_asym": ("asym", ("id", "entity_id")),
    "_entity_poly_seq": ("poly_seq", ("entity_id", "mon_id")),
    "_atom_site": ("residue", ("label_asym_id", "label_seq_id")),
}


class BadFile(ValueError):
    pass


def tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(token, quoted) of a CIF text; comments are left out."""
    block: list[str] | None = None
    for line in text.splitlines():
        if block is not None:
            if line.startswith(";"):
                yield "\n".join(block), True
                block = None
                line = line[1:]
            else:
                block.append(line)
                continue
        elif line.startswith(";"):
            block = [line[1:]]
            continue
        if "'" not in line and '"' not in line and "#" not in line:
            for t in line.split():
                yield t, False
            continue
        for m in _TOKEN.finditer(line):
            t = m[0]
            if t[0] == "#":
                break
            yield (t[1:-1], True) if t[0] in "'\"" and len(t) > 1 and t[-1] == t[0] else (t, False)
    if block is not None:
        raise BadFile("text block without an end")


def tables(text: str) -> Iterator[tuple[str, list[str], list[str]]]:
    """(category, column names, values row by row) of the wanted categories; exactly one data block is allowed."""
    blocks = 0
    items: dict[str, tuple[list[str], list[str]]] = {}
    names: list[str] = []
    values: list[str] = []
    in_loop = heading = False
    pending: str | None = None

    def done() -> Iterator[tuple[str, list[str], list[str]]]:
        if names and (category := names[0].partition(".")[0].lower()) in WANTED:
            if len(values) % len(names):
                raise BadFile(f"{category} has an incomplete row")
            yield category, [n.partition(".")[2] for n in names], values

    for t, quoted in tokens(text):
        low = t.lower() if not quoted else ""
        if low.startswith("data_"):
            blocks += 1
            if blocks > 1:
                raise BadFile("more than one data block")
            if in_loop:
                yield from done()
            in_loop = heading = False
            names, values = [], []
        elif low == "loop_":
            if in_loop:
                yield from done()
            in_loop = heading = True
            names, values = [], []
        elif low.startswith("_"):
            if in_loop and heading:
                names.append(t)
                continue
            if in_loop:
                yield from done()
                in_loop, names, values = False, [], []
            pending = t
        elif in_loop:
            heading = False
            values.append(t)
        elif pending is not None:
            category, _, name = pending.partition(".")
            if category.lower() in WANTED:
                own = items.setdefault(category.lower(), ([], []))
                own[0].append(name)
                own[1].append(t)
            pending = None
    if in_loop:
        yield from done()
    if blocks == 0:
        raise BadFile("no data block")
    for category, (own_names, own_values) in items.items():
        yield category, own_names, own_values


def rows(text: str) -> list[tuple[str, int, str, str]]:
    """(category, ord, a, b) of the wanted columns."""
    out: list[tuple[str, int, str, str]] = []
    for category, names, values in tables(text):
        kind, columns = WANTED[category]
        low = [n.lower() for n in names]
        try:
            i, j = (0, 1) if columns is None else (low.index(columns[0]), low.index(columns[1]))
        except ValueError:
            raise BadFile(f"{category} lacks a column") from None
        if columns is None and len(names) < 2:
            raise BadFile(f"{category} lacks a column")
        pairs = zip(values[i :: len(names)], values[j :: len(names)])
        if kind == "residue":
            pairs = dict.fromkeys(pairs)
        out.extend((kind, n, a, b) for n, (a, b) in enumerate(pairs))
    return out


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """STRUCTURE_ROWS of all files below ``path``; ``file`` is a file's name. An unreadable file gives one ``error`` row; a file of no bytes gives none and so counts as missing."""
    return parse_structures(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.cif*").load(path))


def parse_structures(files: DataFrame) -> DataFrame:
    """STRUCTURE_ROWS of files given as (path, content); other columns are not read, null contents give no row."""
    files = files.select("path", "content").where("content is not null")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = posixpath.basename(name)
                try:
                    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                    found = rows(data.decode("utf-8", "replace"))
                except (BadFile, OSError, EOFError, zlib.error) as e:
                    found = [("error", 0, str(e), None)]
                found = found or [("error", 0, "no wanted category", None)]
                kinds, ords, a, b = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(found)), pa.array(kinds), pa.array(ords, pa.int32()), pa.array(a, pa.string()), pa.array(b, pa.string())], STRUCTURE_ROWS.names
                )

    return files.mapInArrow(run, STRUCTURE_ROWS)
