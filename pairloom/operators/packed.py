"""Several values packed in one field: one row a value, with its place.

A field is scanned into atoms: quoted spans, which stay whole, and runs of other text between
separators and white space. How neighbouring atoms join to values is a lattice: a span of as many
atoms as any value of the column has is a possible value. Value frequencies are learned from the
whole column by expectation maximisation over the lattices of all distinct sides with more than
one path, starting from the usual cuts (separators outside quotes cut, white space doesn't), and
Viterbi picks each side's cuts. Sides with one path are fixed evidence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.session import bounded_rows, spread, stage

# Separators, quotes and brackets that are understood.
BARS = "|¦｜∣│ǀ‖❘︱"
STRONG = ",;/&+\t\n\r，；／＆＋、"
BLANK = "\t\n\r"
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»", "‘": "’", "＂": "＂"}
OPEN, CLOSE = "[{", "]}"

#: Decisions and supported spans are sent to every task up to this many rows; beyond it they are joined.
BROADCAST_ROWS = 100_000

PAIR, MULTI = "pair", "multi"


@dataclass(frozen=True)
class Atom:
    start: int
    end: int
    value: str
    quoted: bool


def has_value(text: str) -> bool:
    return any(c.isalnum() for c in text)


def _quoted(text: str, at: int, ends: str) -> tuple[str, int] | None:
    """The quoted span that opens at ``at``: its value and the place behind it."""
    close, out, i = QUOTES[text[at]], [], at + 1
    while i < len(text):
        c = text[i]
        if c == close:
            if close == text[at] and text[i + 1 : i + 2] == c:
                out.append(c)
                i += 2
                continue
            k = i + 1
            while k < len(text) and text[k].isspace():
                k += 1
            if k == len(text) or text[k] in ends or text[k] in CLOSE or (k > i + 1 and text[k] in QUOTES):
                return "".join(out), i + 1
        out.append(c)
        i += 1
    return None


def _parts(text: str, at: int, seps: str) -> bool:
    """Whether a tab or line break parts values: not at an end, beside a separator or another of its kind."""
    i, j = at - 1, at + 1
    while i >= 0 and text[i].isspace() and text[i] not in BLANK:
        i -= 1
    while j < len(text) and text[j].isspace():
        j += 1
    return i >= 0 and j < len(text) and text[i] not in seps and text[j] not in seps


def cut(text: str, seps: str, at: list[int] | None = None) -> list[list[Atom]]:
    """The slots of ``text`` between the separators ``seps``, each with its atoms; ``at`` gets the places of the separators.

    A slot mostly has one atom or none; several stand where quoted spans follow each other
    without a separator. Brackets at the ends of a slot are left out.
    """
    slots: list[list[Atom]] = [[]]
    start, i, fresh = 0, 0, True

    def flush(end: int) -> None:
        a, b = start, end
        while a < b and (text[a].isspace() or text[a] in OPEN):
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in CLOSE and not any(x in text[a:b] for x in OPEN)):
            b -= 1
        if b > a:
            slots[-1].append(Atom(a, b, _bare(text[a:b]), False))

    while i < len(text):
        c = text[i]
        if c in seps and (c not in BLANK or _parts(text, i, seps)):
            flush(i)
            slots.append([])
            if at is not None:
                at.append(i)
            i, fresh = i + 1, True
            start = i
        elif fresh and c in QUOTES and (q := _quoted(text, i, seps)):
            flush(i)
            slots[-1].append(Atom(i, q[1], q[0].strip(), True))
            start = i = q[1]
        else:
            fresh = fresh and (c.isspace() or c in OPEN or c in CLOSE)
            i += 1
    flush(len(text))
    return slots


def _bare(value: str) -> str:
    """Without brackets that enclose the whole value."""
    while len(value) > 1 and (value[0] + value[-1]) in ("()", "[]", "{}", "<>"):
        inner, depth = value[1:-1], 0
        for c in inner:
            depth += (c == value[0]) - (c == value[-1])
            if depth < 0:
                return value
        value = inner.strip()
    return value


def unwrap(text: str) -> str:
    """Without quotes that enclose the whole field: they wrap the pair, not a value."""
    inner = text.strip()
    if len(inner) > 2 and inner[0] in QUOTES and inner[-1] == QUOTES[inner[0]] and QUOTES[inner[0]] not in inner[1:-1] and inner[0] not in inner[1:-1]:
        return inner[1:-1]
    return text


def sides(text: str, mode: str) -> list[tuple[str, list[list[Atom]]]]:
    """The sides of a field: the text of each and its slots.

    MULTI: bars part the sides. PAIR: the whole field is one text whose slots are the sides.
    """
    if mode == PAIR:
        inner = unwrap(text)
        return [(inner, cut(inner, BARS + STRONG))]
    at: list[int] = []
    cut(text, BARS + STRONG, at)
    bounds = [-1, *(i for i in at if text[i] in BARS), len(text)]
    out = [text[a + 1 : b] for a, b in zip(bounds, bounds[1:])]
    while len(out) > 2 and any(not has_value(x) for x in out[1:-1]):  # doubled bars
        out.pop(next(i for i in range(1, len(out) - 1) if not has_value(out[i])))
    return [(x, cut(x, STRONG)) for x in out]


def finest(slots: list[list[Atom]], text: str) -> list[Atom]:
    """The atoms of the lattice: unquoted ones are parted at white space too."""
    out: list[Atom] = []
    for slot in slots:
        for a in slot:
            if a.quoted or a.value != text[a.start : a.end]:
                out.append(a)
                continue
            i = a.start
            while i < a.end:
                while i < a.end and text[i].isspace():
                    i += 1
                j = i
                while j < a.end and not text[j].isspace():
                    j += 1
                if j > i:
                    out.append(Atom(i, j, text[i:j], False))
                i = j
    return out


def inner(text: str, seps: str) -> int:
    return sum(c in seps for c in text)


def lattice(text: str, mode: str, longest: int | None = None) -> list[tuple[int, int, str, bool]]:
    """(first atom, last atom, value, usual) of a side; quoted atoms are never joined to others.

    Spans of more than ``longest`` atoms are no values, but for those of the usual cut; None means no limit.
    """
    slots = cut(text, BARS + STRONG if mode == PAIR else STRONG)
    atoms = finest(slots, text)
    usual = {(a.start, a.end) for _, a in default_values(text, slots, mode)}
    ends = {a.end: k for k, a in enumerate(atoms)}
    reach = _reach(atoms, usual, ends)
    out = []
    for i, a in enumerate(atoms):
        out.append((i, i, a.value, (a.start, a.end) in usual))
        if a.quoted:
            continue
        far = len(atoms) if longest is None else i + longest
        for j in range(i + 1, min(len(atoms), max(far, reach.get(i, i) + 1))):
            if atoms[j].quoted:
                break
            if j < far or j == reach[i]:
                out.append((i, j, text[a.start : atoms[j].end], (a.start, atoms[j].end) in usual))
    return out


def _reach(atoms: list[Atom], usual: set[tuple[int, int]], ends: dict[int, int]) -> dict[int, int]:
    """By the first atom of a usual value its last one."""
    starts = {a.start: k for k, a in enumerate(atoms)}
    return {starts[s]: ends[e] for s, e in usual if s in starts and e in ends}


#: Log penalties of a value never counted: for being new, for each separator and each white space in it.
NEW, PER_STRONG, PER_SPACE = 4.0, 6.0, 1.0


def score(value: str, count: float, total: float) -> float:
    """Log probability of a value. A new one with a separator in it is worth less than the new values it could be cut into, however large the column."""
    missed = inner(value, BARS + STRONG)
    fresh = -NEW - missed * (PER_STRONG + NEW + math.log(total + 1.0)) - PER_SPACE * len(value.split()[1:])
    return math.log(count + math.exp(max(fresh, -700.0))) - math.log(total + 1.0)


def posterior(segments: list[tuple[int, int, float]]) -> list[float]:
    """Of each (first, last, log score) the probability that a path through the lattice uses it."""
    n = 1 + max((j for _, j, _ in segments), default=-1)
    ahead, back = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    ahead[0] = back[n] = 0.0
    for i, j, s in sorted(segments):
        ahead[j + 1] = _log_add(ahead[j + 1], ahead[i] + s)
    for i, j, s in sorted(segments, key=lambda x: -x[1]):
        back[i] = _log_add(back[i], back[j + 1] + s)
    return [math.exp(ahead[i] + s + back[j + 1] - ahead[n]) for i, j, s in segments]


def _log_add(a: float, b: float) -> float:
    if a == -math.inf or b == -math.inf:
        return max(a, b)
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def viterbi(segments: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The best path through the lattice; of equal ones that with the longer first value."""
    n = 1 + max((j for _, j, _ in segments), default=-1)
    best: list[tuple[float, int, tuple[int, int] | None]] = [(-math.inf, 0, None)] * (n + 1)
    best[n] = (0.0, 0, None)
    for i, j, s in sorted(segments, key=lambda x: (-x[0], x[1])):
        if (now := (s + best[j + 1][0], j)) > best[i][:2]:
            best[i] = (*now, (i, j))
    path, at = [], 0
    while at < n and best[at][2]:
        path.append(best[at][2])
        at = best[at][2][1] + 1
    return path


def default_values(text: str, slots: list[list[Atom]], mode: str) -> list[tuple[int, Atom]]:
    """(slot, atom) without the column's word: separators cut; in a pair of one slot white space does."""
    if mode == PAIR and sum(has_value(a.value) for s in slots for a in s) == 1:
        atoms = [a for a in finest(slots, text) if has_value(a.value)]
        if len(atoms) == 2 and len([s for s in slots if s]) == 1:
            return list(enumerate(atoms))
    if mode == PAIR:
        slots = list(slots)
        while len(slots) > 2 and (empty := [k for k in range(1, len(slots)) if not slots[k]]):  # doubled or trailing separators
            slots.pop(empty[0])
    out, slot_no = [], 0
    for slot in slots:
        for a in slot or [None]:
            if a is not None:
                out.append((slot_no, a))
            slot_no += 1
    return out


def values(text: str | None, mode: str, decide) -> Iterator[tuple[int, int, str]]:
    """(side_no, value_no, part_value) of a field; ``decide(side text)`` gives learned cuts, or None for the usual ones."""
    if text is None:
        return
    for side_no, (part, slots) in enumerate(sides(text, mode), 1):
        chosen = decide(part)
        if chosen is not None:
            atoms = finest(slots, part)
            found = [(k, Atom(atoms[i].start, atoms[j].end, atoms[i].value if i == j else part[atoms[i].start : atoms[j].end], False)) for k, (i, j) in enumerate(chosen)]
        else:
            found = default_values(part, slots, mode)
        if mode == PAIR:
            extra = 1
            for slot, a in found:
                if has_value(a.value):
                    extra = extra + 1 if slot > 1 else 1
                    yield min(slot, 1) + 1, extra if slot > 1 else 1, a.value
        else:
            for value_no, a in enumerate((a for _, a in found if has_value(a.value)), 1):
                yield min(side_no, 2), value_no, a.value


def _split(batches, read, schema):
    arrow = T_to_arrow(schema)
    for batch in batches:
        out = [x for row in zip(*[c.to_pylist() for c in batch.columns]) for x in read(row)]
        columns = zip(*out) if out else [()] * len(arrow)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


def T_to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


TEXTS = "table_name string, field_name string, mode string, text string, n long"


def column_values(texts: DataFrame) -> DataFrame:
    """(table_name, field_name, value, quoted, n) of the default cuts, over all distinct texts."""
    schema = T._parse_datatype_string("table_name string, field_name string, value string, quoted boolean, n long")

    def read(row):
        table, field, mode, text, n = row
        for part, slots in sides(text, mode):
            for _, a in default_values(part, slots, mode):
                if has_value(a.value):
                    yield table, field, a.value, a.quoted, n

    found = texts.select("table_name", "field_name", "mode", "text", "n").mapInArrow(lambda it: _split(it, read, schema), schema)
    return found.groupBy("table_name", "field_name", "value").agg(F.max("quoted").alias("quoted"), F.sum("n").alias("n"))


def longest_values(counts: DataFrame) -> dict[tuple[str, str], int]:
    """(table, field) -> the most atoms that a value has, if quotes and separators are taken as they are. A row a column."""
    parts = "[\\s" + "".join("\\" + c for c in BARS + STRONG) + "]+"
    atoms = F.size(F.filter(F.split("value", parts), lambda x: x != ""))
    return {(r[0], r[1]): r[2] for r in counts.groupBy("table_name", "field_name").agg(F.max(atoms)).collect()}


SIDES = "table_name string, field_name string, mode string, side string, n long"
LATTICES = "sid long, table_name string, field_name string, side string, n long, segments array<struct<i: int, j: int, value: string, usual: boolean>>"


def lattices(texts: DataFrame, longest: dict[tuple[str, str], int]) -> DataFrame:
    """LATTICES: every distinct side with more than one path, how often it occurs and its possible values."""
    schema, wide = T._parse_datatype_string(SIDES), T._parse_datatype_string(LATTICES)

    def ambiguous(row):
        table, field, mode, text, n = row
        if longest.get((table, field), 1) < 2:
            return
        for part, _ in sides(text, mode):
            found = lattice(part, mode, longest[table, field])
            if found and found[-1][0] + 1 < len(found):
                yield table, field, mode, part, n

    def spans(row):
        sid, table, field, mode, side, n = row
        yield sid, table, field, side, n, [{"i": i, "j": j, "value": v, "usual": u} for i, j, v, u in lattice(side, mode, longest[table, field])]

    found = texts.select("table_name", "field_name", "mode", "text", "n").mapInArrow(lambda it: _split(it, ambiguous, schema), schema)
    once = found.groupBy("table_name", "field_name", "mode", "side").agg(F.sum("n").alias("n")).select(F.monotonically_increasing_id().alias("sid"), "*")
    return once.mapInArrow(lambda it: _split(it, spans, wide), wide)


def learn(counts: DataFrame, found: DataFrame, rounds: int = 2) -> DataFrame:
    """(table_name, field_name, side, cuts, changed): Viterbi's cuts of every side of ``found``, and whether they are not the usual ones.

    Counts of the other sides are fixed evidence; each round adds the expected counts of the
    lattices under the counts of the round before. What a side itself adds is left out of its own
    evidence, else long values that occur but once would confirm themselves.
    """
    name = ["table_name", "field_name", "value"]
    expect, best = F.pandas_udf(_expect, "array<double>"), F.pandas_udf(_best, "struct<cuts: array<array<int>>, changed: boolean>")
    x = [F.col(f"x.{c}").alias(c) for c in ("i", "j", "value", "usual")]
    segments = found.select("sid", "table_name", "field_name", "n", F.explode("segments").alias("x")).select("sid", "table_name", "field_name", "n", *x, F.col("x.usual").cast("double").alias("p"))
    own = segments.groupBy(*name).agg(F.sum(F.col("p") * F.col("n")).alias("own"))
    fixed = own.join(counts, name, "left").select(*name, F.greatest(F.lit(0.0), F.coalesce("n", F.lit(0)) - F.col("own")).alias("c"))
    fixed = stage(fixed, "evidence")
    total = counts.groupBy("table_name", "field_name").agg(F.sum("n").cast("double").alias("total"))  # a row a column
    for k in range(rounds + 1):
        added = segments.where("p > 0").select(*name, (F.col("p") * F.col("n")).alias("c"))
        c = fixed.unionByName(added).groupBy(*name).agg(F.sum("c").alias("c")).where("c > 0")
        scored = segments.join(c, name, "left").join(F.broadcast(total), ["table_name", "field_name"], "left")
        others = F.greatest(F.lit(0.0), F.coalesce("c", F.lit(0.0)) - F.col("p") * F.col("n"))
        grouped = scored.groupBy("sid").agg(
            F.sort_array(F.collect_list(F.struct("i", "j", "value", "usual", others.alias("c")))).alias("segs"),
            F.first("total").alias("total"), F.first("n").alias("n"), F.first("table_name").alias("table_name"), F.first("field_name").alias("field_name"),
        )
        if k == rounds:
            decided = grouped.select("sid", best(F.col("segs"), F.col("total")).alias("x")).select("sid", "x.*")
            return found.select("sid", "table_name", "field_name", "side").join(decided, "sid").drop("sid")
        met = F.arrays_zip(F.col("segs").alias("s"), expect(F.col("segs"), F.col("total")).alias("p"))
        segments = grouped.select("sid", "table_name", "field_name", "n", F.explode(met).alias("x")).select("sid", "table_name", "field_name", "n", *[F.col(f"x.s.{f}").alias(f) for f in ("i", "j", "value", "usual")], "x.p")
        segments = stage(segments, "segments")
    raise AssertionError


def _scored(segs, total: float) -> list[tuple[int, int, float]]:
    return [(int(s["i"]), int(s["j"]), score(s["value"], float(s["c"]), total or 1.0)) for s in segs]


def _expect(segs: pd.Series, total: pd.Series) -> pd.Series:
    return pd.Series([posterior(_scored(s, t)) for s, t in zip(segs, total)])


def _best(segs: pd.Series, total: pd.Series) -> pd.DataFrame:
    cuts = [viterbi(_scored(s, t)) for s, t in zip(segs, total)]
    usual = [{(int(x["i"]), int(x["j"])) for x in s if x["usual"]} for s in segs]
    return pd.DataFrame({"cuts": [[list(x) for x in c] for c in cuts], "changed": [set(c) != u for c, u in zip(cuts, usual)]})


PARTS = "table_name string, row_id long, field_name string, side_no int, value_no int, part_value string"


@dataclass(frozen=True)
class Field:
    table: str
    column: str
    key: str
    mode: str


def unpack(tables: dict[str, DataFrame], fields: list[Field]) -> DataFrame:
    """One row per value: table_name, row_id, field_name, side_no, value_no, part_value.

    Null fields and slots without letter or digit give no row; repeated rows count each, a null
    key stays null. In a PAIR field a value beyond the second slot stands on side 2 with
    value_no counting on. Other columns of the tables are not read.
    """
    rows = None
    for f in fields:
        part = tables[f.table].select(
            F.lit(f.table).alias("table_name"), F.col(f.key).cast("long").alias("row_id"), F.lit(f.column).alias("field_name"), F.lit(f.mode).alias("mode"), F.col(f.column).cast("string").alias("text")
        )
        rows = part if rows is None else rows.unionByName(part)
    rows = spread(rows.where(F.col("text").isNotNull()))
    texts = rows.groupBy("table_name", "field_name", "mode", "text").agg(F.count("*").alias("n"))
    texts = spread(stage(texts, "texts"))
    counts = stage(column_values(texts), "values")
    found = stage(lattices(texts, longest_values(counts)), "lattices")
    decided = None if found.isEmpty() else stage(learn(counts, found), "cuts").where("changed").drop("changed")  # the others are cut as usual
    small = [] if decided is None else bounded_rows(decided, BROADCAST_ROWS)
    schema = T._parse_datatype_string(PARTS)
    if small is not None:
        chosen = {(r["table_name"], r["field_name"], r["side"]): [tuple(x) for x in r["cuts"]] for r in small}

        def run(batches):
            for batch in batches:
                at: list[int] = []
                out: list[tuple] = []
                memo: dict = {}
                for i, (table, _, field, mode, text) in enumerate(zip(*[c.to_pylist() for c in batch.columns])):
                    if (known := memo.get((table, field, text))) is None:
                        known = memo[table, field, text] = list(values(text, mode, lambda side: chosen.get((table, field, side))))
                    out.extend(known)
                    at.extend([i] * len(known))
                index = pa.array(at, pa.int64())
                found = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(index), batch.column(1).take(index), batch.column(2).take(index), pa.array(found[0], pa.int32()), pa.array(found[1], pa.int32()), pa.array(found[2], pa.string())],
                    [f.name for f in schema],
                )

        return rows.select("table_name", "row_id", "field_name", "mode", "text").mapInArrow(run, schema)
    # too many decisions to send: each distinct text meets its own by a join, then its rows
    def ask(row):
        table, field, mode, text, _ = row
        for part, _ in sides(text, mode):
            yield table, field, mode, text, part

    asked = T._parse_datatype_string("table_name string, field_name string, mode string, text string, side string")
    per_side = texts.mapInArrow(lambda it: _split(it, ask, asked), asked).distinct().join(decided, ["table_name", "field_name", "side"])
    per_text = per_side.groupBy("table_name", "field_name", "mode", "text").agg(F.map_from_entries(F.collect_set(F.struct("side", "cuts"))).alias("own"))
    cuts = texts.join(per_text, ["table_name", "field_name", "mode", "text"], "left").select("table_name", "field_name", "mode", "text", "own")

    def parts(row):
        table, field, mode, text, own = row
        own = dict(own or [])
        for side_no, value_no, v in values(text, mode, lambda side: own.get(side)):
            yield table, field, text, side_no, value_no, v

    wide = T._parse_datatype_string("table_name string, field_name string, text string, side_no int, value_no int, part_value string")
    found = cuts.mapInArrow(lambda it: _split(it, parts, wide), wide)
    return rows.join(found, ["table_name", "field_name", "text"]).select([f.name for f in schema])


def pair_columns(df: DataFrame, column: str, *, exact: bool = False) -> DataFrame:
    """``df`` with ``side_1`` and ``side_2`` of the PAIR field ``column``, cut as usual (null where a side has no value).

    With ``exact`` both are null unless the field holds just two values.
    """
    schema = T.StructType([*df.schema, T.StructField("side_1", T.StringType()), T.StructField("side_2", T.StringType())])
    at, names = df.columns.index(column), [*df.columns, "side_1", "side_2"]

    def run(batches):
        for batch in batches:
            memo: dict[str | None, tuple[str | None, str | None]] = {}
            for text in batch.column(at).unique().to_pylist():
                found = list(values(text, PAIR, lambda _: None))
                got = {side: v for side, no, v in found if no == 1}
                memo[text] = (got.get(1), got.get(2)) if not exact or len(found) == len(got) == 2 else (None, None)
            one, two = zip(*map(memo.__getitem__, batch.column(at).to_pylist())) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one, pa.string()), pa.array(two, pa.string())], names)

    return df.mapInArrow(run, schema)
