"""The best record of each group of duplicates, from whole bundles of fields.

Fields that depend on each other form a bundle and are taken together, from one row. All bundles
of a survivor depend on its determinant (here: the assembly). ``survivors`` chooses the
determinant: there every bundle is its latest row and the objective is lexicographic, so that the
best branch is a least tuple of trusts, found by native aggregation. ``consistent_records`` fills
the chosen determinant's record where bundles have several alternatives: branch and bound over
whole bundles maximises their trust under functional dependencies between what they say.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Bundle:
    """Fields taken together: from the latest row in which ``present`` holds.

    ``trust`` (ascending is better, a double) ranks determinants by what the bundle holds;
    without it the bundle is only carried along.
    """

    name: str
    fields: tuple[str, ...]
    present: Column
    trust: Column | None = None
    missing_trust: float = float("inf")


def survivors(
    df: DataFrame, group: Sequence[str], determinant: str, ties: Sequence[Column], bundles: Sequence[Bundle], latest: Sequence[str], row_id: str
) -> DataFrame:
    """One row per group: ``group``, ``determinant``, ``n`` (rows of the group) and, of every
    bundle, ``<name>_row`` (``row_id`` of the row it was taken from, -1 if it is missing in all
    of the determinant's rows) and its fields (then null).

    ``latest`` orders the rows of a determinant (nulls first, then ``row_id``); ``ties`` are
    texts that settle equal trusts, the smaller first. Rows with a null group key or determinant
    take no part in the choice; those with a determinant missing still count in ``n``.

    Rows are reduced to one per group and determinant before and after the first shuffle, and
    those to one per group in every task before the second, however large a group is.
    """
    stamp = [F.col(x) for x in latest]
    known = df.where(" and ".join(f"`{g}` is not null" for g in group))
    picks = []
    for b in bundles:
        held = F.struct(*stamp, F.col(row_id).alias("_id"), *([b.trust.cast("double").alias("_trust")] if b.trust is not None else []), *[F.col(x) for x in b.fields])
        picks.append(F.max(F.when(b.present, held)).alias(b.name))
    per = known.groupBy(*group, determinant).agg(F.count("*").alias("n"), *picks)
    trusts = [F.coalesce(F.col(f"{b.name}._trust"), F.lit(b.missing_trust)) for b in bundles if b.trust is not None]
    order = F.struct(F.col(determinant).isNull(), *trusts, *[F.coalesce(t, F.lit("")) for t in ties])  # a row without determinant loses against any other
    out = F.struct(
        determinant,
        *[F.coalesce(F.col(f"{b.name}._id"), F.lit(-1)).cast("long").alias(f"{b.name}_row") for b in bundles],
        *[F.col(f"{b.name}.{x}").alias(x) for b in bundles for x in b.fields],
    )
    best = per.groupBy(*group).agg(F.sum("n").alias("n"), F.min_by(out, order).alias("_best"))
    names = [determinant, *[f"{b.name}_row" for b in bundles], *[x for b in bundles for x in b.fields]]
    return best.select(*group, F.col(f"_best.{determinant}").alias(determinant), "n", *[F.col(f"_best.{x}").alias(x) for x in names[1:]]).where(F.col(determinant).isNotNull())


Facts = Mapping[str, str]


@dataclass(frozen=True)
class Alternatives:
    """A bundle whose value is chosen among those that the determinant's rows hold.

    ``facts`` says what a value implies, by attribute; None if it contradicts itself. Two
    bundles that give one attribute different values can't stand in one record. It gets the
    fields and the determinant.
    """

    name: str
    fields: tuple[str, ...]
    present: Column
    facts: Callable[[tuple, str], Facts | None]


def branch_and_bound(bundles: Sequence[Sequence[tuple[float, Facts]]]) -> tuple[float, list[int | None], int]:
    """(trust, choice of each bundle, nodes visited) of the best consistent record.

    ``bundles``: (trust, facts) of the alternatives of each; trusts are above 0. None means
    that the bundle is left empty, which is always consistent and worth nothing. Bundles are
    decided in the order in which most trust hangs on them, each from its most trusted
    alternative on; a branch is left where even the most trusted alternatives of all open
    bundles can't beat the best record yet. Of equal records the first found stands.
    """
    ranked = [sorted(range(len(b)), key=lambda k, b=b: (-b[k][0], k)) for b in bundles]
    order = sorted(range(len(bundles)), key=lambda i: (-max((t for t, _ in bundles[i]), default=0.0), i))
    rest = [0.0] * (len(order) + 1)  # the most that the bundles from here on can add
    for d in range(len(order) - 1, -1, -1):
        rest[d] = rest[d + 1] + max((t for t, _ in bundles[order[d]]), default=0.0)
    best: list = [-1.0, [None] * len(bundles)]
    chosen: list[int | None] = [None] * len(bundles)
    nodes = 0

    def visit(depth: int, trust: float, known: dict[str, str]) -> None:
        nonlocal nodes
        nodes += 1
        if trust + rest[depth] <= best[0]:
            return
        if depth == len(order):
            best[0], best[1] = trust, list(chosen)
            return
        i = order[depth]
        for k in ranked[i]:
            more, facts = bundles[i][k]
            if trust + more + rest[depth + 1] <= best[0]:
                break
            if all(known.get(a, v) == v for a, v in facts.items()):
                chosen[i] = k
                visit(depth + 1, trust + more, {**known, **facts})
        chosen[i] = None
        visit(depth + 1, trust, known)

    visit(0, 0.0, {})
    return best[0], best[1], nodes


def consistent_records(
    df: DataFrame, chosen: DataFrame, group: Sequence[str], determinant: str, bundles: Sequence[Alternatives], latest: Sequence[str], row_id: str, roots: Callable[[str], Facts] = lambda _: {}
) -> DataFrame:
    """(group, determinant, and of every bundle ``<name>_row`` and its fields as texts) for each row of ``chosen``
    (group, determinant): whole bundles from the determinant's rows of ``df``, together consistent.

    A value's trust is the number of rows that hold it, and half a row more for the latest one. ``roots`` gives what the
    determinant itself implies. ``<name>_row`` is the latest row that holds the chosen value, -1 for an empty bundle.

    Equal values are counted before anything is shuffled; what meets in one place are the different values of one determinant.
    """
    stamp = [F.col(x) for x in latest]
    at = F.struct(*stamp, F.col(row_id).cast("long").alias("_id"))
    long = [F.when(b.present, F.struct(F.lit(i).alias("bundle"), F.array(*[F.col(x).cast("string") for x in b.fields]).alias("held"))) for i, b in enumerate(bundles)]
    values = df.select(*group, determinant, at.alias("at"), F.explode(F.array_compact(F.array(*long))).alias("x"))
    values = values.groupBy(*group, determinant, "x.bundle", "x.held").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    own = chosen.select(*group, determinant).join(values, [*group, determinant], "left")
    lists = own.groupBy(*group, determinant).agg(F.sort_array(F.collect_list(F.struct("bundle", "at", "n", "held")), asc=False).alias("values"))
    lists = lists.select(*group, determinant, F.transform("values", lambda v: F.struct(v["bundle"].alias("bundle"), v["at"]["_id"].alias("id"), v["n"].alias("n"), v["held"].alias("held"))).alias("values"))
    keys = len(group) + 1
    schema = T.StructType(lists.schema.fields[:keys])
    for b in bundles:
        schema.add(f"{b.name}_row", T.LongType())
        for x in b.fields:
            schema.add(x, T.StringType())

    says, widths = [b.facts for b in bundles], [len(b.fields) for b in bundles]  # columns can't be sent

    def run(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in schema.fields[keys:]]
            for name, found in zip(batch.column(keys - 1).to_pylist(), batch.column(keys).to_pylist()):
                options: list[list[tuple[float, Facts]]] = [[] for _ in says]
                rows: list[list[tuple]] = [[] for _ in says]
                newest = set()
                root = roots(name)
                for v in found:  # latest first
                    i = v["bundle"]
                    if i is None:
                        continue
                    held = tuple(v["held"])
                    facts = says[i](held, name)
                    late = i not in newest
                    newest.add(i)
                    if facts is not None and all(root.get(a, x) == x for a, x in facts.items()):
                        options[i].append((v["n"] + 0.5 * late, facts))
                        rows[i].append((v["id"], *held))
                _, picked, _ = branch_and_bound(options)
                out = [x for i, k in enumerate(picked) for x in ((-1, *[None] * widths[i]) if k is None else rows[i][k])]
                for c, x in zip(columns, out):
                    c.append(x)
            kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in schema.fields[keys:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keys], *(pa.array(c, k) for c, k in zip(columns, kinds))], schema.names)

    return lists.mapInArrow(run, schema)
