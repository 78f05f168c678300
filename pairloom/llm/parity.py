"""Near-duplicate sets of tokens by a parity-sketch join.

A record's tokens are hashed into the cells of its size band; a cell holds the XOR of its
tokens' hashes, so a token that only one of two records has changes one cell, and the number of
cells that differ is at most the symmetric difference. Records that are similar enough therefore
agree in some non-empty cells, and by the pigeonhole principle in one of their rarest ones: only
these are joined. A short sketch with one parity bit a token then bounds the symmetric difference
of each candidate pair from below by its Hamming distance; what passes is verified on the tokens.

Bounds. Sets of sizes n <= m with a Jaccard similarity of at least t = p/q share at least
p(n+m)/(p+q) tokens and differ in at most (q-p)(n+m)/(q+p); m is at most n q/p. The smaller
record need only offer for its nearest partner, the larger one for its smallest, so the two roles
offer different numbers of cells and meet in one join. With s non-empty cells, g of which must
agree, the rarest s - g + k hold k cells of every partner.

Where t is at least SEVERAL, a cell holds up to PER tokens, which makes cells of common tokens
rare. A record whose tokens fell together so that no cell must agree meets all others in one-token
cells. Below SEVERAL differences may touch every such cell, and all cells hold one token.
Sequences, whose tokens are their windows, meet by runs of windows instead (``runs``); only those
for which no run must be common meet the others by cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.runs import LAST, MEET, PACKED, RunReader, least, meet, pack, parts_of, scatter, unneeded
from pairloom.session import stage

BITS = 1024
WHOLE = 12
#: From this threshold on cells hold several tokens, at most about PER.
SEVERAL, PER = Fraction(4, 5), 2
#: Sizes up to FIRST are one band; each further band reaches twice as far.
FIRST = 32
#: Cells are counted in so many buckets, whatever the number of records; counts only put cells in order.
BUCKETS, PARTS = 1 << 21, 64
#: Cells that so many records or more share (by their bucket) are joined in SALTS parts (see ``_meet_heavy``).
HEAVY, SALTS = 500, 16
#: Records worked on at a time.
SLICE = 2_000
#: Up to so many candidates, or irregular records, are sent to the records; more are joined.
BROADCAST_PAIRS = 250_000
SMALLER, LARGER = 0, 1

Reader = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters them."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def band_of(n: np.ndarray) -> np.ndarray:
    """The size band: 0 up to FIRST, then one for each doubling."""
    return np.ceil(np.maximum(0.0, np.log2(np.maximum(n, 1) / FIRST)) - 1e-12).astype(np.int64)


def cells_of(record: np.ndarray, hashes: np.ndarray, band: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(record, signature) of every non-empty cell; ``band`` is each token's record's band, or None for one-token cells."""
    if band is None:
        return record, hashes
    count = (np.uint64(max(1, FIRST // PER)) << band.astype(np.uint64)).astype(np.uint64)
    cell = hashes % count
    order = np.lexsort((cell, record))
    record, cell, hashes, band = record[order], cell[order], hashes[order], band[order]
    first = np.flatnonzero(np.r_[True, (record[1:] != record[:-1]) | (cell[1:] != cell[:-1])]) if len(record) else np.zeros(0, np.int64)
    parity = np.bitwise_xor.reduceat(hashes, first) if len(first) else hashes
    record, cell, band = record[first], cell[first], band[first]
    with np.errstate(over="ignore"):
        signature = mix(parity ^ mix(cell * np.uint64(1 << 8) + band.astype(np.uint64) + np.uint64(1)))
    full = parity != 0
    return record[full], signature[full]


def sketches(record: np.ndarray, hashes: np.ndarray, records: int) -> np.ndarray:
    """One parity bit a token: ``records`` rows of BITS / 64 words."""
    at = (hashes >> np.uint64(40)) % np.uint64(BITS)
    odd = (np.bincount(record * BITS + at.astype(np.int64), minlength=records * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(records, BITS), axis=1, bitorder="little").view(np.int64)


def token_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column in order, each value once a row and without nulls."""
    flat = column.flatten()
    sizes = np.diff(column.offsets.to_numpy())
    if column.null_count:
        sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    row = np.repeat(np.arange(len(column)), sizes)
    if flat.null_count:
        there = flat.is_valid().to_numpy(zero_copy_only=False)
        row, flat = row[there], flat.drop_null()
    value = flat.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[first], value[first]


class _Cells:
    """The cells of a slice of records, and how many of them must agree."""

    def __init__(self, column: pa.Array, read: Reader, t: Fraction, several: bool):
        self.rows = len(column)
        self.record, tokens = read(column)
        with np.errstate(over="ignore"):
            self.hashes = mix(tokens.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        self.n = np.bincount(self.record, minlength=self.rows)
        p, q, n = t.numerator, t.denominator, self.n
        if several:
            band = band_of(n)
            largest = n * q // p  # a partner may lie a band up, or more where bands are narrow
            self.bands = [band]
            while (more := band_of(largest) > self.bands[-1]).any():
                self.bands.append(np.where(more, self.bands[-1] + 1, self.bands[-1]))
            self.differ = [(q - p) * (n + largest) // (q + p), (q - p) * 2 * n // (q + p)]
        else:
            self.bands = [None]
            self.agree = [-(-2 * p * n // (p + q)), -(-p * n // q)]
        self.several = several

    def role(self, role: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(record, signature, cells of each record that must agree with any partner of that role) by band."""
        for k, band in enumerate(self.bands[: 1 if role == LARGER else None]):
            if band is None:
                yield self.record, self.hashes, self.agree[role]
                continue
            own = band[self.record]
            take = np.ones(len(own), bool) if k == 0 else (own > self.bands[k - 1][self.record])
            record, signature = cells_of(self.record[take], self.hashes[take], own[take])
            there = np.ones(self.rows, bool) if k == 0 else band > self.bands[k - 1]
            yield record, signature, np.where(there, np.bincount(record, minlength=self.rows) - self.differ[role], 1)

    def regular(self) -> np.ndarray:
        """Whether some cell must agree in every band and role."""
        good = np.ones(self.rows, bool)
        for role in (SMALLER, LARGER):
            for _, _, agree in self.role(role):
                good &= agree > 0
        return good | (self.n == 0)


def _slices(batches) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE))


def _bucket(signature: np.ndarray) -> np.ndarray:
    return (signature & np.uint64(BUCKETS - 1)).view(np.int64)


def cell_counts(records: DataFrame, column: str, read: Reader, t: Fraction, several: bool) -> np.ndarray:
    """In how many cells each of BUCKETS buckets occurs, over all records."""

    def buckets(data: pa.Array) -> Iterator[np.ndarray]:
        for _, signature, _ in _Cells(data, read, t, several).role(SMALLER):
            yield _bucket(signature)

    return bucket_counts(records, column, buckets)


def bucket_counts(records: DataFrame, column: str, buckets: Callable[[pa.Array], Iterator[np.ndarray]]) -> np.ndarray:
    """How often each of BUCKETS buckets occurs, over all records.

    Every task counts its own and sends its table, packed; the tables are summed part by part.
    """

    def count(batches):
        table = np.zeros(BUCKETS, np.int64)
        waiting: list[np.ndarray] = []

        def note(least: int) -> None:
            if sum(map(len, waiting)) >= least:
                table[:] += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                waiting.clear()

        for batch in _slices(batches):
            waiting.extend(buckets(batch.column(0)))
            note(2 * BUCKETS)
        note(1)
        table = np.minimum(table, 2**32 - 1).astype(np.uint32)
        if table.any():
            parts = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in table.reshape(PARTS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.frombuffer(pa.decompress(data, BUCKETS // PARTS * 4, "zstd", asbytes=True), np.uint32).astype(np.int64)
                sums[part] = sums[part] + got if part in sums else got
        packed = [np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    table = np.zeros((PARTS, BUCKETS // PARTS), np.uint32)
    for r in records.select(column).mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect():  # PARTS rows
        table[r["part"]] = np.frombuffer(r["counts"], np.uint32)
    return table.ravel()


#: n_meet holds a record's size and, in the lowest three bits, how many offered cells a pair must share.
_OFFERS = "role int, cell long, id long, n_meet int, alike long"


def _offers(base: DataFrame, column: str, read: Reader, t: Fraction, several: bool, sent, roles: tuple[int, ...], heavy: bool | None, least: int = 2) -> DataFrame:
    """The cells that each record offers in its roles: of those that others have too the rarest, as many as it must.
    Only those of buckets with more than HEAVY cells are given, or only the others, or all; none of buckets with fewer than ``least``.
    Records in which no cell must agree offer none."""

    def offer(batches):
        table = sent.value
        for batch in _slices(batches):
            cells = _Cells(batch.column(1), read, t, several)
            regular = cells.regular() if several else None
            for role in roles:
                for record, signature, agree in cells.role(role):
                    meet = np.clip(agree, 1, MEET)
                    many = np.bincount(record, minlength=cells.rows) - np.maximum(agree, 0) + meet
                    if several:
                        many = np.where(regular, many, 0)
                    count = np.minimum(table[_bucket(signature)], 2**20 - 1).astype(np.uint64)
                    # one word a cell: by record, then rarest first, then in the order of cells, which is the same for all records
                    words = np.sort(record.astype(np.uint64) << np.uint64(50) | count << np.uint64(30) | np.arange(len(record), dtype=np.uint64))
                    at, count = (words & np.uint64(2**30 - 1)).view(np.int64), words >> np.uint64(30) & np.uint64(2**20 - 1)
                    record, signature = record[at], signature[at]
                    first = np.searchsorted(record, np.arange(cells.rows))
                    kept = (np.arange(len(record)) - first[record] < many[record]) & (count >= least)
                    if heavy is not None:
                        kept &= (count > HEAVY) == heavy
                    record = record[kept]
                    own = pa.array(record)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(record), role, np.int32)),
                            pa.array(signature[kept].view(np.int64)),
                            batch.column(0).take(own),
                            pa.array((cells.n[record] * 8 + meet[record]).astype(np.int32)),
                            batch.column(2).take(own),
                        ],
                        ["role", "cell", "id", "n_meet", "alike"],
                    )

    return base.select("id", column, "alike").mapInArrow(offer, _OFFERS)


def similar_pairs(
    records: DataFrame,
    threshold: Fraction | float = Fraction(4, 5),
    alike: str | None = None,
    *,
    column: str = "tokens",
    read: Reader = token_sets,
    runs: RunReader | None = None,
) -> DataFrame:
    """(a, b, shared, either): all pairs of records, a < b, whose token sets have a Jaccard similarity of at least ``threshold``.

    ``records`` has ``id`` (long, unique) and ``tokens`` (array of long), or another ``column``
    from which ``read`` gets the tokens: (row, token) arrays in order of the rows, each token
    once a row. It is read several times, so it should be stored, spread over the cores. Repeated tokens count once;
    records without tokens, null tokens and null ids take no part. Records should be distinct: equal
    ones are pairs too. Pairs whose column ``alike`` holds the same value that isn't null are not
    wanted and not made. The threshold must lie in (1/3, 1]. With ``runs`` the tokens are the
    windows of sequences, which meet by their runs; the threshold is then at least 1/2.
    """
    t = Fraction(threshold).limit_denominator(10_000)
    if not Fraction(1, 3) < t <= 1:
        raise ValueError("the threshold must lie in (1/3, 1]")
    if runs and t < Fraction(1, 2):
        raise ValueError("with runs the threshold must lie in [1/2, 1]")
    kind = F.when(F.col(alike).isNotNull(), F.xxhash64(alike)) if alike else F.lit(None).cast("long")
    base = records.select("id", column, kind.alias("alike")).where(F.col("id").isNotNull() & F.col(column).isNotNull())
    several = t >= SEVERAL and not runs
    pairs = _met_by_runs(base, column, runs, t) if runs else _candidates(base, column, read, t, several)
    if several or runs:  # records in which no cell must agree, or no run, meet all others in one-token cells
        irregular = stage(_irregular(base, column, read, t, runs), "irregular")
        if not irregular.isEmpty():
            pairs = pairs.unionByName(_odd_candidates(base, column, read, t, irregular)).distinct()
    return _verify(stage(pairs, "candidates"), base, column, read, t)


def _met_by_runs(base: DataFrame, column: str, runs: RunReader, t: Fraction) -> DataFrame:
    """(a, b) of the regular sequences that share enough of the runs they offer."""

    def cells(data: pa.Array) -> Iterator[np.ndarray]:
        yield _bucket(mix(runs(data, False)[1]))

    table = bucket_counts(base, column, cells)
    sent = base.sparkSession.sparkContext.broadcast(table)
    parts = parts_of(int(table.sum(dtype=np.int64)))

    def slices(batches):
        for batch in _slices(batches):
            record, run, n, own, partner = runs(batch.column(1))
            agree = least(n, own, partner, t)
            count = np.minimum(sent.value[_bucket(mix(run))], 2**20 - 1).astype(np.uint64)
            words = np.sort(record.astype(np.uint64) << np.uint64(50) | count << np.uint64(30) | np.arange(len(record), dtype=np.uint64))
            at, count = (words & np.uint64(2**30 - 1)).view(np.int64), words >> np.uint64(30) & np.uint64(2**20 - 1)
            record, run = record[at], run[at]
            place = np.minimum(np.searchsorted(record, np.arange(len(n)), side="right")[record] - 1 - np.arange(len(record)), LAST)
            kept = (agree[record] > 0) & (place >= unneeded(agree)[record]) & (count > 1)
            alike = batch.column(2)
            null = alike.is_null().to_numpy(zero_copy_only=False)
            yield record[kept], scatter(run[kept]), place[kept], batch.column(0).to_numpy(), n, own, partner, alike.fill_null(0).to_numpy(), null

    packed = base.select("id", column, "alike").mapInArrow(lambda batches: pack(slices(batches), parts), PACKED)
    met = packed.groupBy("part").applyInArrow(lambda offers: meet(offers, t, WHOLE), "a long, b long, part int")
    return _enough(met)


def _irregular(base: DataFrame, column: str, read: Reader, t: Fraction, runs: RunReader | None = None) -> DataFrame:
    def odd(data: pa.Array) -> np.ndarray:
        if runs is None:
            return ~_Cells(data, read, t, True).regular()
        n, own, partner = runs(data)[2:]
        return (least(n, own, partner, t) < 1) & (n > 0)

    def run(batches):
        for batch in _slices(batches):
            there = np.flatnonzero(odd(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(there))], ["id"])

    return base.select("id", column).mapInArrow(run, "id long")


def _candidates(base: DataFrame, column: str, read: Reader, t: Fraction, several: bool) -> DataFrame:
    """(a, b) of the records that share enough offered cells."""
    sent = base.sparkSession.sparkContext.broadcast(cell_counts(base, column, read, t, several))
    sides = [_offers(base, column, read, t, several, sent, (role,), False).drop("role") for role in (SMALLER, LARGER)]
    met = _meet(*sides, t)
    if sent.value.max(initial=0) > HEAVY:
        heavy = stage(_offers(base, column, read, t, several, sent, (SMALLER, LARGER), True), "heavy")
        if not heavy.isEmpty():
            met = met.unionByName(_meet_heavy(heavy, t))
    return _enough(met)


def _odd_candidates(base: DataFrame, column: str, read: Reader, t: Fraction, irregular: DataFrame) -> DataFrame:
    """(a, b) of the records that share enough one-token cells, one of them at least irregular. Cells are in order
    of the irregular records' counts: what these haven't comes first and isn't offered, so most records offer nothing."""
    few = irregular.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    odd = F.broadcast(irregular) if few else irregular
    sent = base.sparkSession.sparkContext.broadcast(cell_counts(base.join(odd, "id", "left_semi"), column, read, t, False))
    offers = _offers(base, column, read, t, False, sent, (SMALLER, LARGER), None, 1).join(odd.withColumn("odd", F.lit(True)), "id", "left")
    offers = stage(offers.withColumn("odd", F.col("odd").isNotNull()), "odd")
    a, b = (offers.where(F.col("role") == role).drop("role") for role in (SMALLER, LARGER))
    return _enough(_meet(a.where("odd"), b, t).unionByName(_meet(a.where("not odd"), b.where("odd"), t)))


def _enough(met: DataFrame) -> DataFrame:
    return met.groupBy("a", "b").agg(F.sum("part").alias("met")).where(F.col("met") >= WHOLE).select("a", "b")


def _meet(smaller: DataFrame, larger: DataFrame, t: Fraction, more: Column | None = None, keys: tuple[str, ...] = ("cell",)) -> DataFrame:
    """(a, b, part) for every common cell of two records whose sizes allow the threshold, the smaller one (of equal ones
    the one with the smaller id) in the first role; enough cells make up WHOLE parts."""
    a, b = (side.select(*[F.col(c).alias(f"{c}_{k}") for c in side.columns if c not in keys], *keys) for side, k in ((smaller, "a"), (larger, "b")))
    n = {k: F.shiftright(f"n_meet_{k}", 3) for k in "ab"}
    meet = F.least(*[F.col(f"n_meet_{k}").bitwiseAND(7) for k in "ab"])
    order = (n["a"] < n["b"]) | ((n["a"] == n["b"]) & (F.col("id_a") < F.col("id_b")))
    fit = n["a"].cast("long") * t.denominator >= n["b"].cast("long") * t.numerator
    wanted = order & fit & ~F.coalesce(F.col("alike_a") == F.col("alike_b"), F.lit(False))
    met = a.join(b, list(keys)).where(wanted if more is None else wanted & more)
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), (WHOLE / meet).cast("int").alias("part"))


def _meet_heavy(both: DataFrame, t: Fraction) -> DataFrame:
    """As ``_meet``, for cells of many records. Records of the value of ``alike`` that is most common
    in a cell aren't paired among themselves, so one of each pair is of another value: only those
    are set against all. Every cell is joined in SALTS parts of its second side."""
    sizes = both.where("alike is not null").groupBy("cell", "alike").agg(F.count("*").alias("k"))
    most = sizes.groupBy("cell").agg(F.max_by("alike", F.struct("k", "alike")).alias("most"))
    marked = both.join(most, "cell", "left").withColumn("major", F.coalesce(F.col("alike") == F.col("most"), F.lit(False))).drop("most")
    marked = stage(marked, "marked")
    a, b = (marked.where(F.col("role") == role).drop("role") for role in (SMALLER, LARGER))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    keys = ("cell", "salt")

    def salted(x: DataFrame) -> DataFrame:
        return x.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))

    one = _meet(a.where("not major").withColumn("salt", salts), salted(b), t, None, keys)
    return one.unionByName(_meet(salted(a.where("major")), b.where("not major").withColumn("salt", salts), t, None, keys))


def _verify(pairs: DataFrame, base: DataFrame, column: str, read: Reader, t: Fraction) -> DataFrame:
    """Candidates whose sketches are near enough and whose tokens are similar. Only records of candidates are moved, as they were read."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    kept = base.select("id", column).join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        sides = [read(batch.column(k)) for k in (2, 3)]
        n = [np.bincount(record, minlength=rows) for record, _ in sides]
        most = (n[0] + n[1]) * (t.denominator - t.numerator)  # of the symmetric difference, times (den + num)
        with np.errstate(over="ignore"):
            bits = [sketches(record, mix(tokens.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), rows) for record, tokens in sides]
        near = np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum(axis=1, dtype=np.int64) * (t.denominator + t.numerator) <= most
        record, tokens = (np.concatenate([side[k][near[side[0]]] for side in sides]) for k in (0, 1))
        order = np.lexsort((tokens, record))
        record, tokens = record[order], tokens[order]
        shared = np.bincount(record[1:][(record[1:] == record[:-1]) & (tokens[1:] == tokens[:-1])], minlength=rows)
        either = n[0] + n[1] - shared
        there = np.flatnonzero(near & (shared * t.denominator >= either * t.numerator))
        ends = [batch.column(k).take(pa.array(there)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*ends, pa.array(shared[there].astype(np.int32)), pa.array(either[there].astype(np.int32))], ["a", "b", "shared", "either"])

    sides = [kept.select(F.col("id").alias(k), F.col(column).alias(f"of_{k}")) for k in "ab"]
    wide = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "of_a", "of_b")
    return wide.mapInArrow(lambda batches: map(judged, _slices(batches)), "a long, b long, shared int, either int")
