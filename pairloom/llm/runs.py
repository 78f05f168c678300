"""Similar sequences by runs of three neighbouring windows, met in packed parts.

A window of five letters is common to unrelated sequences by chance, and the more sequences the
more often; a run of three windows in a row, RUN = 7 letters, hardly ever. Sequences whose sets of
windows are similar enough have runs in common, if few of their letters repeat:

Let A and B have n <= m windows, s of them in both. A has N places of windows in g stretches
without X; r = N - n places repeat a window. Places whose window B lacks number at most N - s.
Between two of them lies a stretch of places that B has; a run begins at all but two places of a
stretch. A gap between stretches takes two places that B lacks, or one; where it takes one, the
three letters that the windows beside it share stand in B twice. So places with runs number at
least s - (N - s) - 2g - R3 - r, where R3 of B's places have windows that end in three letters
which B repeats. Their runs differ but for r, and B has such a run as a run unless it repeats the
four letters that two of its windows share: 2 R4 + r runs at most. In all

    common runs >= 2s - n - (4r + 2g of A) - (R3 + 2 R4 of B)    and    s >= p(n + m)/(p + q).

The first bracket is a sequence's own slack, the second its partner's. Each knows one of them and
takes the other at its most (``most_own`` and ``most_partner``); sequences beyond these, and those too short
for any common run, are irregular and meet the others by windows.

Every sequence offers its runs but the most common ones, which all its partners may do without.
Where two sequences meet, both slacks are known: runs count if for this pair, too, neither needs
to do without them. Thus passages that many sequences have by design, as tags, pair none. Runs are
exact numbers of RUN_BITS bits; the offers of many sequences are sorted, cut into parts by run
and packed, which takes about four bytes an offer. A task meets the offers of one part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa

WINDOW, RUN = 5, 7
RUN_BITS = (26**RUN).bit_length()
#: Offered runs that a pair must share, if so many must be common; a run's place from its record's most common one on counts up to LAST.
MEET, LAST = 4, 63
#: Slacks up to this share of the most are usual.
USUAL = 0.5
#: Offers and owners packed at a time; offers a part; fewest parts; pairs made at a time.
CHUNK, PART, PARTS, PAIRS = 2_000_000, 3_000_000, 32, 4_000_000

PACKED = "part int, offers int, owners int, planes array<binary>"

#: From a column: (record, run) in order of records, each run once a record; by record its windows, own and partner's slack.
#: Given False as well, it may leave the last three out.
RunReader = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _repeated(row: np.ndarray, code: np.ndarray, there: np.ndarray, bits: int) -> np.ndarray:
    """The places whose code stands at another place of their row, too."""
    place = np.flatnonzero(there)
    width = len(row).bit_length()
    words = np.sort((row[place] << bits | code[place]) << width | place)
    same = words[1:] >> width == words[:-1] >> width
    again = np.zeros(len(words), bool)
    again[1:] |= same
    again[:-1] |= same
    out = np.zeros(len(row), bool)
    out[words[again] & (1 << width) - 1] = True
    return out


def _distinct(row: np.ndarray, code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.sort(row << bits | code)
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    return both >> bits, both & (1 << bits) - 1


def runs(column: pa.Array, slack: bool = True) -> tuple[np.ndarray, ...]:
    """The runs of a column of residues (see RunReader)."""
    data = pa.array(column.fill_null("")) if column.null_count else column
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    sizes, rows = np.diff(ends), len(data)
    total = int(sizes.sum())
    none = np.zeros(0, np.int64)
    if total == 0:
        return none, none, *(np.zeros(rows, np.int64) for _ in range(3))
    letters = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[0] + total].astype(np.int64) - 65
    letters = np.r_[letters, np.full(RUN - 1, 23)]  # beyond the end all is X
    row = np.repeat(np.arange(rows), sizes)
    owner = np.r_[row, np.full(RUN - 1, -1)]
    unknown = np.r_[0, np.cumsum(letters == 23)]
    code, codes, clean = np.zeros(total, np.int64), {}, {}
    for k in range(1, RUN + 1):
        code = code * 26 + letters[k - 1 : k - 1 + total]
        if k in (3, 4, WINDOW, RUN):
            codes[k], clean[k] = code, (owner[k - 1 : k - 1 + total] == row) & (unknown[k : k + total] == unknown[:total])
    record, run = _distinct(row[clean[RUN]], codes[RUN][clean[RUN]], RUN_BITS)
    if not slack:
        return record, run

    window = np.flatnonzero(clean[WINDOW])
    of = row[window]
    places = np.bincount(of, minlength=rows)
    n = np.bincount(_distinct(of, codes[WINDOW][window], (26**WINDOW).bit_length())[0], minlength=rows)
    stretches = np.bincount(of[~np.r_[clean[WINDOW][1:], False][window]], minlength=rows)
    again = {k: np.bincount(of[_repeated(row, codes[k], clean[k], (26**k).bit_length())[window + WINDOW - k]], minlength=rows) for k in (3, 4)}
    return record, run, n, 4 * (places - n) + 2 * stretches, again[3] + 2 * again[4]


def most_own(n: np.ndarray) -> np.ndarray:
    """The most slack of its own that a regular sequence of n windows has."""
    return np.minimum(2 + n / 12, 7 + n / 20)


def most_partner(n: np.ndarray) -> np.ndarray:
    """The most slack that a regular one of n windows gives its partner; it grows by less than 2/3 a window.
    Above what three letters in random sequences repeat, below the n/3 that at a threshold of 1/2 are there."""
    return np.minimum(1 + n * n / 300, np.minimum(0.23 * n + np.maximum(0, n - 300) * 0.1, 0.3 * n))


def least(n: np.ndarray, own: np.ndarray, partner: np.ndarray, t: Fraction, most: float = 1) -> np.ndarray:
    """How many runs each record shares at least with any similar one whose slacks are regular, or ``most`` of that;
    0 if its own aren't. The smaller one's bound and the larger one's are both lowest for a partner of the same size.
    """
    slack = np.maximum(own + most * most_partner(n), most * most_own(n) + partner)
    regular = (own <= most_own(n)) & (partner <= most_partner(n))
    return np.where(regular, _number(_twice(n, n, t) - n - slack), 0)


def _twice(n: np.ndarray, m: np.ndarray, t: Fraction) -> np.ndarray:
    """Twice the windows that similar records of n and m windows share at least."""
    return 2 * t.numerator * (n + m) / (t.numerator + t.denominator)


def _number(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.ceil(x - 1e-6).astype(np.int64), 0)


def unneeded(agree: np.ndarray) -> np.ndarray:
    """How many of its most common runs a record needn't offer, if so many must be shared and MEET offered ones shall meet."""
    return np.minimum(agree - np.minimum(agree, MEET), LAST)


def scatter(run: np.ndarray) -> np.ndarray:
    """A bijection of RUN_BITS bits that spreads runs evenly over the parts."""
    full = np.uint64((1 << RUN_BITS) - 1)
    x = run.astype(np.uint64)
    with np.errstate(over="ignore"):
        for factor in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
            x = x * np.uint64(factor) & full
            x ^= x >> np.uint64(RUN_BITS // 2)
    return x


def parts_of(offers: int) -> int:
    return max(PARTS, offers // PART)


def _edges(parts: int) -> np.ndarray:
    return np.array([-(-(k << RUN_BITS) // parts) for k in range(parts + 1)], np.uint64)


def _planes(values: np.ndarray) -> list[bytes]:
    """The bytes of numbers by their place, so that each compresses by itself."""
    split = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in split]


def _joined(planes: list[bytes], count: int, kind) -> np.ndarray:
    split = [np.frombuffer(pa.decompress(x, count, "zstd", asbytes=True), np.uint8) for x in planes]
    return np.ascontiguousarray(np.stack(split, axis=1)).view(kind).ravel()


#: The columns of a part's planes: of its offers the run's distance to the one before, the owner, the place; of its owners the rest.
_OFFER, _OWNER = (np.uint32, np.uint32, np.uint8), (np.int64, np.uint32, np.uint32, np.uint32, np.int64, np.uint8)


def pack(slices: Iterator[tuple], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED from (owner, scattered run, place, ids, n, own, partner, alike, whether it is null) of slices of records."""
    edges = _edges(parts)
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        before = np.cumsum([0, *(len(x[3]) for x in held)])
        owner = np.concatenate([x[0] + k for x, k in zip(held, before)]).astype(np.uint64)
        cell, place, *owners = (np.concatenate([x[i] for x in held]) for i in range(1, 9))
        width, low = np.uint64(int(before[-1]).bit_length()), np.uint64(6)  # places take six bits
        words = np.sort((cell << width | owner) << low | place.astype(np.uint64))
        place, words = (words & np.uint64(LAST)).astype(np.uint8), words >> low
        cell, owner = words >> width, (words & (np.uint64(1) << width) - np.uint64(1)).view(np.int64)
        cuts = np.searchsorted(cell, edges)
        rows = []
        for part, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if i < j:
                there = np.zeros(before[-1], bool)
                there[owner[i:j]] = True
                at = np.cumsum(there) - 1
                columns = [np.diff(cell[i:j], prepend=edges[part]), at[owner[i:j]], place[i:j], np.diff(owners[0][there], prepend=0), *(x[there] for x in owners[1:])]
                rows.append((part, int(j - i), int(there.sum()), [x for c, kind in zip(columns, _OFFER + _OWNER) for x in _planes(c.astype(kind))]))
        held.clear()
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["part", "offers", "owners", "planes"])

    for x in slices:
        held.append(x)
        if sum(len(y[0]) + len(y[3]) for y in held) >= CHUNK:
            yield flush()
    if held:
        yield flush()


def _unpack(packed: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The columns of the offers and of the owners of a part, runs from the part's edge on."""
    offers, owners, before = [], [], 0
    for row in packed.select(["offers", "owners", "planes"]).to_pylist():
        at, got = 0, []
        for k, kind in enumerate(_OFFER + _OWNER):
            size = np.dtype(kind).itemsize
            got.append(_joined(row["planes"][at : at + size], row["offers" if k < len(_OFFER) else "owners"], kind))
            at += size
        offers.append((np.cumsum(got[0].astype(np.uint64)), got[1].astype(np.int64) + before, got[2].astype(np.int64)))
        owners.append((np.cumsum(got[3]), *(x.astype(np.int64) for x in got[4:8]), got[8].astype(bool)))
        before += row["owners"]
    return [np.concatenate(x) for x in zip(*offers)], [np.concatenate(x) for x in zip(*owners)]


class _Pairs:
    """Pairs of owners and how often they met, made PAIRS at a time."""

    def __init__(self):
        self.keys, self.counts, self.waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.waiting.append(np.unique(np.minimum(x, y).astype(np.uint64) << np.uint64(32) | np.maximum(x, y).astype(np.uint64), return_counts=True))
        if sum(len(k) for k, _ in self.waiting) > max(2 * PAIRS, len(self.keys)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        self.waiting.clear()
        return (self.keys >> np.uint64(32)).view(np.int64), (self.keys & np.uint64(2**32 - 1)).view(np.int64), self.counts


def _ends(new: np.ndarray) -> np.ndarray:
    """For every row of groups, where its group ends; ``new``: whether a row but the first begins a group."""
    first = np.r_[0, np.flatnonzero(new) + 1, len(new) + 1]
    return np.repeat(first[1:], np.diff(first))


def _expand(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, other row) for every row and all others from its ``begin`` to its ``end``, PAIRS at a time."""
    many = np.r_[0, np.cumsum(end - begin)]
    for i in range(0, int(many[-1]), PAIRS):
        which = np.arange(i, min(i + PAIRS, int(many[-1])))
        left = np.searchsorted(many, which, side="right") - 1
        yield left, begin[left] + which - many[left]


def meet(packed: pa.Table, t: Fraction, whole: int) -> pa.Table:
    """(a, b, part) of the pairs of records that share runs in a part: of other kinds and of sizes that allow the threshold."""
    (cell, owner, place), (ids, n, own, partner, alike, null) = _unpack(packed)
    kind = np.arange(len(ids))
    kind[~null] = np.unique(alike[~null], return_inverse=True)[1] + len(ids)
    order = np.argsort(cell, kind="stable")
    same = np.diff(cell[order]) == 0
    order = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order  # what only one offers meets none
    cell, owner, place = cell[order], owner[order], place[order]
    usual = (own <= USUAL * most_own(n)) & (partner <= USUAL * most_partner(n))
    found = _Pairs()

    def agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return _number(_twice(n[x], n[y], t) - np.minimum(n[x] + own[x] + partner[y], n[y] + own[y] + partner[x]))

    def add(owner, place, begin, end) -> None:
        for left, right in _expand(begin, end):
            x, y = owner[left], owner[right]
            fit = np.minimum(n[x], n[y]) * t.denominator >= np.maximum(n[x], n[y]) * t.numerator
            fit &= (kind[x] != kind[y]) & (np.minimum(place[left], place[right]) >= unneeded(agree(x, y)))
            found.add(x[fit], y[fit])

    # runs that a usual record does without for all usual ones; they meet those of the others only
    weak = usual[owner] & (place < unneeded(least(n, own, partner, t, USUAL))[owner])
    for one in (True, False):
        take = np.flatnonzero(~weak if one else weak | ~usual[owner])
        key = kind[owner[take]] if one else ~weak[take]
        take = take[np.lexsort((key, cell[take]))]
        if len(take) == 0:
            continue
        c, o, p, w = cell[take], owner[take], place[take], weak[take]
        other = c[1:] != c[:-1]
        inner = _ends(other | (kind[o[1:]] != kind[o[:-1]] if one else w[1:] != w[:-1]))
        end = _ends(other)
        add(o, p, np.where(w | one, inner, end), end)
    x, y, counts = found.settle()
    part = np.minimum(counts * (whole // np.clip(agree(x, y), 1, MEET)), whole)
    return pa.table({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y]), "part": part.astype(np.int32)})
