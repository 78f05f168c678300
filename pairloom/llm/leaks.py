"""Held-out items in a corpus, found by their templates.

Words are put into a canonical form in which numbers, codes, units and names are typed
placeholders. Windows of such template words are hashed; a corpus window whose hash an item's
window has is a candidate, and the values in its slots decide: equal values are a copied
passage, values that follow one consistent renaming are a re-parameterised one. Renamings are
compared by pattern: which slots hold equal values.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.joins import HOT
from pairloom.session import bounded_rows, spread, stage

WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[[\p{L}\p{M}\p{Nd}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]]+", regex.V1)
UNITS = frozenset("å nm mm cm µm μm kda da mg ml µl k °c pt percent prozent percentage mol mm mhz kv".split())  # fixed values
NUMBER, CODE, UNIT, NAME = "\x00number", "\x00code", "\x00unit", "\x00name"
#: A word in at least so many items belongs to the template; a rarer one is taken for a name.
COMMON = 3
#: So many items at most are sent to every task; more are joined.
BLOCK_ITEMS, BLOCK_CHARS = 5_000, 20_000_000
#: So many words of templates are sent to every task; more are refused.
MAX_COMMON = 2_000_000
#: So many documents at most may be expected to hold a run's templates by chance.
CHANCE = 0.05
#: Of a run of one window, all of its item, the template may stand in so many documents.
RARE = 3

WINDOW, WINDOW_CJK = 12, 30
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)


def words(text: str) -> list[str]:
    """The words of a text after NFKC and lower-casing."""
    return WORD.findall(text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower())


def placeholder(word: str, common: frozenset[str]) -> str:
    """The template's word for ``word``: itself if it is common to items, else its type."""
    if word.isdigit():
        return NUMBER
    if word in UNITS:
        return UNIT
    if any(c.isdigit() for c in word):
        return CODE
    if word in common or len(word) == 1 and not word.isascii():
        return word
    return NAME


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def roll(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` neighbouring values, by doubling."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, length, power = None, 0, None
    block, size, factor = values, 1, MULTIPLIER
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                if done is None:
                    done, length, power = block, size, factor
                else:
                    m = len(values) - length - size + 1
                    done = done[:m] * factor + block[length : length + m]
                    length, power = length + size, power * factor
            if size * 2 > k:
                break
            m = len(values) - 2 * size + 1
            block, size, factor = block[:m] * factor + block[size : size + m], size * 2, factor * factor
    return done[:n]


@dataclass
class _Items:
    """What tasks need of the items."""

    common: frozenset[str]
    words: list[list[str]]
    sizes: list[int]
    ids: list
    #: By window length: the sorted keys of all windows and, in their order, item, place, plain hash and template hash.
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    templates: dict[int, np.ndarray]
    masks: dict[int, np.ndarray]


MASK = (1 << 22) - 1


def patterns(plain: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of which words are equal within each window of ``k`` from ``at``: two windows of one
    template follow a one-to-one renaming just if these patterns are equal."""
    order = np.argsort(plain, kind="stable")
    back = np.zeros(len(plain), np.int64)  # how far before a word the same one stands
    again = np.flatnonzero(plain[order[1:]] == plain[order[:-1]]) + 1
    back[order[again]] = order[again] - order[again - 1]
    inside = np.arange(k)
    with np.errstate(over="ignore"):
        weights = np.cumprod(np.full(k, MULTIPLIER, np.uint64))
        out = np.zeros(len(at), np.uint64)
        for i in range(0, len(at), 20_000):
            part = back[at[i : i + 20_000, None] + inside]
            out[i : i + 20_000] = (np.where(part <= inside, part, 0).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    return out


def _key(template: np.ndarray, plain: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The template of each window of ``at`` with the pattern of its slots."""
    with np.errstate(over="ignore"):
        return template[at] * MULTIPLIER + patterns(plain, at, k)


def common_words(items: DataFrame, item: str, text: str) -> frozenset[str]:
    """The words that at least COMMON of all items have (all of them, if there are fewer items).

    Counted over all items at once, whatever blocks they are searched in. More than MAX_COMMON
    such words are refused.
    """
    rows = items.select(text).where(f"`{item}` is not null and `{text}` <> ''")
    n = rows.count()

    def run(batches):
        for batch in batches:
            seen = Counter(w for t in batch.column(0).to_pylist() for w in set(words(t)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    found = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min(COMMON, n)).select("word")
    got = bounded_rows(found, MAX_COMMON)
    if got is None:
        raise ValueError(f"more than {MAX_COMMON} words of templates")
    return frozenset(r[0] for r in got)


def prepare(rows: Iterable[tuple], window: int, window_cjk: int, renamed: bool = False, common: frozenset[str] | None = None) -> _Items:
    """``rows``: (item id, lang, text). Without ``common`` it is counted in these rows."""
    rows = [(i, lang, words(text)) for i, lang, text in rows if i is not None and text]
    if common is None:
        seen = Counter(w for _, _, ws in rows for w in set(ws))
        common = frozenset(w for w, n in seen.items() if n >= min(COMMON, len(rows)))
    sizes = [window_cjk if (lang or "").strip().lower()[:2] in ("zh", "ja") else window for _, lang, _ in rows]
    items = _Items(common, [ws for _, _, ws in rows], sizes, [i for i, _, _ in rows], {}, {}, {})
    reader = _Reader(items)
    for k in sorted(set(sizes)):
        mine = [n for n, size in enumerate(sizes) if size == k]
        template, plain = reader.hashes([items.words[n] for n in mine])
        at, owner, place = _inside(np.array([len(items.words[n]) for n in mine]), k)
        if not len(at):
            continue
        rolled, whole = roll(template, k), roll(plain, k)[at]
        key = _key(rolled, plain, at, k) if renamed else whole
        order = np.argsort(key, kind="stable")
        own = rolled[at]
        items.windows[k] = key[order], np.array(mine, np.int64)[owner][order], place[order], whole[order], own[order]
        items.templates[k] = np.unique(own)
        mask = np.zeros(MASK + 1, bool)
        mask[(own & np.uint64(MASK)).astype(np.int64)] = True
        items.masks[k] = mask
    return items


def _inside(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start among all words, text, start in it) of the windows of ``k`` that lie within one text."""
    many = np.maximum(sizes - k + 1, 0)
    text = np.repeat(np.arange(len(sizes)), many)
    place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(np.cumsum(sizes) - sizes, many) + place, text, place


def consistent(here: list[str], there: list[str]) -> bool:
    """Whether two windows of one template follow a one-to-one renaming."""
    to: dict[str, str] = {}
    back: dict[str, str] = {}
    return all(to.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in zip(here, there))


class _Reader:
    """Per task: word hashes are kept between texts."""

    KEEP = 300_000

    def __init__(self, items: _Items):
        self.items = items
        self.known: dict[str, tuple[int, int]] = {}

    def hashes(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(template, exact) hashes of all words of the texts, one after the other."""
        known, common = self.known, self.items.common
        if len(known) > self.KEEP:
            known.clear()
        new = set().union(*texts) - known.keys()
        for w in new:
            known[w] = _hash(placeholder(w, common)), _hash(w)
        both = [known[w] for ws in texts for w in ws]
        pair = np.array(both, np.uint64).reshape(-1, 2)
        return np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])

    def windows(self, texts: list[list[str]], renamed: bool) -> Iterator[tuple]:
        """(k, text, place, key, plain, template) arrays of the windows whose template the mask of the items has."""
        template, plain = self.hashes(texts)
        sizes = np.array([len(ws) for ws in texts])
        ends = np.cumsum(sizes)
        for k, mask in self.items.masks.items():
            rolled = roll(template, k)
            at = np.flatnonzero(mask[(rolled & np.uint64(MASK)).astype(np.int64)])
            text = np.searchsorted(ends, at, side="right")
            inside = at + k <= ends[text]
            at, text = at[inside], text[inside]
            whole = roll(plain, k)[at]
            yield k, text, at - (ends[text] - sizes[text]), _key(rolled, plain, at, k) if renamed else whole, whole, rolled[at]

    def hits(self, k: int, text: np.ndarray, place: np.ndarray, key: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, place, item, item's place, copied, template) of the windows whose key an item's window has, each pair once."""
        if k not in self.items.windows:
            none = np.zeros(0, np.int64)
            return none, none, none, none, np.zeros(0, bool), np.zeros(0, np.uint64)
        keys, owners, places, wholes, templates = self.items.windows[k]
        low, high = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
        many = high - low
        x = np.repeat(np.arange(len(key)), many)
        y = np.repeat(low, many) + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
        return text[x], place[x], owners[y], places[y], plain[x] == wholes[y], templates[y]


def runs(text: np.ndarray, place: np.ndarray, item: np.ndarray, there: np.ndarray, copied: np.ndarray, template: np.ndarray, k: int, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, run, whole, template) of the windows side by side (every k-th) in renamed runs: longest
    stretches of neighbouring windows of which fewer than half are copies. ``whole``: the run is all of its item, of ``sizes`` words."""
    if not len(text):
        return text, item, place, copied, template
    order = np.lexsort((place, place - there, item, text))
    text, place, item, there, copied, template = (x[order] for x in (text, place, item, there, copied, template))
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (place[1:] - there[1:] != place[:-1] - there[:-1]) | (place[1:] != place[:-1] + 1)
    run = np.cumsum(new) - 1
    many = np.bincount(run)
    offset = np.arange(len(run)) - np.flatnonzero(new)[run]
    whole = many[run] + k - 1 == sizes[item]
    kept = (2 * np.bincount(run, copied) < many)[run] & (offset % k == 0) & (whole | (many[run] > k))
    return text[kept], item[kept], run[kept], whole[kept], template[kept]


def leaks(
    docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", lang: str = "lang", renamed: bool = False, window: int = WINDOW, window_cjk: int = WINDOW_CJK
) -> DataFrame:
    """(doc, item): the documents that hold a run of words of an item, at least ``window`` words, or
    ``window_cjk`` if the item's language is zh or ja.

    With ``renamed`` instead those that hold such a run only with other values in its slots: numbers,
    codes, units and names differ, but by a one-to-one renaming; fewer than half of the run's windows
    may be copies. As sentences share templates by chance, the run must be so long that by
    the number of documents that hold the templates of its windows side by side no more than CHANCE documents are
    expected to hold it: the more common its phrases, the longer it has to be. A run of one window counts only if it
    is all of its item, its template standing in at most RARE documents.

    Null ids and null or empty texts give no row; repeated rows give theirs once. The corpus is
    read and its words are hashed once. Up to BLOCK_ITEMS items and about BLOCK_CHARS characters are sent to the
    tasks, and the corpus is not shuffled; of more items only a mask of their templates is sent, and
    the windows that it lets through meet theirs by a join, with the same result.
    """
    rows = spread(docs.select(doc, text).where(f"`{doc}` is not null and `{text}` is not null"))
    asked = items.select(item, lang, text).where(f"`{item}` is not null and `{text}` <> ''").distinct()
    kind = items.schema[item].dataType
    common = common_words(items, item, text)
    small = bounded_rows(asked, BLOCK_ITEMS)
    if small is not None and sum(len(r[2]) for r in small) <= BLOCK_CHARS:
        prepared = prepare(map(tuple, small), window, window_cjk, renamed, common)
        sent = docs.sparkSession.sparkContext.broadcast(vars(prepared))
        if not renamed:
            return rows.mapInArrow(_search(sent, doc, item, kind), T.StructType([rows.schema[doc], items.schema[item]])).distinct()
        schema = T.StructType([rows.schema[doc], items.schema[item], *T._parse_datatype_string("run long, whole boolean, template long, n long").fields])
        found = stage(rows.mapInArrow(_search_renamed(sent, doc, item, kind), schema), "runs")
    else:
        found = _joined(rows, asked, doc, item, renamed, window, window_cjk, common)
        if not renamed:
            return found
    whole = max(1, rows.count())
    counted = found.where("n is not null").groupBy("template").agg(F.sum("n").alias("df"))
    share = F.log(F.least(F.col("df"), F.lit(whole)) / F.lit(whole))
    judged = found.where("n is null").drop("n").join(counted, "template").groupBy(doc, item, "run")
    judged = judged.agg((F.sum(share) + math.log(whole)).alias("chance"), F.count("*").alias("windows"), F.max("df").alias("df"), F.max("whole").alias("whole"))
    return judged.where((F.col("chance") <= math.log(CHANCE)) & (F.col("windows") > 1) | F.col("whole") & (F.col("windows") == 1) & (F.col("df") <= RARE)).select(doc, item).distinct()


def _slices(batches):
    return (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000))


def _search(sent, doc: str, item: str, kind: T.DataType):
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        items = _Items(**sent.value)  # sent as plain values: broadcasts are pickled by reference
        reader = _Reader(items)
        for batch in _slices(batches):
            texts = [words(t) for t in batch.column(1).to_pylist()]
            keys: set[tuple[int, int]] = set()
            for k, text, place, key, plain, _ in reader.windows(texts, False):
                for t, p, n, q in zip(*(x.tolist() for x in reader.hits(k, text, place, key, plain)[:4])):
                    if (t, n) not in keys and texts[t][p : p + k] == items.words[n][q : q + k]:
                        keys.add((t, n))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([t for t, _ in keys], pa.int64())), pa.array([items.ids[n] for _, n in keys], to_arrow_type(kind))], [doc, item]
            )

    return run


def _documents_with(text: np.ndarray, template: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(template, number of texts that have it), of the ``known`` ones."""
    if known is not None:
        there = known[np.minimum(np.searchsorted(known, template), len(known) - 1)] == template
        text, template = text[there], template[there]
    pairs = np.unique(np.stack([template, text.astype(np.uint64)]), axis=1)
    return np.unique(pairs[0], return_counts=True)


def _search_renamed(sent, doc: str, item: str, kind: T.DataType):
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        items = _Items(**sent.value)
        reader = _Reader(items)
        names = [doc, item, "run", "whole", "template", "n"]
        sizes = np.array([len(ws) for ws in items.words], np.int64)
        done = 0
        part = TaskContext.get().partitionId() << 40
        for batch in _slices(batches):
            texts = [words(t) for t in batch.column(1).to_pylist()]
            for k, text, place, key, plain, template in reader.windows(texts, True):
                t, n, run_no, whole, own = runs(*reader.hits(k, text, place, key, plain), k, sizes)
                run_no = run_no + part + done
                done += len(text) + len(t)
                ids = pa.array([items.ids[x] for x in n.tolist()], to_arrow_type(kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(t, pa.int64())), ids, pa.array(run_no), pa.array(whole), pa.array(own.view(np.int64)), pa.nulls(len(t), pa.int64())], names
                )
                of, many = _documents_with(text, template, items.templates[k])
                none = len(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(none, batch.column(0).type), pa.nulls(none, ids.type), pa.nulls(none, pa.int64()), pa.nulls(none, pa.bool_()), pa.array(of.view(np.int64)), pa.array(many, pa.int64())], names
                )

    return run


#: Parts of a hot window's documents, each of which meets the items by itself.
SALTS = 32


def _joined(rows: DataFrame, asked: DataFrame, doc: str, item: str, renamed: bool, window: int, window_cjk: int, common: frozenset[str]) -> DataFrame:
    """As with few items, by a join on window keys."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(common)
    schema = T.StructType([asked.schema[item], *T._parse_datatype_string("k int, key long, place int, plain long, template long, run string, size int").fields])

    def cut(batches):
        for batch in _slices(batches):
            items = prepare(zip(*(c.to_pylist() for c in batch.columns)), window, window_cjk, renamed, shared.value)
            at = {i: x for x, i in enumerate(batch.column(0).to_pylist())}
            for k, (key, owner, place, plain, template) in items.windows.items():
                take = pa.array([at[items.ids[n]] for n in owner.tolist()], pa.int64())
                run = [None if renamed else " ".join(items.words[n][p : p + k]) for n, p in zip(owner.tolist(), place.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array([k] * len(key), pa.int32()), pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(plain.view(np.int64)), pa.array(template.view(np.int64)), pa.array(run, pa.string()), pa.array([len(items.words[n]) for n in owner.tolist()], pa.int32())], schema.names
                )

    own = stage(asked.mapInArrow(cut, schema), "windows")
    bits = own.select("k", F.col("template").bitwiseAND(MASK).cast("int").alias("bit")).distinct().toArrow()  # at most MASK + 1 a length
    masks = {}
    for k in np.unique(bits.column("k").to_numpy()):
        masks[int(k)] = np.zeros(MASK + 1, bool)
        masks[int(k)][bits.column("bit").to_numpy()[bits.column("k").to_numpy() == k]] = True
    sent = spark.sparkContext.broadcast(vars(_Items(common, [], [], [], {}, {}, masks)))
    wide = T.StructType([rows.schema[doc], *T._parse_datatype_string("row long, k int, key long, place int, plain long, template long, run string, n long").fields])

    def look(batches):
        reader = _Reader(_Items(**sent.value))
        for batch in _slices(batches):
            texts = [words(t) for t in batch.column(1).to_pylist()]
            for k, text, place, key, plain, template in reader.windows(texts, renamed):
                run = [None if renamed else " ".join(texts[t][p : p + k]) for t, p in zip(text.tolist(), place.tolist())]
                of, many = _documents_with(text, template) if renamed else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                n, m = len(text), len(of)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column(0).take(pa.array(text, pa.int64())), pa.nulls(m, batch.column(0).type)]),
                        pa.concat_arrays([batch.column(2).take(pa.array(text, pa.int64())), pa.nulls(m, pa.int64())]),
                        pa.array([k] * (n + m), pa.int32()),
                        pa.array(np.r_[key.view(np.int64), np.zeros(m, np.int64)]),
                        pa.array(np.r_[place, np.zeros(m, np.int64)].astype(np.int32)),
                        pa.array(np.r_[plain.view(np.int64), np.zeros(m, np.int64)]),
                        pa.array(np.r_[template.view(np.int64), of.view(np.int64)]),
                        pa.array(run + [None] * m, pa.string()),
                        pa.array([None] * n + many.tolist(), pa.int64()),
                    ],
                    wide.names,
                )

    seen = stage(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(look, wide), "seen")
    here = seen.where("n is null").select(doc, "row", "k", "key", F.col("place").alias("at"), F.col("plain").alias("own"), F.col("run").alias("said"))
    total = here.count()
    hot = here.groupBy("k", "key").agg(F.count("*").alias("c")).where(F.col("c") > total / HOT).select("k", "key", F.lit(True).alias("hot"))  # fewer than HOT
    here = here.join(F.broadcast(hot), ["k", "key"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    there = own.join(F.broadcast(hot), ["k", "key"], "left")
    there = there.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    met = here.join(there, ["k", "key", "salt"])
    if not renamed:
        return met.where("said = run").select(doc, item).distinct()
    one = met.groupBy(doc, "row", item, "k").agg(F.max("size").alias("size"), F.collect_list(F.struct("at", "place", (F.col("own") == F.col("plain")).alias("copied"), "template")).alias("w"))  # the windows of two texts
    one = stage(one, "met")
    schema = T.StructType([rows.schema[doc], asked.schema[item], *T._parse_datatype_string("run long, whole boolean, template long, n long").fields])

    def judge(batches):
        done = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for x, (k, size, w) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)))):
                at, place, copied, own = (np.array([v[c] for v in w]) for c in ("at", "place", "copied", "template"))
                zero = np.zeros(len(w), np.int64)
                _, _, run, whole, template = runs(zero, at, zero, place, copied.astype(bool), own, k, np.array([size]))
                for to, values in zip(out, ([x] * len(run), (run + done).tolist(), whole.tolist(), template.tolist())):
                    to += values
                done += len(w)
            take = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(2).take(take), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.int64()), pa.nulls(len(take), pa.int64())], schema.names
            )

    judged = one.mapInArrow(judge, schema)
    none = {doc: rows.schema[doc].dataType, item: asked.schema[item].dataType, "run": T.LongType(), "whole": T.BooleanType()}
    return judged.unionByName(seen.where("n is not null").select(*[F.lit(None).cast(t).alias(c) for c, t in none.items()], "template", "n"))
