"""Mixing overlapping sources to target weights as a flow of least cost.

A text may stand in several sources. Texts are summed by the set of sources they stand in (their
pattern); token capacity flows from patterns to the quotas of the sources, and each further use
of a pattern's texts costs more than the one before, so that repetition is spread thinly. The
flows are then turned into documents in a seeded order.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.text import strip
from pairloom.session import bounded_rows, spread, stage

#: The pattern that splits text before the merges of the rank files (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MAX_SOURCES = 60
#: More patterns (sets of sources that a text stands in) are refused.
MAX_PATTERNS = 20_000
#: Texts of a pattern that are put in order together.
BUCKET_TEXTS = 50_000
#: Longer texts are encoded in parts of about this many characters, cut before white space.
PART = 100_000


def source_name(c: Column) -> Column:
    """Lower case, no outer white space, inner spaces and hyphens as underscores."""
    return F.regexp_replace(F.lower(strip(c)), "[ -]", "_")


def encoder(vocabulary: str | bytes):
    """The tokenizer of a rank file, given by its path or content."""
    import tiktoken

    if isinstance(vocabulary, str):
        with open(vocabulary, "rb") as f:
            vocabulary = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str) -> list[str]:
    """The text in parts; a cut before white space that follows a letter leaves the tokens as they are."""
    if len(text) <= PART:
        return [text]
    out, at = [], 0
    while len(text) - at > PART:
        cut = at + PART
        while cut > at + PART // 2 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut -= 1
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def measure(docs: DataFrame, doc: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, key, tokens): the size of every text and a 128-bit key of equal texts.

    Rows with a null id, null or blank source or empty text give no row. The rank file is read
    by the driver and sent to the tasks, so it need not exist elsewhere.
    """
    rows = docs.select(F.col(doc).alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(text).alias("text"))
    rows = spread(rows.where("doc_id is not null and source <> '' and text <> ''"))
    schema = T.StructType([rows.schema["doc_id"], rows.schema["source"], T.StructField("key", T.BinaryType()), T.StructField("tokens", T.LongType())])

    with open(tokenizer, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encode = encoder(sent.value).encode_ordinary
        for batch in batches:
            texts = batch.column(2).to_pylist()
            keys = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            sizes = [sum(len(encode(p)) for p in parts(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "source", "key", "tokens"])

    return rows.mapInArrow(run, schema)


@dataclass
class Plan:
    """Tokens from each pattern to each source, and the size of the whole mix."""

    flows: dict[tuple[tuple[int, ...], int], int]
    total: int


class _Flow:
    """Greatest flow from patterns to the quotas of their sources, by shortest augmenting paths in
    layers. Rooms only grow, so a flow stays where it is and more is sent on top of it."""

    def __init__(self, patterns: list[tuple[int, ...]], quotas: list[int]):
        self.patterns, self.left = patterns, list(quotas)
        self.sent: list[dict[int, int]] = [dict.fromkeys(p, 0) for p in patterns]  # to each source
        self.used, self.room = [0] * len(patterns), [0] * len(patterns)
        self.into: list[list[int]] = [[] for _ in quotas]  # the patterns of a source
        for i, p in enumerate(patterns):
            for s in p:
                self.into[s].append(i)

    def grow(self) -> int:
        """Sends what the rooms allow; returns how much is sent in all. Afterwards ``blocked`` tells
        which sources no spare room can reach."""
        while True:
            layer = [-1] * len(self.patterns)
            depth = [-1] * len(self.left)
            front = [i for i in range(len(self.patterns)) if self.room[i] > self.used[i]]
            for i in front:
                layer[i] = 0
            at, met = 0, False
            while front and not met:
                at += 1
                sources = []
                for i in front:
                    for s in self.patterns[i]:
                        if depth[s] < 0:
                            depth[s] = at
                            sources.append(s)
                            met |= self.left[s] > 0
                at += 1
                front = []
                if not met:
                    for s in sources:  # what a pattern sends there may be sent elsewhere
                        for i in self.into[s]:
                            if layer[i] < 0 and self.sent[i][s] > 0:
                                layer[i] = at
                                front.append(i)
            if not met:
                self.blocked = [d < 0 for d in depth]
                return sum(self.used)
            tried = [0] * len(self.patterns), [0] * len(self.left)
            for i in range(len(self.patterns)):
                if layer[i] == 0:
                    while self.room[i] > self.used[i] and (moved := self._push(i, self.room[i] - self.used[i], layer, depth, tried)):
                        self.used[i] += moved

    def _push(self, i: int, most: int, layer: list[int], depth: list[int], tried: tuple[list[int], list[int]]) -> int:
        """Moves up to ``most`` from pattern ``i`` along one path of the layers (at most two steps for each source)."""
        path: list[tuple[int, int]] = []  # (pattern, source)
        while True:
            own = self.patterns[i]
            while tried[0][i] < len(own) and depth[own[tried[0][i]]] != layer[i] + 1:
                tried[0][i] += 1
            if tried[0][i] == len(own):
                if not path:
                    return 0
                i, s = path.pop()
                tried[1][s] += 1
                s_done = self._next(s, depth, layer, tried)
                if s_done is None:
                    tried[0][i] += 1
                else:
                    path.append((i, s))
                    i = s_done
                continue
            s = own[tried[0][i]]
            if self.left[s] > 0:
                path.append((i, s))
                break
            onward = self._next(s, depth, layer, tried)
            if onward is None:
                tried[0][i] += 1
            else:
                path.append((i, s))
                i = onward
        moved = min([most, self.left[path[-1][1]], *(self.sent[path[k + 1][0]][path[k][1]] for k in range(len(path) - 1))])
        for k, (x, s) in enumerate(path):
            self.sent[x][s] += moved
            if k + 1 < len(path):
                self.sent[path[k + 1][0]][s] -= moved
        self.left[path[-1][1]] -= moved
        return moved

    def _next(self, s: int, depth: list[int], layer: list[int], tried: tuple[list[int], list[int]]) -> int | None:
        """The next pattern that can take back what it sends to ``s``."""
        into = self.into[s]
        while tried[1][s] < len(into):
            i = into[tried[1][s]]
            if layer[i] == depth[s] + 1 and self.sent[i][s] > 0 and tried[0][i] < len(self.patterns[i]):
                return i
            tried[1][s] += 1
        return None


def _feasible(patterns: list[tuple[int, ...]], rooms: list[int], quotas: list[int]) -> tuple[bool, list[bool]]:
    """Whether all quotas can be met; else the sources whose patterns have too little for them."""
    flow = _Flow(patterns, quotas)
    flow.room = list(rooms)
    return flow.grow() == sum(quotas), flow.blocked


def solve(capacity: dict[tuple[int, ...], int], shares: list[float], repeats: list[int], total: int | None = None) -> Plan:
    """Routes tokens so that each source gets its share of the largest mix there is, or of ``total`` if that is smaller.

    ``capacity``: tokens of the distinct texts of each pattern (a tuple of source numbers). A
    text counts at most as often as the smallest ``repeats`` of its sources allows. Sources
    without tokens get nothing, and the shares of the others are scaled up.

    The largest total is found from above: a set of sources that can't have their quotas bounds
    the total by the tokens of its patterns. The k-th use of a text costs k - 1, the same for
    all, so the cheapest flow is the greatest one with first uses, enlarged by second uses where
    those don't suffice, and so on: a later use never makes an earlier one dearer.
    """
    can = {s for p in capacity for s in p if capacity[p] > 0 and shares[s] > 0 and repeats[s] > 0}
    shrunk: dict[tuple[int, ...], int] = {}
    for p, t in capacity.items():
        q = tuple(s for s in p if s in can)
        if q and t > 0:
            shrunk[q] = shrunk.get(q, 0) + t
    if not shrunk:
        return Plan({}, 0)
    whole = sum(shares[s] for s in can)
    part = [shares[s] / whole if s in can else 0.0 for s in range(len(shares))]
    patterns = sorted(shrunk)
    most = [min(repeats[s] for s in p) for p in patterns]
    rooms = [shrunk[p] * m for p, m in zip(patterns, most)]
    low, high = 0, sum(rooms)
    if total is not None:
        high = min(high, total)
    down = True
    while low < high:
        middle = high if down else (low + high + 1) // 2
        good, lacking = _feasible(patterns, rooms, [int(x * middle) for x in part])
        if good:
            low = middle
            continue
        held = sum(r for p, r in zip(patterns, rooms) if any(lacking[s] for s in p))
        share = sum(part[s] for s, x in enumerate(lacking) if x)
        bound = int((held + sum(lacking)) / share) + 1 if share > 0 else middle - 1  # quotas are cut to whole tokens
        down = bound < middle - 1
        high = min(middle - 1, bound)
    flow = _Flow(patterns, [int(x * low) for x in part])
    for use in range(max(most)):
        for i, p in enumerate(patterns):
            if use < most[i]:
                flow.room[i] += shrunk[p]
        flow.grow()
    return Plan({(p, s): f for p, own in zip(patterns, flow.sent) for s, f in own.items() if f > 0}, sum(flow.used))


def targets_of(targets: DataFrame, source: str, share: str, repeats: str) -> list[tuple[str, float, int]]:
    """(source, share, repeats) by name: equal names add their shares and take the smaller limit;
    shares that are null or not above 0 are left out; a null limit is 1."""
    rows = targets.select(source_name(F.col(source)).alias("source"), F.col(share).cast("double").alias("share"), F.coalesce(F.col(repeats), F.lit(1)).cast("int").alias("repeats"))
    rows = rows.where("source <> '' and share > 0").groupBy("source").agg(F.sum("share").alias("share"), F.min("repeats").alias("repeats")).orderBy("source")
    found = bounded_rows(rows, MAX_SOURCES)
    if found is None:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return [(r["source"], r["share"], max(0, r["repeats"])) for r in found]


def mix(measured: DataFrame, targets: list[tuple[str, float, int]], total: int | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, uses, tokens): each chosen text as the smallest document id that it has in
    the source it is used for, how often it is used and the tokens of one use.

    ``measured`` comes from ``measure`` and is read twice, so it should be stored. Which texts
    are taken depends on ``seed`` and the texts alone. Sources without a target are left out. Quotas
    are met up to the text that crosses a boundary. Every set of sources takes part in the flow;
    more than MAX_PATTERNS of them are refused with a ValueError.
    """
    spark = measured.sparkSession
    schema = f"doc_id {measured.schema['doc_id'].dataType.simpleString()}, source string, uses int, tokens long"
    if not targets:
        return spark.createDataFrame([], schema)
    number = F.coalesce(*[F.when(F.col("source") == n, F.lit(i)) for i, (n, _, _) in enumerate(targets)])
    own = measured.where(F.col("source").isin([n for n, _, _ in targets]) & (F.col("tokens") > 0)).withColumn("s", number)
    per = own.groupBy("key", "s").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    texts = per.groupBy("key").agg(F.max("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("s", "doc_id"))).alias("docs"))  # a row a source
    texts = texts.withColumns({"pattern": F.array_join(F.col("docs.s").cast("array<string>"), ","), "h": F.xxhash64(F.lit(seed), "key")})
    texts = stage(texts, "texts")
    sums = texts.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    rows = bounded_rows(sums, MAX_PATTERNS)
    if rows is None:
        raise ValueError(f"texts stand in more than {MAX_PATTERNS} sets of sources")
    capacity = {tuple(map(int, r["pattern"].split(","))): r["tokens"] for r in rows}
    repeats = [r for _, _, r in targets]
    plan = solve(capacity, [s for _, s, _ in targets], repeats, total)
    usable = {s for _, s in plan.flows}
    merged: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
    for p in capacity:  # patterns that differ only in sources that get nothing share a line
        merged.setdefault(tuple(s for s in p if s in usable), []).append(p)
    lines = []
    for q, ps in merged.items():
        at, segments = 0, []
        for s in q:
            if f := plan.flows.get((q, s)):
                segments.append((at, at + f, s))
                at += f
        if segments:
            length = sum(capacity[p] for p in ps)
            lines += [(",".join(map(str, p)), ",".join(map(str, q)), length, -(-at // length), segments) for p in ps]
    if not lines:
        return spark.createDataFrame([], schema)
    chosen = spark.createDataFrame(lines, "pattern string, line string, length long, rounds int, segments array<struct<lo: long, hi: long, s: int>>")
    buckets = max(16, sum(r["n"] for r in rows) // BUCKET_TEXTS)
    lined = texts.join(F.broadcast(chosen), "pattern").withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 16), F.lit(buckets)))
    before = Window.partitionBy("line").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = lined.groupBy("line", "bucket").agg(F.sum("tokens").alias("t")).select("line", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("line", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = lined.withColumn("inside", F.coalesce(F.sum("tokens").over(inner), F.lit(0))).join(base, ["line", "bucket"])
    start = F.col("base") + F.col("inside")
    owners = F.transform(
        F.sequence(F.lit(0), F.col("rounds") - 1),
        lambda r: F.get(F.transform(F.filter(F.col("segments"), lambda x: (x["lo"] <= r * F.col("length") + start) & (r * F.col("length") + start < x["hi"])), lambda x: x["s"]), F.lit(0)),
    )
    used = placed.withColumn("owners", F.array_compact(owners)).select("tokens", "docs", "owners", F.explode(F.array_distinct("owners")).alias("s"))
    name = F.coalesce(*[F.when(F.col("s") == i, F.lit(n)) for i, (n, _, _) in enumerate(targets)])
    doc = F.filter("docs", lambda x: x["s"] == F.col("s"))[0]["doc_id"]
    return used.select(doc.alias("doc_id"), name.alias("source"), F.size(F.filter("owners", lambda x: x == F.col("s"))).alias("uses"), "tokens")
