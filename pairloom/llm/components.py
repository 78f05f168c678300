"""Connected components by alternating stars, and splits that keep components whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.joins import join_heavy
from pairloom.operators.ordinals import with_ordinal
from pairloom.session import bounded_rows, stage, unstage


def components(nodes: DataFrame, edges: DataFrame, id: str = "id") -> DataFrame:
    """(id, group_id): the smallest id, in code point order, that each node can be reached from.

    ``edges`` has the columns ``a`` and ``b``. Edges with a null end or equal ends tie nothing,
    though a non-null end counts as a node; null nodes give no row; repeats count once.

    Large and small stars take turns (a logarithmic number of rounds in practice). Each round
    is written to the shared folder. Minima are combined before the shuffle, and a hub's edges
    stay where they are (see ``join_heavy``).
    """
    ends = edges.select(F.col("a").alias(id)).unionByName(edges.select(F.col("b").alias(id)))
    all_nodes = nodes.select(F.col(id)).unionByName(ends).where(F.col(id).isNotNull()).distinct()
    own = edges.where("a is not null and b is not null and a <> b")
    now = stage(own.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while (mark := _mark(now)) != before and mark[0]:
        before, last = mark, now
        large = stage(_large(now, mark[0]), "large")
        now = stage(_small(large, large.count()), "small")
        unstage(last, large)
    return all_nodes.join(now.select(F.col("u").alias(id), "v"), id, "left").select(id, F.coalesce("v", id).alias("group_id"))


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a checksum of them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    far = join_heavy(both, least, ["u"], 2 * total).where("v > u")
    return far.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame, total: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    near = join_heavy(edges, least, ["u"], total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


MAX_LABELS = 40
#: So many different label vectors are handled by the driver; more are refused.
MAX_VECTORS = 1_000_000


def share_out(need: list[list[float]], k: int, vector: Sequence[float], count: int, totals: Sequence[float]) -> list[int]:
    """How many of ``count`` components of one label vector each split gets; ``need`` (by split and label) is lowered.

    Each goes to the split that needs most of label ``k``. Splits that need less by no more than this component
    brings are as good: of these it goes to the one with the greatest share of all labels outstanding, the
    earlier one of equals. All but a few are placed at once, which sinks the needs to one level.
    """
    taken = [0] * len(need)
    weight, bulk = vector[k], count - 4 * len(need)
    if bulk > 0:
        order = sorted(range(len(need)), key=lambda s: -need[s][k])
        for n in range(len(order), 0, -1):
            level = (sum(need[s][k] for s in order[:n]) - bulk * weight) / n
            if n == 1 or need[order[n - 1]][k] > level:
                for s in order[:n]:
                    taken[s] = max(0, int((need[s][k] - level) / weight - 1e-9))
                break
        for s, x in enumerate(taken):
            for j, w in enumerate(vector):
                need[s][j] -= w * x
    for _ in range(count - sum(taken)):
        most = max(n[k] for n in need) - weight
        s = max((s for s in range(len(need)) if need[s][k] >= most), key=lambda s: (sum(x / t for x, t in zip(need[s], totals) if t > 0), -s))
        taken[s] += 1
        for j, w in enumerate(vector):
            need[s][j] -= w
    return taken


def stratify(vectors: Sequence[tuple[float, ...]], counts: Sequence[int], shares: Sequence[tuple[str, float]]) -> list[list[int]]:
    """Iterative stratification of components with label vectors ``vectors``, ``counts`` of each: how many of them each split gets.

    The label with least outstanding weight is served first, by the largest component that has
    it: it goes to the split that needs most of that label (see ``share_out``). A component's size is its largest share of any
    label. Components without labels go to the first split. At last ``settle`` evens out what the
    order of the labels left uneven.
    """
    labels = len(vectors[0]) if vectors else 0
    totals = [sum(v[k] * c for v, c in zip(vectors, counts)) for k in range(labels)]
    need = [[share * t for t in totals] for _, share in shares]
    left = list(totals)
    size = [max((w / t for w, t in zip(v, totals) if t > 0), default=0.0) for v in vectors]
    by_label = [sorted((i for i, v in enumerate(vectors) if v[k] > 0), key=lambda i: (-size[i], vectors[i])) for k in range(labels)]
    at = [0] * labels
    placed: list[list[int] | None] = [None] * len(vectors)
    while True:
        waiting = []
        for k in range(labels):
            while at[k] < len(by_label[k]) and placed[by_label[k][at[k]]] is not None:
                at[k] += 1
            if at[k] < len(by_label[k]):
                waiting.append(k)
        if not waiting:
            break
        k = min(waiting, key=lambda x: (left[x], x))
        i = by_label[k][at[k]]
        placed[i] = share_out(need, k, vectors[i], counts[i], totals)
        for j in range(labels):
            left[j] -= vectors[i][j] * counts[i]
    settled = [p if p is not None else [c] + [0] * (len(shares) - 1) for p, c in zip(placed, counts)]
    settle(settled, need, vectors, totals)
    return settled


#: At most so often is every vector looked at again.
SWEEPS = 10


def settle(placed: list[list[int]], need: list[list[float]], vectors: Sequence[tuple[float, ...]], totals: Sequence[float]) -> None:
    """Moves components between splits while that lowers the squared shares that are still outstanding, as many of a vector at once as lower them most."""
    scale = [1 / t if t > 0 else 0.0 for t in totals]
    for _ in range(SWEEPS):
        moved = False
        for v, taken in zip(vectors, placed):
            unit = [w * x for w, x in zip(v, scale)]
            if not (norm := sum(x * x for x in unit)):
                continue
            for s in range(len(taken)):
                for t in range(len(taken)):
                    if s == t or not taken[s]:
                        continue
                    x = min(taken[s], round(sum(u * (need[t][j] - need[s][j]) * scale[j] for j, u in enumerate(unit)) / (2 * norm) - 1e-9))
                    if x > 0:
                        moved = True
                        taken[s] -= x
                        taken[t] += x
                        for j, w in enumerate(v):
                            need[s][j] += w * x
                            need[t][j] -= w * x
        if not moved:
            return


def assign_splits(groups: DataFrame, weights: DataFrame, shares: Sequence[tuple[str, float]], seed: int = 17) -> DataFrame:
    """(group_id, split) for every row of ``groups`` (column group_id).

    ``weights`` has (group_id, label, weight). Grouped iterative stratification: label vectors
    are summed by component, and every component is placed. Components with the same vector
    are alike to the method, so the driver handles each vector once with its number of components, and
    which of them go where is decided by their order after a seeded hash. At most MAX_LABELS labels and
    MAX_VECTORS different vectors, else a ValueError. Groups without weight go to the first
    split; null groups give no row; shares are scaled to add up to 1, and without any share
    that is above 0 a ValueError is raised.
    """
    shares = [(n, s) for n, s in shares if s and s > 0]
    if not shares:
        raise ValueError("no share above 0")
    whole = sum(s for _, s in shares)
    shares = [(n, s / whole) for n, s in shares]
    found = bounded_rows(weights.where("label is not null and weight > 0").groupBy("label").agg(F.sum("weight").cast("double").alias("t")), MAX_LABELS)
    if found is None:
        raise ValueError(f"more than {MAX_LABELS} labels")
    totals = {r["label"]: r["t"] for r in found}
    labels = sorted(totals)
    groups = groups.select("group_id").where("group_id is not null").distinct()
    if not labels:
        return groups.withColumn("split", F.lit(shares[0][0]))
    names = [f"w{i}" for i in range(len(labels))]
    sums = [F.coalesce(F.sum(F.when(F.col("label") == x, F.col("weight"))), F.lit(0)).cast("double").alias(w) for w, x in zip(names, labels)]
    vectors = groups.join(weights.where("weight > 0").groupBy("group_id").agg(*sums), "group_id", "left").na.fill(0.0)
    numbered = stage(with_ordinal(vectors.withColumn("_h", F.xxhash64(F.lit(seed), "group_id")), [*names, "_h", "group_id"], "ordinal"), "vectors")
    alike = numbered.groupBy(*names).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    rows = bounded_rows(alike, MAX_VECTORS)
    if rows is None:
        raise ValueError(f"more than {MAX_VECTORS} different label vectors")
    rows.sort(key=lambda r: r["first"])
    placed = stratify([tuple(r[w] for w in names) for r in rows], [r["n"] for r in rows], shares)
    lines = []
    for r, taken in zip(rows, placed):
        upto, ends = r["first"], []
        for x in taken:
            upto += x
            ends.append(upto)
        lines.append((*(r[w] for w in names), r["n"], ends))
    spark = groups.sparkSession
    chosen = spark.createDataFrame(lines, ", ".join(f"{w} double" for w in names) + ", n long, ends array<long>") if lines else alike.select(*names, "n", F.array("first").alias("ends"))
    met = join_heavy(numbered, chosen, names, sum(r["n"] for r in rows))
    split = F.get(F.array(*[F.lit(n) for n, _ in shares]), F.size(F.filter("ends", lambda e: e <= F.col("ordinal"))))
    return met.select("group_id", split.alias("split"))
