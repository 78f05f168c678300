"""Greedy incremental clustering of sequences as rounds of joins.

The longest sequence is a representative; each further one joins the first representative that
is similar enough, or becomes one. On the graph of similar pairs that is the lexicographically
first maximal independent set: a node is covered as soon as an earlier neighbour is a
representative, and a representative once all earlier neighbours are covered.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.joins import join_heavy
from pairloom.operators.ordinals import with_ordinal
from pairloom.session import bounded_rows, spread, stage, unstage

IDENTITY, WORD, SHORTEST = 0.9, 5, 11
#: Rare words that a pair must share before more is fetched for it.
MEET = 4
#: So many open pairs are settled by the driver, once the rounds have become many.
REST = 100_000


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the shorter text."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def ranked_sequences(sequences: DataFrame, column: str = "sequence", shortest: int = SHORTEST) -> DataFrame:
    """(id, sequence): distinct sequences of at least ``shortest`` letters, numbered from the longest, equal lengths in order."""
    distinct = sequences.select(F.col(column).alias("sequence")).where(F.length("sequence") >= shortest).distinct().withColumn("_minus", -F.length("sequence"))
    return with_ordinal(distinct, ["_minus", "sequence"], "id").select("id", "sequence")


def similar(ranked: DataFrame, identity: float = IDENTITY, word: int = WORD) -> DataFrame:
    """(a, b), a before b: identical letters over the shorter length at least ``identity``, and enough common words.

    A pair must share at least D - word * e of the shorter one's D distinct words, e being the
    letters that may differ; so of its rarest word * e + MEET words (all, if it has fewer) MEET must be among the longer one's words, or as many as it must share at all.
    """
    if not 0 < identity <= 1:
        raise ValueError("identity must lie in (0, 1]")
    length = F.length("sequence")
    words = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(length - word + 1, F.lit(1))), lambda i: F.substring(F.col("sequence"), i, F.lit(word))))
    base = stage(spread(ranked).select("id", "sequence", length.alias("n"), F.transform(words, lambda w: F.xxhash64(w)).alias("words")), "words")
    rows = spread(base).select("id", "n", F.size("words").alias("d"), F.explode("words").alias("word"))
    total = base.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    counts = rows.groupBy("word").agg(F.count("*").alias("df")).where("df > 1").withColumn("_n", F.col("df"))
    known = join_heavy(rows, counts, ["word"], total, "_n")
    edits = F.floor((1 - identity) * F.col("n") + 1e-9).cast("int")
    offer = edits * word + MEET  # of the rarest; words no other sequence has are rarer still
    order = known.groupBy("id", "n", "d").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("w"))
    offered = order.select("id", "n", "d", F.explode(F.slice("w", F.lit(1), F.greatest(F.lit(0), offer - (F.col("d") - F.size("w"))))).alias("x")).select("id", "n", "d", "x.word")
    offered = stage(offered, "offered")
    # the longer sequence may hold words the shorter lacks, so it offers all of its words
    a = rows.select(F.col("id").alias("a"), "word")
    must = F.greatest(F.lit(1), F.least(F.lit(MEET), F.col("d") - word * edits))
    b = offered.select(F.col("id").alias("b"), "word", must.alias("must"))
    pairs = a.join(b, "word").where("a < b").groupBy("a", "b").agg(F.count("*").alias("met"), F.min("must").alias("must")).where("met >= must").select("a", "b")
    sides = [base.select(F.col("id").alias(k), F.col("sequence").alias(f"s_{k}"), F.col("words").alias(f"w_{k}"), F.col("n").alias(f"n_{k}")) for k in "ab"]
    wide = pairs.join(sides[0], "a").join(sides[1], "b")
    need = F.greatest(F.lit(1), F.size("w_b") - word * F.floor((1 - identity) * F.col("n_b") + 1e-9))
    wide = wide.where(F.size(F.array_intersect("w_a", "w_b")) >= need)
    same = F.pandas_udf(lambda x, y: pd.Series([common_letters(p, q) for p, q in zip(x, y)], dtype="int32"), "int")
    return wide.withColumn("same", same("s_a", "s_b")).where(F.col("same") >= F.col("n_b") * F.lit(identity) - 1e-9).select("a", "b")


def _in_order(pairs: list) -> list:
    """The further representatives among open pairs (a, b), of which an ``a`` that is no ``b`` is one already."""
    before: dict = {}
    for a, b in pairs:
        before.setdefault(b, []).append(a)
    covered, found = set(), []
    for b in sorted(before):
        if all(a in covered for a in before[b]):
            found.append(b)
        else:
            covered.add(b)
    return found


def greedy(nodes: DataFrame, pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, representative) of every node; ``pairs`` (a, b) has a before b.

    Rounds go on until nothing is open; each is written to the shared folder. A chain of n
    similar neighbours needs n rounds, so after ``rounds`` of them what is left is settled in
    order by the driver as soon as it is no more than ``REST`` pairs, with the same result.
    """
    open_pairs = stage(pairs.select("a", "b").where("a < b").distinct(), "pairs")
    all_pairs = open_pairs
    blocked = nodes.join(open_pairs.select(F.col("b").alias("id")).distinct(), "id", "left_anti").select("id")
    chosen = stage(blocked, "chosen")  # nothing earlier is similar
    fresh = chosen
    done = 0
    while not open_pairs.isEmpty():
        if done >= rounds and (rest := bounded_rows(open_pairs, REST)) is not None:
            late = nodes.sparkSession.createDataFrame([(x,) for x in _in_order(rest)], chosen.schema)
            chosen = stage(chosen.unionByName(late), "chosen")
            break
        done += 1
        covered = open_pairs.join(fresh.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        covered = stage(covered, "covered")
        rest = open_pairs.join(covered.withColumnRenamed("id", "b"), "b", "left_anti")  # a covered node needs no more
        waiting = rest.select(F.col("b").alias("id")).distinct()
        rest = stage(rest.join(covered.withColumnRenamed("id", "a"), "a", "left_anti"), "open")
        free = waiting.join(rest.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        before = covered, fresh, chosen, open_pairs
        fresh = stage(free, "fresh")
        chosen = stage(chosen.unionByName(fresh), "chosen")
        unstage(*(x for x in before if x is not all_pairs))
        open_pairs = rest
    nearest = all_pairs.join(chosen.withColumnRenamed("id", "a"), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("first"))
    mine = chosen.withColumn("own", F.lit(True))
    return nodes.select("id").join(mine, "id", "left").join(nearest, "id", "left").select("id", F.when(F.col("own"), F.col("id")).otherwise(F.col("first")).alias("representative"))


def cluster(sequences: DataFrame, column: str = "sequence", identity: float = IDENTITY, word: int = WORD, shortest: int = SHORTEST) -> DataFrame:
    """(sequence, representative): every distinct sequence of at least ``shortest`` letters with the sequence that stands for it.

    Null sequences are left out. Ties in length are broken by the sequence itself.
    """
    ranked = stage(ranked_sequences(sequences, column, shortest), "ranked")
    found = greedy(ranked, similar(ranked, identity, word))
    names = ranked.select(F.col("id").alias("representative"), F.col("sequence").alias("name"))
    return found.join(ranked, "id").join(names, "representative").select("sequence", F.col("name").alias("representative"))
