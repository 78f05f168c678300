"""A join whose hot keys never meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than 1/HOT of all rows: there are fewer than HOT such keys.
HOT = 500


def join_heavy(big: DataFrame, one: DataFrame, key: list[str], total: int, count: str = "n", least: int = 100_000) -> DataFrame:
    """``big`` inner-joined to ``one``, which has one row a key and that key's rows in ``big`` as ``count``.

    Rows of hot keys meet theirs by a broadcast of at most HOT rows and so stay where they are;
    the others are shuffled, none of their keys having more than 1/HOT of the rows. ``count``
    is dropped. Below ``least`` rows in all, one plain join is used.
    """
    if total < least:
        return big.join(one.drop(count), key)
    hot = F.col(count) > total / HOT
    few = F.broadcast(one.where(hot).drop(count))
    met = big.join(few, key)
    rest = big.join(F.broadcast(one.where(hot).select(*key)), key, "left_anti").join(one.where(~hot).drop(count), key)
    return met.unionByName(rest)
