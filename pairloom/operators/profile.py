"""Profiles of tables: counts, shares, distributions and links to selected rows. All return DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import stage


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n): most frequent first, ties by value; nulls are left out."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def shares(df: DataFrame, column: str) -> DataFrame:
    """``value_counts`` with the share in percent, to one decimal."""
    counts = value_counts(df, column)
    whole = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("percent", F.round(F.try_divide(F.lit(100.0) * F.col("n"), whole), 1)).orderBy(F.desc("n"), "value")


def duplicates(df: DataFrame, column: str, order: list[str], salts: int = 32) -> DataFrame:
    """Every row whose value an earlier row has. Nulls are equal to each other; of rows equal in
    ``order`` any is the first.

    A value's rows are ranked in ``salts`` parts, and only the first of each part meet, so that a
    value that most rows have is not ranked in one task.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(salts))
    ranked = df.withColumn("_part", part).withColumn("_k", F.row_number().over(Window.partitionBy(column, "_part").orderBy(*order)))
    later = ranked.where("_k > 1").drop("_part", "_k")
    first = ranked.where("_k = 1").drop("_part", "_k").withColumn("_k", F.row_number().over(Window.partitionBy(column).orderBy(*order)))
    return later.unionByName(first.where("_k > 1").drop("_k"))


def describe(df: DataFrame, column: str | Column) -> DataFrame:
    """One row: count, mean, std (sample), min, q25, q50, q75 (exact, interpolated), max."""
    c = F.col(column) if isinstance(column, str) else column
    q = F.percentile(c, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    out = df.agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), q.alias("_q"), F.max(c).alias("max"))
    return out.select("count", "mean", "std", "min", *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin from 1, n) of equal widths over the whole range, the last one closed; bins without values have n = 0.
    A range of one value puts all in bin 1; no values give no rows."""
    if bins < 1:
        raise ValueError("at least one bin")
    value = F.col(column).cast("double")
    lo, hi = (df.agg(f(value)).scalar() for f in (F.min, F.max))
    at = F.when(hi > lo, F.least(F.floor((value - lo) * bins / (hi - lo)) + 1, F.lit(bins))).otherwise(1)
    counted = df.where(F.col(column).isNotNull()).select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).where(lo.isNotNull())
    return grid.join(F.broadcast(counted), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def cutoffs(df: DataFrame, column: str, above: float, below: float) -> DataFrame:
    """One row: how many values lie above and below."""
    return df.agg(F.count_if(F.col(column) > above).alias("n_above"), F.count_if(F.col(column) < below).alias("n_below"))


def letter_share_by_length(df: DataFrame, column: str, letter: str = "X", longest: int = 50) -> DataFrame:
    """(length, mean_percent) for lengths 1 to ``longest``: the mean share of ``letter`` in texts of that length, 0 without any."""
    n = F.length(column)
    rows = df.where((n >= 1) & (n <= longest)).select(n.alias("length"), (F.regexp_count(column, F.lit(f"\\Q{letter}\\E")) / n * F.lit(100.0)).alias("p"))
    means = rows.groupBy("length").agg(F.avg("p").alias("mean_percent"))
    grid = df.sparkSession.range(1, longest + 1).select(F.col("id").cast("int").alias("length"))
    return grid.join(F.broadcast(means), "length", "left").select("length", F.coalesce("mean_percent", F.lit(0.0)).alias("mean_percent"))


def rows_naming(df: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """The rows of which any comma part of ``column`` is among ``names``; parts aren't stripped; each row once."""
    keyed = stage(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    parts = keyed.select("_row", F.explode(F.split(column, ",", -1)).alias(name))
    hit = parts.join(names.select(name).distinct(), name, "left_semi").select("_row").distinct()
    return keyed.join(hit, "_row", "left_semi").drop("_row")
