"""Global ordinals without a single task: range partitions, and an offset for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import stage

#: monotonically_increasing_id holds the partition above so many bits.
_BITS = 33


def with_ordinal(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """``df`` with 0-based numbers in the order of ``order`` (nulls first); rows equal in it are numbered in any order.

    The rows are range-partitioned and numbered in place; only the partitions' sizes are summed.
    """
    if not order:
        raise ValueError("no order")
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = stage(placed.withColumn("_part", F.shiftright("_id", _BITS)), "ordinals")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    number = F.col("_offset") + F.col("_id").bitwiseAND((1 << _BITS) - 1)
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, number).drop("_id", "_part", "_offset")
