"""The best candidate of every unordered cluster pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_key(resolution: Column, modeled: Column, pdb: Column, number: Column) -> list[Column]:
    """Resolution up (none and NaN last), modelled residues down, then ids as texts."""
    return [F.when(resolution.isNull() | F.isnan(resolution), F.lit(float("inf"))).otherwise(resolution).asc(), F.coalesce(modeled, F.lit(0)).desc(), pdb.asc(), number.asc()]


def select_representatives(table: DataFrame, key: str = "cluster_pair_100pct", order: list[Column] | None = None) -> DataFrame:
    """One row a key. The row number's limit is applied before and after the shuffle, so a hot
    key sends one row a task. Null keys form one group; wholly equal ranks are settled by all columns."""
    order = order or rank_key(F.col("resolution_best_angstrom"), F.col("modeled_polymer_monomer_count"), F.col("pdb_id"), F.col("assembly_number"))
    ties = [F.col(c) for c, t in table.dtypes if not t.startswith(("map", "variant"))]
    ranked = table.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order, *ties)))
    return ranked.where("_rank = 1").drop("_rank")
