"""Equal sequences as FASTA records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ordinals import with_ordinal


def _seen(df: DataFrame, key: list[str], value: str, ord: str) -> DataFrame:
    """The distinct non-null values of each key in the order they were first seen; values are made distinct before they meet."""
    once = df.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(ord).alias("_first"))
    return once.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_first", value))), lambda x: x[value]).alias(f"{value}s"))


def group_sequences(sequences: DataFrame, ord: str, *, drop_missing: bool = False) -> DataFrame:
    """(sequence, entity_names, cluster_ids): lists in first-seen order of ``ord``; null sequences give no group.

    ``drop_missing`` leaves out the placeholder ``-``, which otherwise is one group.
    """
    rows = sequences.where("sequence is not null")
    if drop_missing:
        rows = rows.where("sequence <> '-'")
    one = rows.select("sequence").distinct()
    empty = F.array().cast("array<string>")
    both = one.join(_seen(rows, ["sequence"], "entity_name", ord), "sequence", "left").join(_seen(rows, ["sequence"], "cluster_id", ord), "sequence", "left")
    return both.select("sequence", F.coalesce("entity_names", empty).alias("entity_names"), F.coalesce("cluster_ids", empty).alias("cluster_ids"))


def fasta_records(groups: DataFrame) -> DataFrame:
    """(ordinal, header, sequence): numbered from 0 in order of the sequences; ``>i;clusters;entities``."""
    numbered = with_ordinal(groups, ["sequence"])
    header = F.concat(F.lit(">"), F.col("ordinal"), F.lit(";"), F.array_join("cluster_ids", " "), F.lit(";"), F.array_join("entity_names", " "))
    return numbered.select("ordinal", header.alias("header"), "sequence")


def several_clusters(groups: DataFrame) -> DataFrame:
    """Sequences found in more than one cluster."""
    return groups.where(F.size("cluster_ids") > 1)


def several_sequences(sequences: DataFrame) -> DataFrame:
    """(cluster_id, n): clusters with more than one sequence."""
    pairs = sequences.where("cluster_id is not null and sequence is not null").select("cluster_id", "sequence").distinct()
    return pairs.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1")


def write_fasta(records: DataFrame, path: str, *, one_file: bool = False) -> None:
    """Two lines a record, in order of the ordinals within each part."""
    n = 1 if one_file else int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = records.repartitionByRange(n, "ordinal").sortWithinPartitions("ordinal")
    placed.select(F.concat_ws("\n", "header", "sequence").alias("value")).write.text(path)
