"""The whole pipeline as DataFrame programs: curate, extract, group, cluster, profile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import candidates as cand
from pairloom.operators.clustering import cluster
from pairloom.operators.extraction import extract
from pairloom.operators.fasta import fasta_records, group_sequences
from pairloom.operators.representatives import select_representatives
from pairloom.schemas import CANDIDATE_COLUMNS
from pairloom.session import stage


@dataclass
class Curated:
    """``candidates`` and ``selected`` in order of (pdb_id, assembly_number) at the sink; ``rejects`` with reasons."""

    candidates: DataFrame
    selected: DataFrame
    rejects: DataFrame


def latest_documents(docs: DataFrame, key: str = "assembly_id", stamp: str = "fetched_at", tie: str = "landing_id") -> DataFrame:
    """Of repeated deliveries the latest; rows without a key are kept as they are."""
    keyed = docs.where(F.col(key).isNotNull())
    newest = keyed.groupBy(F.upper(key).alias("_key")).agg(F.max(F.struct(F.col(stamp), F.col(tie))).alias("_at"))
    kept = keyed.withColumn("_key", F.upper(key)).join(newest, "_key").where((F.col(tie) == F.col("_at")[tie])).drop("_key", "_at")
    return kept.unionByName(docs.where(F.col(key).isNull()))


def curate(docs: DataFrame, payload: str = "payload", *, files_base: str = "") -> Curated:
    """Documents are read and derived once; candidates, rejects and representatives come from the stored result."""
    derived = stage(cand.derive(docs.select(payload), payload, files_base=files_base), "derived")
    found = cand.candidates(derived)
    best = select_representatives(found)
    return Curated(found.select(*CANDIDATE_COLUMNS, "entity_clusters"), best.select(*CANDIDATE_COLUMNS, "entity_clusters"), cand.rejects(derived))


def sequences(selected: DataFrame, structures: DataFrame, *, aligned: bool = False) -> DataFrame:
    return extract(selected, stage(structures, "structures"), aligned=aligned)


def to_fasta(table: DataFrame, ord: str, *, drop_missing: bool = False) -> DataFrame:
    return fasta_records(group_sequences(table, ord, drop_missing=drop_missing))


def clusters(table: DataFrame, identity: float = 0.9) -> DataFrame:
    return cluster(table, identity=identity)


def load(spark: SparkSession, path: str) -> DataFrame:
    """Landed documents, one JSON text a line."""
    return spark.read.text(path).withColumnRenamed("value", "payload")
