"""The pipeline's stages on the supplied protein tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import candidates as cand
from pairloom.operators import profile
from pairloom.operators.fasta import fasta_records, group_sequences, several_clusters, several_sequences
from pairloom.operators.representatives import select_representatives
from pairloom.plans import curation
from pairloom.plans.derivation_sql import DERIVED
from pairloom.plans.problems import table
from pairloom.session import stage

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {DERIVED.replace('SOURCE', 'assembly')} SELECT * EXCLUDE (fetched_at, key) FROM candidates")
def d01_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate rows of all landed documents, with the landing row."""
    docs = table(spark, sf, "assembly").select("landing_id", "payload")
    return cand.candidates(stage(cand.derive(docs), "derived")).drop("rank_resolution")


@query(f"WITH {DERIVED.replace('SOURCE', 'assembly')} SELECT reject, count(*) AS n FROM judged WHERE reject IS NOT NULL GROUP BY 1")
def d02_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents give no candidate, by reason."""
    docs = table(spark, sf, "assembly").select("landing_id", "payload")
    return cand.derive(docs).where("reject is not null").groupBy("reject").agg(F.count("*").alias("n"))


_LATEST = "(SELECT * FROM assembly QUALIFY assembly_id IS NULL OR row_number() OVER (PARTITION BY upper(assembly_id) ORDER BY fetched_at DESC NULLS LAST, landing_id DESC NULLS LAST) = 1)"


@query(f"""
WITH {DERIVED.replace('SOURCE', _LATEST)} SELECT * EXCLUDE (landing_id, fetched_at, key) FROM candidates
QUALIFY row_number() OVER (PARTITION BY cluster_pair_100pct ORDER BY coalesce(resolution_best_angstrom, 'infinity'::double), modeled_polymer_monomer_count DESC, pdb_id, assembly_number,
  entity_pair, uniprot_pair, species_pair, taxonomy_pair, dimer_type, resolution_best_angstrom, experimental_method, oligomeric_count, entity_clusters) = 1
""")
def d03_selected(spark: SparkSession, sf: str) -> DataFrame:
    """The representatives of the latest documents."""
    return curation.curate(curation.latest_documents(table(spark, sf, "assembly"))).selected


@query("""
SELECT cluster_pair_100pct, assembly_id, candidate_id FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_pair_100pct ORDER BY CASE WHEN resolution_best_angstrom IS NULL OR isnan(resolution_best_angstrom) THEN 'infinity'::double ELSE resolution_best_angstrom END,
    coalesce(modeled_polymer_monomer_count, 0) DESC, pdb_id, assembly_number, candidate_id) AS k FROM candidate
) WHERE k = 1
""")
def d04_best_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The best candidate row of each cluster pair as it is written."""
    names = ["candidate_id", "assembly_id", "pdb_id", "assembly_number", "cluster_pair_100pct", "resolution_best_angstrom", "modeled_polymer_monomer_count"]
    return select_representatives(table(spark, sf, "candidate").select(*names)).select("cluster_pair_100pct", "assembly_id", "candidate_id")


@query("""
WITH e AS (SELECT sequence, string_agg(entity_name, ' ' ORDER BY f, entity_name) AS x FROM (SELECT sequence, entity_name, min(row_id) AS f FROM entity_sequences WHERE entity_name IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
     c AS (SELECT sequence, string_agg(cluster_id, ' ' ORDER BY f, cluster_id) AS x FROM (SELECT sequence, cluster_id, min(row_id) AS f FROM entity_sequences WHERE cluster_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
     s AS (SELECT sequence, row_number() OVER (ORDER BY sequence) - 1 AS ordinal FROM (SELECT DISTINCT sequence FROM entity_sequences WHERE sequence IS NOT NULL))
SELECT ordinal, '>' || ordinal || ';' || coalesce(c.x, '') || ';' || coalesce(e.x, '') AS header, sequence FROM s LEFT JOIN e USING (sequence) LEFT JOIN c USING (sequence)
""")
def d05_fasta(spark: SparkSession, sf: str) -> DataFrame:
    return fasta_records(group_sequences(table(spark, sf, "entity_sequences"), "row_id"))


@query("SELECT sequence, count(DISTINCT cluster_id) AS n FROM entity_sequences WHERE sequence IS NOT NULL GROUP BY 1 HAVING count(DISTINCT cluster_id) > 1")
def d06_sequences_in_several_clusters(spark: SparkSession, sf: str) -> DataFrame:
    groups = group_sequences(table(spark, sf, "entity_sequences"), "row_id")
    return several_clusters(groups).select("sequence", F.size("cluster_ids").cast("long").alias("n"))


@query("SELECT cluster_id, count(DISTINCT sequence) AS n FROM entity_sequences WHERE cluster_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sequence) > 1")
def d07_clusters_with_several_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return several_sequences(table(spark, sf, "entity_sequences"))


@query("""
SELECT count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, max(n) AS max, round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS q50, round(quantile_cont(n, 0.75), 6) AS q75
FROM (SELECT length(sequence) AS n FROM entity_sequences)
""")
def d08_lengths(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.describe(table(spark, sf, "entity_sequences").select(F.length("sequence").cast("long").alias("n")), "n")
    return out.select("count", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q25", "q50", "q75")])


@query("""
SELECT g.n::int AS length, round(coalesce(avg((length(sequence) - length(replace(sequence, 'X', ''))) * 100.0::double / length(sequence)), 0.0), 6)::double AS mean_percent
FROM (SELECT range AS n FROM range(1, 51)) g LEFT JOIN entity_sequences ON length(sequence) = g.n GROUP BY 1
""")
def d09_unknown_residues(spark: SparkSession, sf: str) -> DataFrame:
    return profile.letter_share_by_length(table(spark, sf, "entity_sequences"), "sequence").select("length", F.round("mean_percent", 6).alias("mean_percent"))


@query("SELECT dimer_type AS value, count(*) AS n, round(100.0::double * count(*) / sum(count(*)) OVER (), 1) AS percent FROM selected_assemblies WHERE dimer_type IS NOT NULL GROUP BY 1")
def d10_dimer_shares(spark: SparkSession, sf: str) -> DataFrame:
    return profile.shares(table(spark, sf, "selected_assemblies"), "dimer_type")


@query("""
SELECT selected_id FROM selected_assemblies WHERE list_has_any(string_split(entity_pair, ','), (SELECT list(entity_name) FROM entity_sequences WHERE length(sequence) > 400))
""")
def d11_pairs_with_long_sequences(spark: SparkSession, sf: str) -> DataFrame:
    long = table(spark, sf, "entity_sequences").where(F.length("sequence") > 400).select("entity_name")
    return profile.rows_naming(table(spark, sf, "selected_assemblies").select("selected_id", "entity_pair"), "entity_pair", long, "entity_name").select("selected_id")


@query("SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY entity_name ORDER BY row_id) AS k FROM entity_sequences) WHERE k > 1")
def d12_repeated_entities(spark: SparkSession, sf: str) -> DataFrame:
    return profile.duplicates(table(spark, sf, "entity_sequences").select("row_id", "entity_name"), "entity_name", ["row_id"]).select("row_id")


@query()
def d13_greedy_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """(sequence, representative) at the clusterer's default identity."""
    return curation.clusters(table(spark, sf, "entity_sequences").select("sequence"))
