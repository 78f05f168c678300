"""Assembly documents to flat candidate rows, one narrow projection without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import after_last, before_last
from pairloom.functions.variants import ids, is_number, items, joined, truthy_text, truthy_texts
from pairloom.schemas import BASE_COLUMNS, CANDIDATE_COLUMNS
from pairloom.session import spread

INFINITY = float("inf")
#: The response envelope that may be left around a document, or around a list of them.
ENVELOPE = "$.data.assemblies"


def resolution(doc: Column) -> Column:
    """The best resolution; infinity where there is none. A scalar 0, NaN and a lone text count as none."""
    path = "$.entry.rcsb_entry_info.resolution_combined"
    value = F.try_variant_get(doc, path, "variant")
    listed = F.array_min(F.filter(F.transform(F.try_variant_get(doc, path, "array<variant>"), lambda x: F.try_variant_get(x, "$", "double")), lambda x: ~F.isnan(x)))
    number = F.when(is_number(value), F.nullif(F.try_variant_get(doc, path, "double"), F.lit(0.0)))
    best = F.coalesce(listed, number)
    return F.when(best.isNull() | F.isnan(best), F.lit(INFINITY)).otherwise(best)


def method(doc: Column) -> Column:
    """A text as it is; a list joined by semicolons, nulls left out, order and repeats kept; else empty."""
    path = "$.entry.rcsb_entry_info.experimental_method"
    value = F.try_variant_get(doc, path, "variant")
    listed = F.try_variant_get(doc, path, "array<variant>")
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(doc, path, "string"))
    return F.coalesce(F.array_join(F.transform(listed, lambda x: F.try_variant_get(x, "$", "string")), ";"), text, F.lit(""))


def cluster(entity: Column) -> Column:
    """The first sequence-identity group at a cutoff of 100, or ``singleton:`` and the entity's id; null without either."""
    groups = F.filter(
        items(entity, "$.rcsb_polymer_entity_group_membership"),
        lambda m: (F.try_variant_get(m, "$.aggregation_method", "string") == "sequence_identity")
        & (F.try_variant_get(m, "$.similarity_cutoff", "int") == 100)
        & truthy_text(m, "$.group_id").isNotNull(),
    )
    return F.coalesce(truthy_text(F.get(groups, F.lit(0)), "$.group_id"), F.concat(F.lit("singleton:"), truthy_text(entity, "$.rcsb_id")))


def accessions(entity: Column) -> Column:
    """Accessions of the entity, by reference identifiers only where it has no others."""
    def of(x: Column) -> Column:
        nested = truthy_texts(x, "$.rcsb_uniprot_container_identifiers.uniprot_id")
        listed = F.try_variant_get(x, "$.rcsb_uniprot_container_identifiers.uniprot_id", "array<variant>")
        own = F.when((F.size(nested) > 0) | (F.size(listed) > 0), nested)  # a list of blanks still hides the object's own id
        return F.coalesce(own, truthy_texts(x, "$.rcsb_id"))

    main = F.flatten(F.transform(items(entity, "$.uniprots"), of))  # an element that is no object has none of the fields
    refs = F.filter(
        items(entity, "$.rcsb_polymer_entity_container_identifiers.reference_sequence_identifiers"),
        lambda r: F.lower(F.try_variant_get(r, "$.database_name", "string")) == "uniprot",
    )
    other = F.flatten(F.transform(refs, lambda r: truthy_texts(r, "$.database_accession")))
    return joined(F.when(F.size(main) > 0, main).otherwise(other))


def organisms(entity: Column, label: str) -> Column:
    return joined(F.flatten(F.transform(items(entity, "$.rcsb_entity_source_organism"), lambda o: truthy_texts(o, f"$.{label}"))))


def _last(x: Column) -> Column:
    return F.try_element_at(x, F.lit(-1))


def participants(doc: Column) -> Column:
    """The distinct protein entities whose chains the generators name, in order of their ids.

    A chain that several entities claim belongs to the last of them; chains nobody claims and
    entities without id are left out.
    """
    proteins = F.filter(
        items(doc, "$.entry.polymer_entities"),
        lambda e: F.coalesce(F.try_variant_get(e, "$.entity_poly.rcsb_entity_polymer_type", "string").contains("Protein"), F.lit(False)),
    )
    claims = F.transform(
        proteins,
        lambda e: F.struct(
            truthy_text(e, "$.rcsb_id").alias("id"),
            ids(e, "$.rcsb_polymer_entity_container_identifiers.asym_ids").alias("chains"),
            cluster(e).alias("cluster"),
            accessions(e).alias("uniprot"),
            organisms(e, "ncbi_scientific_name").alias("species"),
            organisms(e, "ncbi_taxonomy_id").alias("taxonomy"),
        ),
    )
    return claims


def _took_part(claims: Column, chains: Column) -> Column:
    owners = F.transform(chains, lambda c: _last(F.filter(claims, lambda p: F.array_contains(p["chains"], c))))
    owners = F.filter(owners, lambda p: p["id"].isNotNull())
    names = F.array_sort(F.array_distinct(F.transform(owners, lambda p: p["id"])))
    return F.transform(names, lambda n: _last(F.filter(owners, lambda p: p["id"] == n)))


def _documents(payload: Column) -> Column:
    """The documents of a payload, by the rule of ``shredding.roots``: itself, or what lies in the envelope left around it."""
    inner = F.try_variant_get(payload, ENVELOPE, "variant")
    return F.when(inner.isNull(), F.array(payload)).otherwise(F.coalesce(F.try_variant_get(payload, ENVELOPE, "array<variant>"), F.array(inner)))


def derive(docs: DataFrame, payload: str = "payload", *, files_base: str = "") -> DataFrame:
    """The 21 candidate columns, ``entity_clusters`` (clusters in the order of ``entity_pair``),
    ``rank_resolution`` (infinity for none) and ``reject``: why the document gives no candidate, or null.

    Reasons: unreadable, no_id, instance_count, entity_count, missing_cluster. The texts may be
    null; other columns of ``docs`` are kept under their names unless they clash, in which case
    the candidate's column stands. Null elements of lists are skipped.

    There is a row for each document of a payload: an envelope gives as many as it holds. What is
    no object in it is unreadable; an empty envelope gives one row, unreadable too, so that every payload is counted.
    """
    others = [c for c in docs.columns if c != payload and c not in {*CANDIDATE_COLUMNS, "entity_clusters", "rank_resolution", "reject"}]
    doc = F.col("_doc")
    text = F.col(payload).cast("string")
    read = (docs if docs.isStreaming else spread(docs)).select(*others, F.try_parse_json(text).alias("_payload"), text.alias("_text"))
    opened = F.try_variant_get("_payload", ENVELOPE, "variant").isNotNull()
    read = read.select(*others, opened.alias("_opened"), (F.col("_payload").isNotNull() & F.col("_text").rlike(r"^\s*\{")).alias("_plain"), F.explode_outer(_documents(F.col("_payload"))).alias("_doc"))
    read = read.withColumn("_object", F.when(F.col("_opened"), F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))).otherwise(F.col("_plain")))
    read = read.withColumn("assembly_id", F.coalesce(F.upper(truthy_text(doc, "$.rcsb_id")), F.lit("")))
    def two(label: str) -> Column:
        path = f"$.rcsb_assembly_info.{label}"
        return F.coalesce(is_number(F.try_variant_get(doc, path, "variant")) & (F.try_variant_get(doc, path, "double") == 2), F.lit(False))

    read = read.withColumn("_valid", two("polymer_entity_instance_count") & two("polymer_entity_instance_count_protein"))
    read = read.withColumn("_claims", participants(doc)).withColumn("_chains", F.flatten(F.transform(items(doc, "$.pdbx_struct_assembly_gen"), lambda g: ids(g, "$.asym_id_list"))))
    read = read.withColumn("_e", _took_part(F.col("_claims"), F.col("_chains")))
    e = F.col("_e")
    first, second = F.get(e, F.lit(0)), F.get(e, F.least(F.lit(1), F.size(e) - 1))
    reject = (
        F.when(~F.col("_object"), "unreadable")
        .when(~F.col("assembly_id").contains("-"), "no_id")
        .when(~F.col("_valid"), "instance_count")
        .when(~F.size(e).isin(1, 2), "entity_count")
        .when(first["cluster"].isNull() | second["cluster"].isNull(), "missing_cluster")
    )
    pdb, number = before_last(F.col("assembly_id"), "-"), after_last(F.col("assembly_id"), "-")
    def pair(label: str, sep: str) -> Column:
        return F.concat_ws(sep, first[label], second[label])

    best = resolution(doc)
    name = F.concat(F.lower(F.col("pdb_id")), F.lit("-assembly"), F.col("assembly_number"), F.lit(".cif.gz"))
    out = read.select(
        *others,
        "assembly_id",
        F.upper(pdb).alias("pdb_id"),
        number.alias("assembly_number"),
        pair("id", ",").alias("entity_pair"),
        *[x for f in ("uniprot", "species", "taxonomy") for x in (pair(f, "|").alias(f"{f}_pair"), first[f].alias(f"{f}_1"), second[f].alias(f"{f}_2"))],
        F.when(F.size(e) == 1, "homo").when(F.size(e) == 2, "hetero").alias("dimer_type"),
        F.array_join(F.array_sort(F.array(first["cluster"], second["cluster"])), ",").alias("cluster_pair_100pct"),
        F.when(best != INFINITY, best).alias("resolution_best_angstrom"),
        F.coalesce(F.try_variant_get(doc, "$.rcsb_assembly_info.modeled_polymer_monomer_count", "int"), F.lit(0)).alias("modeled_polymer_monomer_count"),
        method(doc).alias("experimental_method"),
        F.coalesce(truthy_text(doc, "$.pdbx_struct_assembly.oligomeric_count"), F.lit("")).alias("oligomeric_count"),
        F.concat_ws(",", first["cluster"], second["cluster"]).alias("entity_clusters"),
        best.alias("rank_resolution"),
        reject.alias("reject"),
    )
    return out.withColumn("local_filename", name).withColumn("download_url", F.concat(F.lit(files_base.rstrip("/") + "/"), F.col("local_filename"))).select(
        *others, *CANDIDATE_COLUMNS, "entity_clusters", "rank_resolution", "reject"
    )


def candidates(derived: DataFrame) -> DataFrame:
    return derived.where("reject is null").drop("reject")


def rejects(derived: DataFrame) -> DataFrame:
    return derived.where("reject is not null").select("assembly_id", "reject")


def base_columns(table: DataFrame) -> DataFrame:
    return table.select(*BASE_COLUMNS)
