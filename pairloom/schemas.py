"""Explicit schemas of everything that is read or written as text."""

from __future__ import annotations

from pyspark.sql import types as T

#: The candidate table's columns in the order they are written.
CANDIDATE_COLUMNS = [
    "assembly_id", "pdb_id", "assembly_number", "entity_pair", "uniprot_pair", "uniprot_1", "uniprot_2", "species_pair", "species_1", "species_2",
    "taxonomy_pair", "taxonomy_1", "taxonomy_2", "dimer_type", "cluster_pair_100pct", "resolution_best_angstrom", "modeled_polymer_monomer_count",
    "experimental_method", "oligomeric_count", "download_url", "local_filename",
]
_TYPES = {"resolution_best_angstrom": T.DoubleType(), "modeled_polymer_monomer_count": T.IntegerType()}
CANDIDATES = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in CANDIDATE_COLUMNS])

#: The narrower table has no accession, species and taxonomy columns.
BASE_COLUMNS = [c for c in CANDIDATE_COLUMNS if not c.startswith(("uniprot", "species", "taxonomy"))]
BASE_CANDIDATES = T.StructType([CANDIDATES[c] for c in BASE_COLUMNS])

SEQUENCES = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_name", "cluster_id", "sequence", "binary_mask")])

_ID = [T.StructField("file", T.StringType())]
#: Child tables of a structure file; ``ord`` keeps the order of the file.
STRUCTURE_ROWS = T.StructType(
    [
        *_ID,
        T.StructField("category", T.StringType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("a", T.StringType()),
        T.StructField("b", T.StringType()),
    ]
)


def selection(fields: dict | list, indent: int = 2) -> str:
    """A nested field list as a query's selection text; a dict's values are the fields below, None ends."""
    lines = []
    for name, below in fields.items():
        if below:
            lines += [" " * indent + name + " {", selection(below, indent + 2), " " * indent + "}"]
        else:
            lines.append(" " * indent + name)
    return "\n".join(lines)


def _leaves(*names: str) -> dict:
    return dict.fromkeys(names)


#: The fields of an assembly document that candidates are derived from, and no others.
ASSEMBLY_FIELDS = {
    "rcsb_id": None,
    "rcsb_assembly_info": _leaves("modeled_polymer_monomer_count", "polymer_entity_instance_count", "polymer_entity_instance_count_protein"),
    "pdbx_struct_assembly": _leaves("oligomeric_count"),
    "pdbx_struct_assembly_gen": _leaves("asym_id_list"),
    "entry": {
        "rcsb_entry_info": _leaves("experimental_method", "resolution_combined"),
        "polymer_entities": {
            "rcsb_id": None,
            "entity_poly": _leaves("rcsb_entity_polymer_type"),
            "rcsb_entity_source_organism": _leaves("ncbi_taxonomy_id", "ncbi_scientific_name"),
            "rcsb_polymer_entity_container_identifiers": {"asym_ids": None, "reference_sequence_identifiers": _leaves("database_name", "database_accession")},
            "uniprots": {"rcsb_id": None, "rcsb_uniprot_container_identifiers": _leaves("uniprot_id")},
            "rcsb_polymer_entity_group_membership": _leaves("aggregation_method", "similarity_cutoff", "group_id"),
        },
    },
}
