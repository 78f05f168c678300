"""The derivation of candidates as SQL over the landed documents, stated apart from ``operators.candidates``."""

from __future__ import annotations

#: What ``functions.text.strip`` removes (fixed value).
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def items(x: str, path: str) -> str:
    """A list's elements, a lone value as one, nothing as none."""
    return f"CASE coalesce(json_type({x}, '{path}'), 'NULL') WHEN 'NULL' THEN [] WHEN 'ARRAY' THEN json_extract({x}, '{path}[*]') ELSE [json_extract({x}, '{path}')] END"


def truthy(x: str) -> str:
    """Of a JSON value: a non-empty text, a number but 0, or true, as text."""
    text = f"json_extract_string({x}, '$')"
    return f"""(CASE json_type({x}) WHEN 'VARCHAR' THEN nullif({text}, '') WHEN 'BOOLEAN' THEN CASE {text} WHEN 'true' THEN 'True' END
      WHEN 'UBIGINT' THEN CASE WHEN {text}::double <> 0 THEN {text} END WHEN 'BIGINT' THEN CASE WHEN {text}::double <> 0 THEN {text} END
      WHEN 'DOUBLE' THEN CASE WHEN {text}::double <> 0 THEN {text} END END)"""


def texts(x: str, path: str) -> str:
    return f"list_filter(list_transform({items(x, path)}, lambda v: {truthy('v')}), lambda v: v IS NOT NULL)"


def joined(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({x})), ';')"


def ids(x: str, path: str) -> str:
    """Comma texts in lists of any kind as one list."""
    parts = "list_filter(list_transform(string_split(json_extract_string(q, '$'), ','), lambda w: regexp_replace(w, '^" + SPACE + "+|" + SPACE + "+$', '', 'g')), lambda w: w <> '')"
    return f"flatten(list_transform({items(x, path)}, lambda p: flatten(list_transform({items('p', '$')}, lambda q: coalesce({parts}, [])))))"


NUMBERS = "('UBIGINT', 'BIGINT', 'DOUBLE')"


def two(label: str) -> str:
    path = f"$.rcsb_assembly_info.{label}"
    return f"(json_type(j, '{path}') IN {NUMBERS} AND json_extract_string(j, '{path}')::double = 2)"


_CONTAINER = "$.rcsb_polymer_entity_container_identifiers"
_RESOLUTION, _METHOD = "$.entry.rcsb_entry_info.resolution_combined", "$.entry.rcsb_entry_info.experimental_method"

DERIVED = f"""
landed AS (
  SELECT landing_id, fetched_at, assembly_id AS key, payload, CASE WHEN payload IS NOT NULL AND json_valid(payload) THEN payload::json END AS p FROM SOURCE
), roots AS (
  SELECT landing_id, fetched_at, key, p AS j, p IS NOT NULL AND regexp_matches(payload, '^\\s*\\{{') AS good FROM landed WHERE coalesce(json_type(p, '$.data.assemblies'), 'NULL') = 'NULL'
  UNION ALL
  SELECT landing_id, fetched_at, key, p, false FROM landed WHERE json_type(p, '$.data.assemblies') = 'ARRAY' AND json_array_length(p, '$.data.assemblies') = 0
  UNION ALL
  SELECT landing_id, fetched_at, key, j, json_type(j) = 'OBJECT' FROM (
    SELECT landing_id, fetched_at, key, unnest({items('p', '$.data.assemblies')}) AS j FROM landed WHERE coalesce(json_type(p, '$.data.assemblies'), 'NULL') <> 'NULL')
), docs AS (
  SELECT row_number() OVER () AS d, *, coalesce(upper({truthy("json_extract(j, '$.rcsb_id')")}), '') AS assembly_id, {two('polymer_entity_instance_count')} AND {two('polymer_entity_instance_count_protein')} AS valid FROM roots
), entities AS (
  SELECT d, unnest(l) AS e, generate_subscripts(l, 1) AS pos FROM (SELECT d, {items('j', '$.entry.polymer_entities')} AS l FROM docs WHERE good)
), claims AS (
  SELECT d, pos, {truthy("json_extract(e, '$.rcsb_id')")} AS id, {ids('e', _CONTAINER + '.asym_ids')} AS chains,
    coalesce(list_filter(list_transform({items('e', '$.rcsb_polymer_entity_group_membership')}, lambda m: CASE WHEN json_extract_string(m, '$.aggregation_method') = 'sequence_identity'
      AND trunc(try_cast(json_extract_string(m, '$.similarity_cutoff') AS double)) = 100
      AND (json_type(m, '$.similarity_cutoff') <> 'VARCHAR' OR regexp_matches(json_extract_string(m, '$.similarity_cutoff'), '^\\s*[+-]?\\d+\\s*$')) THEN {truthy("json_extract(m, '$.group_id')")} END), lambda m: m IS NOT NULL)[1],
      'singleton:' || {truthy("json_extract(e, '$.rcsb_id')")}) AS cluster,
    flatten(list_transform({items('e', '$.uniprots')}, lambda u: CASE
      WHEN len({texts('u', '$.rcsb_uniprot_container_identifiers.uniprot_id')}) > 0 OR json_array_length(u, '$.rcsb_uniprot_container_identifiers.uniprot_id') > 0
      THEN {texts('u', '$.rcsb_uniprot_container_identifiers.uniprot_id')} ELSE {texts('u', '$.rcsb_id')} END)) AS main,
    flatten(list_transform(list_filter({items('e', _CONTAINER + '.reference_sequence_identifiers')}, lambda f: lower(json_extract_string(f, '$.database_name')) = 'uniprot'),
      lambda f: {texts('f', '$.database_accession')})) AS other,
    {joined(f"flatten(list_transform({items('e', '$.rcsb_entity_source_organism')}, lambda o: {texts('o', '$.ncbi_scientific_name')}))")} AS species,
    {joined(f"flatten(list_transform({items('e', '$.rcsb_entity_source_organism')}, lambda o: {texts('o', '$.ncbi_taxonomy_id')}))")} AS taxonomy
  FROM entities WHERE contains(json_extract_string(e, '$.entity_poly.rcsb_entity_polymer_type'), 'Protein')
), chains AS (
  SELECT d, unnest(l) AS chain, generate_subscripts(l, 1) AS at FROM (
    SELECT d, flatten(list_transform({items('j', '$.pdbx_struct_assembly_gen')}, lambda g: {ids('g', '$.asym_id_list')})) AS l FROM docs WHERE good)
), owned AS (
  SELECT c.d, c.at, arg_max(k.pos, k.pos) AS pos FROM chains c JOIN claims k ON k.d = c.d AND list_contains(k.chains, c.chain) GROUP BY ALL
), parts AS (
  SELECT o.d, k.id, arg_max(k.pos, o.at) AS pos FROM owned o JOIN claims k USING (d, pos) WHERE k.id IS NOT NULL GROUP BY ALL
), pairs AS (
  SELECT d, count(*) AS n, list(row(id, cluster, array_to_string(list_sort(list_distinct(CASE WHEN len(main) > 0 THEN main ELSE other END)), ';'), species, taxonomy) ORDER BY id) AS e
  FROM parts JOIN claims USING (d, id, pos) GROUP BY d
), read AS (
  SELECT d, landing_id, fetched_at, key, j, good, assembly_id, valid, coalesce(n, 0) AS n, e[1] AS a, e[least(2, n)] AS b FROM docs LEFT JOIN pairs USING (d)
), judged AS (
  SELECT *, CASE WHEN NOT coalesce(good, false) THEN 'unreadable' WHEN NOT contains(assembly_id, '-') THEN 'no_id' WHEN NOT coalesce(valid, false) THEN 'instance_count'
    WHEN n NOT IN (1, 2) THEN 'entity_count' WHEN a[2] IS NULL OR b[2] IS NULL THEN 'missing_cluster' END AS reject FROM read
), valued AS (
  SELECT *, regexp_extract(assembly_id, '^(.*)-([^-]*)$', 1) AS pdb_id, regexp_extract(assembly_id, '^(.*)-([^-]*)$', 2) AS assembly_number,
    CASE WHEN json_type(j, '{_RESOLUTION}') = 'ARRAY' THEN list_min(list_filter(list_transform(json_extract(j, '{_RESOLUTION}[*]'), lambda x: try_cast(json_extract_string(x, '$') AS double)), lambda x: NOT isnan(x)))
         WHEN json_type(j, '{_RESOLUTION}') IN {NUMBERS} THEN nullif(json_extract_string(j, '{_RESOLUTION}')::double, 0) END AS best,
    CASE json_type(j, '{_METHOD}') WHEN 'VARCHAR' THEN json_extract_string(j, '{_METHOD}') WHEN 'ARRAY' THEN array_to_string(list_filter(json_extract_string(j, '{_METHOD}[*]'), lambda x: x IS NOT NULL), ';') END AS method
  FROM judged WHERE reject IS NULL
), candidates AS (
  SELECT landing_id, fetched_at, key, assembly_id, pdb_id, assembly_number, a[1] || ',' || b[1] AS entity_pair, a[3] || '|' || b[3] AS uniprot_pair, a[3] AS uniprot_1, b[3] AS uniprot_2,
    a[4] || '|' || b[4] AS species_pair, a[4] AS species_1, b[4] AS species_2, a[5] || '|' || b[5] AS taxonomy_pair, a[5] AS taxonomy_1, b[5] AS taxonomy_2,
    CASE n WHEN 1 THEN 'homo' ELSE 'hetero' END AS dimer_type, array_to_string(list_sort([a[2], b[2]]), ',') AS cluster_pair_100pct, best AS resolution_best_angstrom,
    coalesce(trunc(try_cast(json_extract_string(j, '$.rcsb_assembly_info.modeled_polymer_monomer_count') AS double))::int, 0) AS modeled_polymer_monomer_count, coalesce(method, '') AS experimental_method,
    coalesce({truthy("json_extract(j, '$.pdbx_struct_assembly.oligomeric_count')")}, '') AS oligomeric_count, '/' || lower(pdb_id) || '-assembly' || assembly_number || '.cif.gz' AS download_url,
    lower(pdb_id) || '-assembly' || assembly_number || '.cif.gz' AS local_filename, a[2] || ',' || b[2] AS entity_clusters
  FROM valued
)"""
