"""Queries of the core problems: nested records (p1) and packed fields (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import packed, shredding
from pairloom.operators.packed import MULTI, PAIR, Field
from pairloom.operators.shredding import Child
from pairloom.session import stage

ENVELOPE = ("data", "assemblies")
ENTITY = "entry.polymer_entities"
CHILDREN = [
    Child("entity", ENTITY, "rcsb_id"),
    Child("membership", f"{ENTITY}.rcsb_polymer_entity_group_membership", "group_id", ENTITY),
    Child("organism", f"{ENTITY}.rcsb_entity_source_organism", "ncbi_taxonomy_id", ENTITY),
    Child("gen", "pdbx_struct_assembly_gen", "asym_id_list", tokens=True),
]
PACKED = [
    Field("selected_assemblies", "entity_pair", "selected_id", PAIR),
    Field("selected_assemblies", "cluster_pair_100pct", "selected_id", PAIR),
    Field("candidate", "uniprot_pair", "candidate_id", MULTI),
    Field("candidate", "species_pair", "candidate_id", MULTI),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _nodes(spark: SparkSession, sf: str, keep) -> DataFrame:
    docs = table(spark, sf, "assembly")
    return stage(shredding.shred(docs, "landing_id", "payload", envelope=ENVELOPE, keep=keep, unique=True), "nodes")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf, shredding.needed_paths(CHILDREN))
    return shredding.child_keys(nodes, CHILDREN).withColumnRenamed("doc", "landing_id")


_ROOTS = """d AS (
  SELECT landing_id, payload::json AS j FROM assembly WHERE json_valid(payload)
), r AS (
  SELECT landing_id, j FROM d WHERE json_extract(j, '$.data.assemblies') IS NULL
  UNION ALL SELECT landing_id, unnest(json_extract(j, '$.data.assemblies[*]')) FROM d WHERE json_extract(j, '$.data.assemblies') IS NOT NULL
)"""
SQL: dict[str, str] = {}
SQL["p1_found"] = f"""
WITH {_ROOTS}, e AS (
  SELECT landing_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT landing_id, json_extract(j, '$.entry.polymer_entities[*]') AS l FROM r)
), m AS (
  SELECT landing_id, pos, unnest(l) AS m, generate_subscripts(l, 1) - 1 AS k FROM (SELECT landing_id, pos, json_extract(e, '$.rcsb_polymer_entity_group_membership[*]') AS l FROM e)
), o AS (
  SELECT landing_id, pos, unnest(l) AS o, generate_subscripts(l, 1) - 1 AS k FROM (SELECT landing_id, pos, json_extract(e, '$.rcsb_entity_source_organism[*]') AS l FROM e)
), t AS (
  SELECT landing_id, pos, k, unnest(CASE json_type(o, '$.ncbi_taxonomy_id') WHEN 'ARRAY' THEN json_extract_string(o, '$.ncbi_taxonomy_id[*]') ELSE [json_extract_string(o, '$.ncbi_taxonomy_id')] END) AS x FROM o
), g AS (
  SELECT landing_id, unnest(l) AS g, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT landing_id, json_extract(j, '$.pdbx_struct_assembly_gen[*]') AS l FROM r)
), a AS (
  SELECT landing_id, pos, list_filter(list_transform(flatten(list_transform(list_filter(
           CASE json_type(g, '$.asym_id_list') WHEN 'ARRAY' THEN json_extract_string(g, '$.asym_id_list[*]') ELSE [json_extract_string(g, '$.asym_id_list')] END,
           lambda x: x IS NOT NULL), lambda x: string_split(x, ','))), lambda x: trim(x)), lambda x: x <> '') AS l
  FROM g
)
SELECT landing_id, 'entity' AS child, 0 AS parent_pos, pos::int AS child_pos, json_extract_string(e, '$.rcsb_id') AS key_text FROM e WHERE trim(json_extract_string(e, '$.rcsb_id')) <> ''
UNION ALL SELECT landing_id, 'membership', pos::int, k::int, json_extract_string(m, '$.group_id') FROM m WHERE trim(json_extract_string(m, '$.group_id')) <> ''
UNION ALL SELECT landing_id, 'organism', pos::int, k::int, x FROM t WHERE trim(x) <> ''
UNION ALL SELECT landing_id, 'gen', pos::int, (generate_subscripts(l, 1) - 1)::int, unnest(l) FROM a
"""
_WALK = f"""
WITH RECURSIVE {_ROOTS.replace("unnest(json_extract(j, '$.data.assemblies[*]'))", "unnest(CASE json_type(j, '$.data.assemblies') WHEN 'ARRAY' THEN json_extract(j, '$.data.assemblies[*]') ELSE [json_extract(j, '$.data.assemblies')] END)")}, placed AS (
  SELECT landing_id, row_number() OVER (PARTITION BY landing_id) - 1 AS k, j FROM r
), tree AS (
  SELECT landing_id, k, t.id, t.parent AS above, t.key, t.type, t.atom, row_number() OVER (PARTITION BY landing_id ORDER BY k, t.id) - 1 AS node FROM placed, json_tree(placed.j) AS t
), walk AS (
  SELECT landing_id, k, id, node, -1::bigint AS parent, -1::bigint AS owner, '' AS path, NULL::varchar AS label, k AS ordinal, type, atom FROM tree WHERE above IS NULL
  UNION ALL
  SELECT t.landing_id, t.k, t.id, t.node, w.node, CASE w.type WHEN 'OBJECT' THEN w.node ELSE w.owner END,
    CASE w.type WHEN 'ARRAY' THEN w.path ELSE CASE w.path WHEN '' THEN '' ELSE w.path || '.' END || t.key END, CASE w.type WHEN 'ARRAY' THEN w.label ELSE t.key END,
    CASE w.type WHEN 'ARRAY' THEN t.key::bigint ELSE 0 END, t.type, t.atom
  FROM tree t JOIN walk w ON w.landing_id = t.landing_id AND w.k = t.k AND w.id = t.above
), nodes AS (
  SELECT landing_id, node::int AS node, parent::int AS parent, owner::int AS owner, path, label, ordinal::int AS ordinal,
    CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
    CASE WHEN type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string(atom, '$') END AS scalar
  FROM walk
)"""
SQL["p1_nodes"] = f"{_WALK} SELECT * FROM nodes"


def _entities_sql(path: str, columns: dict[str, str]) -> str:
    """Objects with the scalars below them; fields are at most one object away."""
    fields = ", ".join(
        f"(SELECT string_agg(s.scalar, ';' ORDER BY s.node) FROM nodes s LEFT JOIN nodes x ON x.landing_id = s.landing_id AND x.node = s.owner"
        f" WHERE s.landing_id = o.landing_id AND s.scalar IS NOT NULL AND s.path = '{path}.{p}' AND {'x.owner' if '.' in p else 's.owner'} = o.node) AS {n}"
        for n, p in columns.items()
    )
    return f"{_WALK} SELECT landing_id, node, owner AS parent_node, ordinal AS pos, {fields} FROM nodes o WHERE kind = 'object' AND path = '{path}'"


SQL["p1_unreadable"] = "SELECT landing_id FROM assembly WHERE payload IS NULL OR NOT json_valid(payload)"


def p1_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The whole adjacency table."""
    docs = table(spark, sf, "assembly")
    return shredding.shred(docs, "landing_id", "payload", envelope=ENVELOPE, unique=True).withColumnRenamed("doc", "landing_id")


ENTITY_COLUMNS = {
    "rcsb_id": "rcsb_id",
    "polymer_type": "entity_poly.rcsb_entity_polymer_type",
    "asym_ids": "rcsb_polymer_entity_container_identifiers.asym_ids",
}
MEMBER_COLUMNS = {x: x for x in ("aggregation_method", "similarity_cutoff", "group_id")}
SQL["p1_entities"] = _entities_sql(ENTITY, ENTITY_COLUMNS)
SQL["p1_memberships"] = _entities_sql(CHILDREN[1].path, MEMBER_COLUMNS)


def p1_entities(spark: SparkSession, sf: str) -> DataFrame:
    keep = [ENTITY, *(f"{ENTITY}.{p}" for p in ENTITY_COLUMNS.values()), *(f"{ENTITY}.{p.rpartition('.')[0]}" for p in ENTITY_COLUMNS.values() if "." in p)]
    return shredding.entity_table(_nodes(spark, sf, keep), ENTITY, ENTITY_COLUMNS).withColumnRenamed("doc", "landing_id")


def p1_memberships(spark: SparkSession, sf: str) -> DataFrame:
    path = CHILDREN[1].path
    keep = [path, *(f"{path}.{p}" for p in MEMBER_COLUMNS.values())]
    return shredding.entity_table(_nodes(spark, sf, keep), path, MEMBER_COLUMNS).withColumnRenamed("doc", "landing_id")


def p1_unreadable(spark: SparkSession, sf: str) -> DataFrame:
    return shredding.unreadable(table(spark, sf, "assembly"), "landing_id", "payload").select(F.col("doc").alias("landing_id"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed.unpack({n: table(spark, sf, n) for n in ("candidate", "selected_assemblies")}, PACKED)


_SEPARATORS = packed.BARS + ",;/&+，；／＆＋、"
_HIDDEN = "".join(chr(0xE000 + i) for i in range(len(_SEPARATORS)))
_BLANK = r"[\s\x{A0}\x{3000}]"


def _bare_sql(x: str) -> str:
    """Without white space, brackets around and quotes around; hidden separators shown again."""
    trimmed = rf"regexp_replace({x}, '^({_BLANK}|[\[{{])+|({_BLANK}|[\]}}])+$', '', 'g')"
    return f"translate(trim(CASE WHEN regexp_matches({trimmed}, '^[\"“„«＂''].*[\"”“»＂'']$') THEN replace(substr({trimmed}, 2, length({trimmed}) - 2), '\"\"', '\"') ELSE {trimmed} END), '{_HIDDEN}', '{_SEPARATORS}')"


#: Separators within quotes are hidden before the text is split; a field that is one quotation of two values is opened.
SQL["p4_found"] = rf"""
WITH f AS (
  SELECT 'selected_assemblies' AS table_name, selected_id AS row_id, 'entity_pair' AS field_name, true AS pair, entity_pair AS t FROM selected_assemblies
  UNION ALL SELECT 'selected_assemblies', selected_id, 'cluster_pair_100pct', true, cluster_pair_100pct FROM selected_assemblies
  UNION ALL SELECT 'candidate', candidate_id, 'uniprot_pair', false, uniprot_pair FROM candidate
  UNION ALL SELECT 'candidate', candidate_id, 'species_pair', false, species_pair FROM candidate
), o AS (
  SELECT * REPLACE (CASE WHEN pair AND regexp_matches(trim(t), '^"[^"]+"$') THEN substr(trim(t), 2, length(trim(t)) - 2) ELSE t END AS t) FROM f WHERE t IS NOT NULL
), h AS (
  SELECT *, array_to_string(list_transform(regexp_extract_all(t, '"(?:[^"]|"")*"|“[^”]*”|«[^»]*»|[^"“«]+|["“«]'), lambda q: CASE WHEN length(q) > 1 AND regexp_matches(q, '^["“«]') THEN translate(q, '{_SEPARATORS}', '{_HIDDEN}') ELSE q END), '') AS x FROM o
), s AS (
  SELECT *, CASE WHEN pair THEN regexp_split_to_array(x, '[{_SEPARATORS}\t]') ELSE regexp_split_to_array(x, '[{packed.BARS}]') END AS parts FROM h
), w AS (
  SELECT *, CASE WHEN pair AND len(parts) = 1 AND len(regexp_split_to_array(trim(x), '{_BLANK}+')) = 2 THEN regexp_split_to_array(trim(x), '{_BLANK}+') ELSE parts END AS own FROM s
), e AS (
  SELECT table_name, row_id, field_name, pair, unnest(own) AS side, generate_subscripts(own, 1) AS k, len(own) AS n FROM w
), v AS (
  SELECT table_name, row_id, field_name, k, CASE WHEN pair THEN [side] ELSE regexp_split_to_array(side, '[,;/&+，；／＆＋、\t\n]') END AS l FROM e
), p AS (
  SELECT table_name, row_id, field_name, k, list_filter(list_transform(l, lambda z: {_bare_sql('z')}), lambda z: regexp_matches(z, '[\p{{L}}\p{{N}}]')) AS l FROM v
)
SELECT table_name, row_id, field_name, least(k, 2)::int AS side_no, generate_subscripts(l, 1)::int AS value_no, unnest(l) AS part_value FROM p
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_nodes, p1_entities, p1_memberships, p1_unreadable, p4_found)}
