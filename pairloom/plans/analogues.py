"""The engine's operators on the supplied star-schema tables, each with the SQL that states the same.

An order with exactly two lines plays the assembly, a line its chain, a supplier the entity, the
supplier's nation the cluster, the order's price the resolution and the summed quantity the
modelled count.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.residues import mask
from pairloom.functions.text import after_last, before_last, split_ids
from pairloom.functions.variants import truthy_text
from pairloom.operators import candidates as cand
from pairloom.operators import profile
from pairloom.operators.clustering import greedy
from pairloom.operators.extraction import first_entities, overflow
from pairloom.operators.fasta import fasta_records, group_sequences, several_clusters, write_fasta
from pairloom.operators.ordinals import with_ordinal
from pairloom.operators.representatives import select_representatives
from pairloom.plans import curation
from pairloom.session import shared_dir, stage
from pairloom.sources import archive
from pairloom.sources.mmcif import parse_structures
from pairloom.sources.tsv import read_tsv, write_tsv

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_CONDITIONS = [("l_returnflag", "exact_match", "R"), ("l_linestatus", "exact_match", "F"), ("l_quantity", "less", 25)]


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem
WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity < 25
""")
def q01_conjunction(spark, sf):
    """A search of three conditions, evaluated on rows."""
    rows = table(spark, sf, "lineitem").where(archive.as_column(archive.conjunction([archive.condition(*c) for c in _CONDITIONS])))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@query("""
SELECT false AS strict, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity < 25
UNION ALL
SELECT true, count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity < 25 AND l_discount = 0
""")
def q02_optional_condition(spark, sf):
    """The same with and without one more condition."""
    rows = table(spark, sf, "lineitem")
    leaves = [archive.condition(*c) for c in _CONDITIONS]
    more = archive.condition("l_discount", "equals", 0)
    parts = [(x, rows.where(archive.as_column(archive.conjunction(leaves + [more] * x)))) for x in (False, True)]
    counts = [part.agg(F.count("*").alias("n")).select(F.lit(x).alias("strict"), "n") for x, part in parts]
    return counts[0].unionByName(counts[1])


@query("SELECT DISTINCT upper(c_mktsegment) AS assembly_id FROM customer WHERE c_mktsegment <> '' ORDER BY 1")
def q03_distinct_ids(spark, sf):
    return archive.distinct_ids(table(spark, sf, "customer"), "c_mktsegment")


@query("""
SELECT ((k - 1) // 8 + 1)::bigint AS batch_no, id AS assembly_id FROM (
  SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT DISTINCT upper(c_name) AS id FROM customer)
) WHERE k <= 100
""")
def q04_ordered_limit(spark, sf):
    """The first hundred ids in batches of eight."""
    first = archive.limit_ids(archive.distinct_ids(table(spark, sf, "customer"), "c_name"), 100)
    return archive.batches(first, 8).select("batch_no", F.explode("ids").alias("assembly_id"))


@query("""
SELECT o_orderkey, upper(regexp_extract(o_orderpriority, '^(.*)-([^-]*)$', 1)) AS head, regexp_extract(o_orderpriority, '^(.*)-([^-]*)$', 2) AS tail
FROM orders WHERE contains(o_orderpriority, '-')
""")
def q05_last_dash(spark, sf):
    c = F.col("o_orderpriority")
    return table(spark, sf, "orders").where(c.contains("-")).select("o_orderkey", F.upper(before_last(c, "-")).alias("head"), after_last(c, "-").alias("tail"))


@query(r"""
SELECT doc_id, count(*) AS parts FROM (
  SELECT doc_id, unnest(string_split(text, ',')) AS p FROM documents
) WHERE regexp_replace(p, '^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$', '', 'g') <> ''
GROUP BY doc_id
""")
def q06_split_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(split_ids(F.col("text"))).alias("p")).groupBy("doc_id").agg(F.count("*").alias("parts"))


@query("SELECT vec_id, coalesce(list_min(list_filter(embedding, lambda x: NOT isnan(x)))::double, 'infinity'::double) AS least FROM embeddings")
def q07_least_or_infinity(spark, sf):
    """A vector as a document's list of resolutions."""
    rows = table(spark, sf, "embeddings").withColumn("resolution_combined", F.col("embedding").cast("array<double>"))
    doc = F.to_json(F.struct(F.struct(F.struct("resolution_combined").alias("rcsb_entry_info")).alias("entry")))
    return rows.select("vec_id", cand.resolution(F.parse_json(doc)).alias("least"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """(l_orderkey, lines): an order's lines in order, each with its supplier's nation."""
    nations = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey", "n_name")
    rows = table(spark, sf, "lineitem").join(nations, "l_suppkey")
    fields = ["l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("l_quantity"), "l_returnflag", "s_nationkey", "n_name"]
    return rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("lines"))  # an order's own lines


_LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey"


@query(f"SELECT l_orderkey, string_agg(l_returnflag, ';' ORDER BY i) AS flags FROM ({_LINES}) GROUP BY l_orderkey")
def q08_ordered_join(spark, sf):
    """An order's flags as a document's list of methods."""
    doc = F.to_json(F.struct(F.struct(F.struct(F.col("lines.l_returnflag").alias("experimental_method")).alias("rcsb_entry_info")).alias("entry")))
    return _lines(spark, sf).select("l_orderkey", cand.method(F.parse_json(doc)).alias("flags"))


@query(f"""
SELECT l_orderkey, coalesce('P' || arg_min(l_partkey, i) FILTER (WHERE l_returnflag = 'R' AND l_quantity >= 25), 'singleton:O' || l_orderkey) AS cluster FROM ({_LINES}) GROUP BY l_orderkey
""")
def q09_first_match_or_singleton(spark, sf):
    """An order's lines as the group memberships of an entity."""
    member = F.transform(
        "lines",
        lambda x: F.struct(
            F.when(x["l_returnflag"] == "R", "sequence_identity").otherwise("other").alias("aggregation_method"),
            F.when(x["l_quantity"] >= 25, F.lit(100)).otherwise(F.lit(90)).alias("similarity_cutoff"),
            F.concat(F.lit("P"), x["l_partkey"]).alias("group_id"),
        ),
    )
    entity = F.to_json(F.struct(F.concat(F.lit("O"), "l_orderkey").alias("rcsb_id"), member.alias("rcsb_polymer_entity_group_membership")))
    return _lines(spark, sf).select("l_orderkey", cand.cluster(F.parse_json(entity)).alias("cluster"))


@query(f"""
SELECT l_orderkey, coalesce(string_agg(DISTINCT l_suppkey::varchar, ';' ORDER BY l_suppkey::varchar) FILTER (WHERE l_returnflag = 'R'),
  string_agg(DISTINCT l_suppkey::varchar, ';' ORDER BY l_suppkey::varchar) FILTER (WHERE l_returnflag = 'A'), '') AS accessions,
  string_agg(DISTINCT n_name, ';' ORDER BY n_name) AS species, coalesce(string_agg(DISTINCT s_nationkey::varchar, ';' ORDER BY s_nationkey::varchar) FILTER (WHERE s_nationkey <> 0), '') AS taxonomy
FROM ({_LINES}) GROUP BY l_orderkey
""")
def q10_set_with_fallback(spark, sf):
    """An order's suppliers as the accessions of an entity, its nations as organisms."""
    def part(flag: str, build):
        return F.transform(F.filter("lines", lambda x: x["l_returnflag"] == flag), lambda x: build(x["l_suppkey"].cast("string")))

    entity = F.struct(
        part("R", lambda v: F.struct(F.struct(v.alias("uniprot_id")).alias("rcsb_uniprot_container_identifiers"))).alias("uniprots"),
        F.struct(part("A", lambda v: F.struct(F.lit("UniProt").alias("database_name"), v.alias("database_accession"))).alias("reference_sequence_identifiers")).alias("rcsb_polymer_entity_container_identifiers"),
        F.transform("lines", lambda x: F.struct(x["n_name"].alias("ncbi_scientific_name"), x["s_nationkey"].alias("ncbi_taxonomy_id"))).alias("rcsb_entity_source_organism"),
    )
    read = _lines(spark, sf).select("l_orderkey", F.parse_json(F.to_json(entity)).alias("e"))
    e = F.col("e")
    return read.select("l_orderkey", cand.accessions(e).alias("accessions"), cand.organisms(e, "ncbi_scientific_name").alias("species"), cand.organisms(e, "ncbi_taxonomy_id").alias("taxonomy"))


_DIMERS = """
SELECT l_orderkey, min(l_suppkey) AS entity_1, max(l_suppkey) AS entity_2, CASE WHEN min(l_suppkey) = max(l_suppkey) THEN 'homo' ELSE 'hetero' END AS dimer_type,
       sum(l_quantity) AS modeled
FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2
"""


def _dimers(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.min("l_suppkey").alias("entity_1"), F.max("l_suppkey").alias("entity_2"), F.sum("l_quantity").alias("modeled")
    )
    kind = F.when(F.col("entity_1") == F.col("entity_2"), "homo").otherwise("hetero")
    return per.where("n = 2").select("l_orderkey", "entity_1", "entity_2", kind.alias("dimer_type"), "modeled")


def _name(suppkey) -> F.Column:
    """The entity that a supplier plays: its number is one of three."""
    return F.concat(F.lit("S"), suppkey, F.lit("_"), suppkey % 3 + 1)


def _derived(spark: SparkSession, sf: str, pairs: bool = False) -> DataFrame:
    """Every order as an assembly document, derived: lines are chains, suppliers entities (every tenth no protein).

    With ``pairs`` only orders of two lines become documents, as the archive's search would ask."""
    def entity(x, i):
        own = x["s_nationkey"] % 5 != 0
        member = F.struct(F.lit("sequence_identity").alias("aggregation_method"), F.lit(100).alias("similarity_cutoff"), F.concat(F.lit("N"), x["s_nationkey"]).alias("group_id"))
        return F.struct(
            _name(x["l_suppkey"]).alias("rcsb_id"),
            F.struct(F.when(x["l_suppkey"] % 10 == 3, "RNA").otherwise("Protein (only)").alias("rcsb_entity_polymer_type")).alias("entity_poly"),
            F.struct(F.array(F.concat(F.lit("C"), i)).alias("asym_ids")).alias("rcsb_polymer_entity_container_identifiers"),
            F.array(F.struct(F.concat(x["l_returnflag"], x["l_partkey"]).alias("rcsb_id"))).alias("uniprots"),
            F.array(F.struct(x["n_name"].alias("ncbi_scientific_name"), x["s_nationkey"].alias("ncbi_taxonomy_id"))).alias("rcsb_entity_source_organism"),
            F.when(own, F.array(member)).alias("rcsb_polymer_entity_group_membership"),
        )

    prices = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    n = F.size("lines")
    doc = F.struct(
        F.concat(F.lit("o"), "l_orderkey", F.lit("-1")).alias("rcsb_id"),
        F.struct(
            F.aggregate("lines", F.lit(0), lambda a, x: a + x["l_quantity"]).alias("modeled_polymer_monomer_count"), n.alias("polymer_entity_instance_count"), n.alias("polymer_entity_instance_count_protein")
        ).alias("rcsb_assembly_info"),
        F.struct(n.cast("string").alias("oligomeric_count")).alias("pdbx_struct_assembly"),
        F.array(F.struct(F.array_join(F.transform("lines", lambda x, i: F.concat(F.lit("C"), i)), ", ").alias("asym_id_list"))).alias("pdbx_struct_assembly_gen"),
        F.struct(
            F.struct(F.array("o_totalprice").alias("resolution_combined"), F.col("lines.l_returnflag").alias("experimental_method")).alias("rcsb_entry_info"), F.transform("lines", entity).alias("polymer_entities")
        ).alias("entry"),
    )
    lines = _lines(spark, sf)
    return stage(cand.derive((lines.where(n == 2) if pairs else lines).join(prices, "l_orderkey").select(F.to_json(doc).alias("payload")), files_base="f"), "derived")


_DERIVED = f"""
lines AS ({_LINES}), orders_of AS (
  SELECT l_orderkey, count(*) AS n, sum(l_quantity::int)::int AS modeled, string_agg(l_returnflag, ';' ORDER BY i) AS flags, any_value(o_totalprice) AS price FROM lines JOIN orders ON o_orderkey = l_orderkey GROUP BY 1
), entities AS (
  SELECT l_orderkey, 'S' || l_suppkey || '_' || (l_suppkey % 3 + 1) AS id, CASE s_nationkey % 5 WHEN 0 THEN 'singleton:S' || l_suppkey || '_' || (l_suppkey % 3 + 1) ELSE 'N' || s_nationkey END AS cluster,
    l_returnflag || l_partkey AS uniprot, n_name AS species, CASE s_nationkey WHEN 0 THEN '' ELSE s_nationkey::varchar END AS taxonomy
  FROM lines JOIN orders_of USING (l_orderkey) WHERE n = 2 AND l_suppkey % 10 <> 3 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY i DESC) = 1
), pairs AS (
  SELECT l_orderkey, count(*) AS k, min(id) AS entity_1, max(id) AS entity_2, arg_min(cluster, id) AS c1, arg_max(cluster, id) AS c2, arg_min(uniprot, id) || '|' || arg_max(uniprot, id) AS uniprot_pair,
    arg_min(species, id) || '|' || arg_max(species, id) AS species_pair, arg_min(taxonomy, id) || '|' || arg_max(taxonomy, id) AS taxonomy_pair
  FROM entities GROUP BY 1
), selected AS (
  SELECT l_orderkey, 'O' || l_orderkey || '-1' AS assembly_id, 'O' || l_orderkey AS pdb_id, entity_1, entity_2, entity_1 || ',' || entity_2 AS entity_pair, CASE k WHEN 1 THEN 'homo' ELSE 'hetero' END AS dimer_type,
    least(c1, c2) || ',' || greatest(c1, c2) AS cluster_pair_100pct, least(c1, c2) AS low, greatest(c1, c2) AS high, uniprot_pair, species_pair, taxonomy_pair, modeled, price, flags, 'o' || l_orderkey || '-assembly1.cif.gz' AS file
  FROM pairs JOIN orders_of USING (l_orderkey)
)"""


@query(f"""
WITH {_DERIVED} SELECT assembly_id, entity_pair, dimer_type, cluster_pair_100pct, uniprot_pair, species_pair, taxonomy_pair, modeled AS modeled_polymer_monomer_count, price AS resolution_best_angstrom,
  flags AS experimental_method, '2' AS oligomeric_count, file AS local_filename, 'f/' || file AS download_url FROM selected
""")
def q11_dimers(spark, sf):
    names = "assembly_id entity_pair dimer_type cluster_pair_100pct uniprot_pair species_pair taxonomy_pair modeled_polymer_monomer_count resolution_best_angstrom experimental_method oligomeric_count local_filename download_url"
    return cand.candidates(_derived(spark, sf)).select(*names.split())


_PAIRED = f"""
  SELECT d.*, least(s.s_nationkey, t.s_nationkey) AS cluster_1, greatest(s.s_nationkey, t.s_nationkey) AS cluster_2, o.o_totalprice AS resolution
  FROM ({_DIMERS}) d JOIN supplier s ON s.s_suppkey = d.entity_1 JOIN supplier t ON t.s_suppkey = d.entity_2 JOIN orders o ON o.o_orderkey = d.l_orderkey
"""


@query(f"""
SELECT l_orderkey, entity_1, entity_2, dimer_type, modeled, cluster_1, cluster_2, resolution FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_1, cluster_2 ORDER BY resolution, modeled DESC, l_orderkey) AS k FROM ({_PAIRED})
) WHERE k = 1
""")
def q12_representatives(spark, sf):
    nations = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    sides = [nations.select(F.col("s_suppkey").alias(f"entity_{k}"), F.col("s_nationkey").alias(f"nation_{k}")) for k in (1, 2)]
    rows = _dimers(spark, sf).join(sides[0], "entity_1").join(sides[1], "entity_2")
    rows = rows.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("resolution")), "l_orderkey")
    rows = rows.select(
        "l_orderkey", "entity_1", "entity_2", "dimer_type", "modeled", F.least("nation_1", "nation_2").alias("cluster_1"), F.greatest("nation_1", "nation_2").alias("cluster_2"), "resolution"
    ).withColumn("pair", F.struct("cluster_1", "cluster_2"))
    order = [F.col("resolution").asc(), F.col("modeled").desc(), F.col("l_orderkey").asc()]
    return select_representatives(rows, "pair", order).drop("pair")


@query(f"""
WITH {_DERIVED} SELECT 'O' || l_orderkey || '-1' AS assembly_id, CASE n WHEN 2 THEN 'entity_count' ELSE 'instance_count' END AS reject
FROM orders_of WHERE l_orderkey NOT IN (SELECT l_orderkey FROM selected)
""")
def q13_chain_to_entity(spark, sf):
    """Orders that give no candidate, with the reason."""
    return cand.rejects(_derived(spark, sf))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 10)")
def q14_not_present(spark, sf):
    """Orders as files to fetch; lines as the files there are, small ones empty."""
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    present = lines.select(F.concat("l_orderkey", F.lit(".cif.gz")).alias("file"), F.greatest(F.col("l_quantity") - 10, F.lit(0)).alias("size"))
    wanted = table(spark, sf, "orders").select("o_orderkey", F.concat("o_orderkey", F.lit(".cif.gz")).alias("local_filename"))
    return archive.missing_files(wanted, present).select("o_orderkey")


_FIRST = """
named AS (
  SELECT l_orderkey, file, pdb_id, 0 AS pos, entity_1 AS entity, low AS cluster_id FROM selected UNION ALL SELECT l_orderkey, file, pdb_id, 1, entity_2, high FROM selected
), first AS (
  SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY entity ORDER BY pdb_id, pos) = 1
)"""


@query(f"WITH {_DERIVED}, {_FIRST} SELECT entity, cluster_id, file, pos FROM first")
def q15_zip_first_seen(spark, sf):
    return first_entities(cand.candidates(_derived(spark, sf, True)), ["pdb_id", "assembly_number"]).select("entity", "cluster_id", "file", "pos")


def _structures(spark: SparkSession, sf: str) -> DataFrame:
    """Every order of two lines as a structure file, parsed: the lines are chains and, where their number is new, sequences.

    Entity numbers are raised by ten and remapped if the first line's part is even. Some residues are absent, and one may lie beyond the sequence.
    """
    def number(x):
        return x["l_suppkey"] % 3 + 1 + F.when(F.col("lines")[0]["l_partkey"] % 2 == 0, F.lit(10)).otherwise(F.lit(0))

    def text(rows) -> F.Column:
        return F.array_join(rows, "\n")

    lines = F.col("lines")
    chains = F.transform(lines, lambda x, i: F.concat(F.lit("C"), i, F.lit(" "), number(x)))
    fresh = F.when(lines[0]["l_suppkey"] % 3 == lines[1]["l_suppkey"] % 3, F.slice(lines, 1, 1)).otherwise(lines)
    codes = F.array(*[F.lit(c) for c in ("ALA", "GLY", "UNK", "TRP")])
    residues = F.flatten(F.transform(fresh, lambda x: F.transform(F.sequence(F.lit(1), x["l_quantity"]), lambda j: F.concat(number(x), F.lit(" "), F.get(codes, ((j + x["l_partkey"]) % 4).cast("int"))))))
    atoms = F.flatten(
        F.transform(
            lines,
            lambda x, i: F.transform(F.filter(F.sequence(F.lit(0), x["l_quantity"] + 1), lambda j: (j * 7 + x["l_suppkey"]) % 3 != 0), lambda j: F.concat(F.lit("C"), i, F.lit(" "), j)),
        )
    )
    remap = F.when(lines[0]["l_partkey"] % 2 == 0, F.lit("loop_\n_pdbx_entity_remapping.entity_id\n_pdbx_entity_remapping.orig_entity_id\n11 1\n12 2\n13 3\n#\n")).otherwise(F.lit(""))
    content = F.concat(
        F.lit("data_x\n"), remap, F.lit("loop_\n_struct_asym.id\n_struct_asym.entity_id\n"), text(chains), F.lit("\n#\nloop_\n_entity_poly_seq.entity_id\n_entity_poly_seq.mon_id\n"), text(residues),
        F.lit("\n#\nloop_\n_atom_site.label_asym_id\n_atom_site.label_seq_id\n"), text(atoms), F.lit("\nC0 .\n#\n"),
    )
    files = _lines(spark, sf).where(F.size("lines") == 2)
    return parse_structures(files.select(F.concat(F.lit("/files/o"), "l_orderkey", F.lit("-assembly1.cif.gz")).alias("path"), F.encode(content, "utf-8").alias("content")))


_FILES = """
chains AS (
  SELECT l_orderkey, i, l_suppkey, l_quantity::int AS own, l_suppkey % 3 + 1 AS number FROM lines JOIN orders_of USING (l_orderkey) WHERE n = 2
), sequences AS (
  SELECT l_orderkey, l_suppkey % 3 + 1 AS number, arg_min(l_quantity::int, i) AS n, arg_min(l_partkey, i) AS part FROM lines GROUP BY ALL
)"""


@query(f"""
WITH {_DERIVED}, {_FIRST}, {_FILES}
SELECT entity AS entity_name, cluster_id, (SELECT string_agg(substr('AGXW', (j + s.part) % 4 + 1, 1), '' ORDER BY j) FROM range(1, s.n + 1) r(j)) AS sequence, m.mask AS binary_mask
FROM first f JOIN sequences s ON s.l_orderkey = f.l_orderkey AND s.number = string_split(entity, '_')[2]::bigint JOIN (
  SELECT c.l_orderkey, c.number, string_agg('C' || c.i || ': ' || (SELECT string_agg(CASE WHEN (j * 7 + c.l_suppkey) % 3 <> 0 AND j <= c.own + 1 THEN '1' ELSE '0' END, '' ORDER BY j) FROM range(1, s.n + 1) r(j)) || ';', ' ' ORDER BY c.i) AS mask
  FROM chains c JOIN sequences s USING (l_orderkey, number) GROUP BY ALL
) m ON m.l_orderkey = f.l_orderkey AND m.number = s.number
""")
def q16_remap(spark, sf):
    """Sequences and masks of the entities, each from the first file that names it."""
    return curation.sequences(cand.candidates(_derived(spark, sf, True)), _structures(spark, sf))


@query("""
SELECT l_orderkey, string_agg(CASE WHEN p.i IS NULL THEN '0' ELSE '1' END, '' ORDER BY g.i) AS mask
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o CROSS JOIN (SELECT range AS i FROM range(1, 8)) g
LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber AS i FROM lineitem) p USING (l_orderkey, i) GROUP BY l_orderkey
""")
def q17_mask(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(mask(F.collect_set("l_linenumber"), F.lit(7)).alias("mask"))


@query(f"""
WITH {_DERIVED}, {_FILES}
SELECT 'o' || c.l_orderkey || '-assembly1.cif.gz' AS file, 'C' || c.i AS asym_id, count(*) AS beyond
FROM chains c JOIN sequences s USING (l_orderkey, number), range(0, 60) r(j) WHERE j > s.n AND j <= c.own + 1 AND (j * 7 + c.l_suppkey) % 3 <> 0 GROUP BY ALL
""")
def q18_bounded_index(spark, sf):
    """Residue numbers beyond the sequence, by file and chain."""
    return overflow(stage(_structures(spark, sf), "structures"))


_SOURCES = "(SELECT text, source, min(doc_id) AS first FROM documents WHERE source IS NOT NULL GROUP BY 1, 2)"


@query(f"""
SELECT (row_number() OVER (ORDER BY text) - 1) AS ordinal, md5(text) AS digest, sources, docs FROM (
  SELECT text, string_agg(doc_id::varchar, ' ' ORDER BY doc_id) AS docs FROM documents WHERE text IS NOT NULL GROUP BY text
) JOIN (
  SELECT t.text, coalesce(string_agg(s.source, ' ' ORDER BY s.first, s.source), '') AS sources
  FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL) t LEFT JOIN {_SOURCES} s ON s.text = t.text GROUP BY t.text
) USING (text)
""")
def q19_group_by_text(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("text").alias("sequence"), F.col("doc_id").cast("string").alias("entity_name"), F.col("source").alias("cluster_id"), "doc_id")
    groups = with_ordinal(group_sequences(rows, "doc_id"), ["sequence"])
    return groups.select("ordinal", F.md5("sequence").alias("digest"), F.array_join("cluster_ids", " ").alias("sources"), F.array_join("entity_names", " ").alias("docs"))


@query("SELECT md5(text) AS digest, count(DISTINCT source) AS sources FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT source) > 1")
def q20_several_sources(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("text").alias("sequence"), F.col("doc_id").cast("string").alias("entity_name"), F.col("source").alias("cluster_id"), "doc_id")
    return several_clusters(group_sequences(rows, "doc_id")).select(F.md5("sequence").alias("digest"), F.size("cluster_ids").cast("long").alias("sources"))


@query("""
SELECT event_type AS value, count(*) AS n, round(100.0::double * count(*) / sum(count(*)) OVER (), 1) AS percent FROM events WHERE event_type IS NOT NULL GROUP BY 1
""")
def q21_shares(spark, sf):
    return profile.shares(table(spark, sf, "events"), "event_type")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k > 1")
def q22_duplicates(spark, sf):
    return profile.duplicates(table(spark, sf, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id")


@query("""
SELECT count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, min(n) AS min, round(quantile_cont(n, 0.25), 6) AS q25,
       round(quantile_cont(n, 0.5), 6) AS q50, round(quantile_cont(n, 0.75), 6) AS q75, max(n) AS max
FROM (SELECT length(text) AS n FROM documents)
""")
def q23_describe(spark, sf):
    rows = table(spark, sf, "documents").select(F.length("text").cast("long").alias("n"))
    out = profile.describe(rows, "n")
    return out.select("count", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q25", "q50", "q75")])


def _histogram_sql(where: str, name: str) -> str:
    return f"""
SELECT '{name}' AS part, g.bin::int AS bin, coalesce(c.n, 0) AS n FROM (SELECT range AS bin FROM range(1, 51)) g LEFT JOIN (
  SELECT least(floor((v - lo) * 50 / (hi - lo))::bigint + 1, 50) AS bin, count(*) AS n
  FROM (SELECT length(text)::double AS v FROM documents WHERE {where}), (SELECT min(length(text))::double AS lo, max(length(text))::double AS hi FROM documents WHERE {where}) GROUP BY 1
) c USING (bin)"""


@query(_histogram_sql("true", "all") + " UNION ALL " + _histogram_sql("length(text) < 500", "short"))
def q24_histogram(spark, sf):
    rows = table(spark, sf, "documents").select(F.length("text").alias("n"))
    parts = [profile.histogram(part, "n", 50).select(F.lit(name).alias("part"), "bin", "n") for name, part in (("all", rows), ("short", rows.where("n < 500")))]
    return parts[0].unionByName(parts[1])


@query("SELECT count(*) FILTER (WHERE length(text) > 1000) AS n_above, count(*) FILTER (WHERE length(text) < 50) AS n_below FROM documents")
def q25_cutoffs(spark, sf):
    return profile.cutoffs(table(spark, sf, "documents").select(F.length("text").alias("n")), "n", 1000, 50)


@query(f"""
SELECT l_orderkey, entity_1, entity_2 FROM ({_DIMERS}) d WHERE EXISTS (
  SELECT 1 FROM (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING avg(l_quantity) > 26) x WHERE x.l_suppkey IN (d.entity_1, d.entity_2))
""")
def q26_rows_naming(spark, sf):
    long = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q")).where("q > 26")
    pairs = _dimers(spark, sf).withColumn("entity_pair", F.concat_ws(",", "entity_1", "entity_2"))
    return profile.rows_naming(pairs, "entity_pair", long.select(F.col("l_suppkey").cast("string").alias("entity")), "entity").select("l_orderkey", "entity_1", "entity_2")


@query("""
SELECT g.n::int AS length, round(coalesce(avg((length(text) - length(replace(text, 'e', ''))) * 100.0::double / length(text)), 0.0), 6)::double AS mean_percent
FROM (SELECT range AS n FROM range(1, 51)) g LEFT JOIN documents ON length(text) = g.n GROUP BY 1
""")
def q27_letter_share(spark, sf):
    return profile.letter_share_by_length(table(spark, sf, "documents"), "text", "e", 50).select("length", F.round("mean_percent", 6).alias("mean_percent"))


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::double <> 0 THEN json_extract_string(props, '$.k') END AS k FROM events")
def q28_json(spark, sf):
    return table(spark, sf, "events").select("event_id", truthy_text(F.try_parse_json("props"), "$.k").alias("k"))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def q29_tsv_round_trip(spark, sf):
    """Written as TSV into the shared folder and read back with its schema."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    path = f"{shared_dir(spark)}/pairloom/tsv-{uuid4().hex}"
    write_tsv(rows, path)
    return read_tsv(spark, path, rows.schema)


@query(f"""
WITH RECURSIVE p AS (SELECT DISTINCT entity_1 AS a, entity_2 AS b FROM ({_DIMERS}) WHERE entity_1 <> entity_2), s AS (
  SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) AS k FROM supplier
), g AS (
  SELECT 0::bigint AS k, []::bigint[] AS chosen
  UNION ALL
  SELECT s.k, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.b = s.id AND list_contains(g.chosen, p.a)) THEN g.chosen ELSE list_append(g.chosen, s.id) END FROM g JOIN s ON s.k = g.k + 1
), c AS (
  SELECT unnest(chosen) AS id FROM g WHERE k = (SELECT count(*) FROM supplier)
)
SELECT s.id, coalesce(c.id, (SELECT min(p.a) FROM p WHERE p.b = s.id AND p.a IN (SELECT id FROM c))) AS representative FROM s LEFT JOIN c ON c.id = s.id
""")
def q30_greedy(spark, sf):
    """Suppliers in order of their keys; two are similar if an order of two lines names both."""
    pairs = _dimers(spark, sf).where("dimer_type = 'hetero'").select(F.col("entity_1").alias("a"), F.col("entity_2").alias("b")).distinct()
    return greedy(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")), pairs)


@query("""
WITH e AS (SELECT DISTINCT s_nationkey, s_name, min(s_suppkey) OVER (PARTITION BY s_nationkey, s_name) AS f FROM supplier), g AS (
  SELECT n_name AS sequence, string_agg(s_name, ' ' ORDER BY f, s_name) AS names FROM e JOIN nation ON n_nationkey = s_nationkey GROUP BY 1
), r AS (
  SELECT row_number() OVER (ORDER BY sequence) - 1 AS k, * FROM g
)
SELECT '>' || k || ';' || sequence || ';' || names AS value FROM r UNION ALL SELECT sequence FROM r
""")
def q31_fasta_round_trip(spark, sf):
    """Nations as sequences of their suppliers, written as FASTA into the shared folder and read as lines."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("sequence"), F.col("n_name").alias("cluster_id"))
    rows = table(spark, sf, "supplier").join(nations, "s_nationkey").select("sequence", F.col("s_name").alias("entity_name"), "cluster_id", "s_suppkey")
    path = f"{shared_dir(spark)}/pairloom/fasta-{uuid4().hex}"
    write_fasta(fasta_records(group_sequences(rows, "s_suppkey")), path)
    return spark.read.text(path).select("value")
