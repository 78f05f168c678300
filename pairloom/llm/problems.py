"""Queries of the problems tagged llm."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.functions.text import after_last, before_last, strip
from pairloom.llm.components import assign_splits, components
from pairloom.llm.leaks import leaks
from pairloom.llm.mixing import measure, mix, source_name, targets_of
from pairloom.llm.parity import similar_pairs
from pairloom.llm.runs import runs
from pairloom.llm.sentences import sentences
from pairloom.llm.survivors import Alternatives, Bundle, consistent_records, survivors
from pairloom.operators.packed import pair_columns
from pairloom.session import bounded_rows, spread, stage

SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# p2: one record per unordered cluster pair

def _candidates(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Rows with their unordered pair; rows whose field doesn't hold just two values have none."""
    names = ["candidate_id", "assembly_id", "revised_at", "resolution_best_angstrom", "modeled_polymer_monomer_count", "experimental_method", *more]
    rows = pair_columns(spread(table(spark, sf, "candidate").select("cluster_pair_100pct", *names)), "cluster_pair_100pct", exact=True)
    pair = {"cluster_1": F.least("side_1", "side_2"), "cluster_2": F.greatest("side_1", "side_2"), "assembly": F.upper("assembly_id")}
    return rows.where("side_1 is not null").withColumns(pair).drop("side_1", "side_2", "cluster_pair_100pct")


def _resolution() -> Column:
    c = F.col("resolution_best_angstrom")
    return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))


def _bundles(values: bool) -> list[Bundle]:
    fields = [("resolution_best_angstrom",), ("modeled_polymer_monomer_count",), ("experimental_method",)] if values else [(), (), ()]
    count = F.col("modeled_polymer_monomer_count")
    return [
        Bundle("resolution", fields[0], _resolution(), F.col("resolution_best_angstrom")),
        Bundle("modeled", fields[1], count > 0, -count, 0.0),
        Bundle("method", fields[2], F.col("experimental_method").rlike(r"\p{L}")),
    ]


def _survivors(rows: DataFrame, bundles: list[Bundle]) -> DataFrame:
    number, pdb = after_last(F.col("assembly"), "-"), before_last(F.col("assembly"), "-")
    return survivors(rows, ["cluster_1", "cluster_2"], "assembly", [pdb, number], bundles, ["revised_at"], "candidate_id").where("n >= 2").drop("n")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _survivors(_candidates(spark, sf), _bundles(False)).withColumnRenamed("assembly", "assembly_id")


def _two_kinds(text: str | None, bars: str = "|") -> str | None:
    """homo or hetero by whether the two sides are equal; None where there aren't two."""
    parts = [p.strip().strip("\"'[]").casefold() for p in (text or "").replace("¦", bars).replace("｜", bars).split(bars)]
    return None if len(parts) != 2 or not all(parts) else "homo" if parts[0] == parts[1] else "hetero"


def _naming(held: tuple, _: str) -> dict | None:
    sides = _two_kinds(held[0], ",")
    said = (held[1] or "").strip().casefold() or sides
    return None if sides and said != sides else {"kind": said} if said else {}


def _sided(held: tuple, _: str) -> dict:
    """Different sides speak for two entities; equal ones for neither."""
    return {"kind": "hetero"} if any(_two_kinds(x) == "hetero" for x in held) else {}


def _origin(held: tuple, assembly: str) -> dict:
    return {**_sided(held, assembly), **({f"taxonomy of {held[0].casefold()}": held[1] or ""} if held[0] else {})}


def _place(held: tuple, _: str) -> dict:
    return {"file": held[1].casefold(), **({"file of url": held[1].casefold()} if held[0].casefold().endswith(held[1].casefold()) else {"file of url": ""})}


def _roots(assembly: str) -> dict:
    pdb, _, number = assembly.rpartition("-")
    name = f"{pdb}-assembly{number}.cif.gz".casefold()
    return {"file": name, "file of url": name}


RECORD_FIELDS = ("entity_pair", "dimer_type", "uniprot_pair", "species_pair", "taxonomy_pair", "download_url", "local_filename")


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    """The surviving records with their values. Names, accessions, origin and place are whole bundles of
    the assembly's rows that don't contradict each other: entities that are the same have the same
    accessions and species, a species one taxonomy, an assembly one file."""
    rows = stage(_candidates(spark, sf, *RECORD_FIELDS), "candidates")
    best = stage(_survivors(rows, _bundles(True)), "survivors")
    has = {x: F.col(x).rlike(r"[\p{L}\p{N}]") for x in RECORD_FIELDS}
    bundles = [
        Alternatives("naming", ("entity_pair", "dimer_type"), has["entity_pair"], _naming),
        Alternatives("partners", ("uniprot_pair",), has["uniprot_pair"], _sided),
        Alternatives("origin", ("species_pair", "taxonomy_pair"), has["species_pair"], _origin),
        Alternatives("place", ("download_url", "local_filename"), has["download_url"] & has["local_filename"], _place),
    ]
    keys = ["cluster_1", "cluster_2", "assembly"]
    more = consistent_records(rows, best, keys[:2], "assembly", bundles, ["revised_at"], "candidate_id", _roots)
    return best.join(more, keys).withColumnRenamed("assembly", "assembly_id")


SQL["p2_found"] = r"""
WITH rows AS (
  SELECT candidate_id, upper(assembly_id) AS a, revised_at, resolution_best_angstrom AS r, modeled_polymer_monomer_count AS m, experimental_method AS x,
         list_sort(list_filter(list_transform(regexp_split_to_array(cluster_pair_100pct, '[,;|]'), lambda s: trim(s, ' "''')), lambda s: s <> '')) AS p
  FROM candidate
), pairs AS (
  SELECT *, p[1] AS cluster_1, p[2] AS cluster_2 FROM rows WHERE len(p) = 2
), per AS (
  SELECT cluster_1, cluster_2, a, count(*) AS n,
         arg_max(r, row(revised_at, candidate_id)) FILTER (WHERE r > 0 AND NOT isnan(r) AND NOT isinf(r)) AS r,
         arg_max(candidate_id, row(revised_at, candidate_id)) FILTER (WHERE r > 0 AND NOT isnan(r) AND NOT isinf(r)) AS r_row,
         arg_max(m, row(revised_at, candidate_id)) FILTER (WHERE m > 0) AS m,
         arg_max(candidate_id, row(revised_at, candidate_id)) FILTER (WHERE m > 0) AS m_row,
         arg_max(candidate_id, row(revised_at, candidate_id)) FILTER (WHERE regexp_matches(x, '[A-Za-z]')) AS x_row
  FROM pairs GROUP BY ALL
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY cluster_1, cluster_2) AS total,
         row_number() OVER (PARTITION BY cluster_1, cluster_2 ORDER BY r NULLS LAST, coalesce(m, 0) DESC,
           regexp_extract(a, '^(.*)-', 1), regexp_extract(a, '-([^-]*)$', 1)) AS k
  FROM per WHERE a IS NOT NULL
)
SELECT cluster_1, cluster_2, a AS assembly_id, coalesce(r_row, -1) AS resolution_row, coalesce(m_row, -1) AS modeled_row, coalesce(x_row, -1) AS method_row
FROM ranked WHERE k = 1 AND total >= 2
"""


# p5: splits that keep tied clusters together


def _ties(spark: SparkSession, sf: str) -> DataFrame:
    rows = pair_columns(table(spark, sf, "selected_assemblies").select("cluster_pair_100pct", "dimer_type"), "cluster_pair_100pct")
    return rows.select(F.col("side_1").alias("a"), F.col("side_2").alias("b"), "dimer_type")


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entity_sequences").where(strip(F.col("cluster_id")) != "").select(F.col("cluster_id"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return components(_clusters(spark, sf), _ties(spark, sf).select("a", "b"), "cluster_id")


SQL["p5_found"] = r"""
WITH RECURSIVE parts AS (
  SELECT list_filter(list_transform(regexp_split_to_array(cluster_pair_100pct, '[,;|/&\s，]+'), lambda s: trim(s, '"''[]' || chr(160))), lambda s: regexp_matches(s, '[A-Za-z0-9]')) AS p
  FROM selected_assemblies
), edges AS (
  SELECT p[1] AS a, p[2] AS b FROM parts WHERE len(p) = 2 UNION SELECT p[2], p[1] FROM parts WHERE len(p) = 2
), nodes AS (
  SELECT cluster_id AS id FROM entity_sequences WHERE trim(cluster_id) <> '' UNION SELECT unnest(p) FROM parts
), reach AS (
  SELECT id, id AS r FROM nodes UNION SELECT reach.id, e.b FROM reach JOIN edges e ON e.a = reach.r
)
SELECT id AS cluster_id, min(r) AS group_id FROM reach GROUP BY id
"""


def p5_splits(spark: SparkSession, sf: str) -> DataFrame:
    """(cluster_id, group_id, split): labels are the entities and the assemblies by dimer type."""
    groups = stage(p5_found(spark, sf), "groups")
    entities = _clusters(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("weight")).withColumn("label", F.lit("entity"))
    kind = F.coalesce(F.lower(strip(F.col("dimer_type"))), F.lit(""))
    kind = F.when(kind.isin("homo", "hetero"), kind).otherwise("other")
    pairs = _ties(spark, sf).select(F.coalesce("a", "b").alias("cluster_id"), F.concat(F.lit("assembly "), kind).alias("label"))
    pairs = pairs.where("cluster_id is not null").groupBy("cluster_id", "label").agg(F.count("*").alias("weight"))
    weights = entities.unionByName(pairs).join(groups, "cluster_id").select("group_id", "label", "weight")
    rows = bounded_rows(table(spark, sf, "split_shares").orderBy(F.desc("share"), "split_name"), 100)
    if rows is None:
        raise ValueError("more than 100 splits")
    shares = [(r["split_name"], r["share"]) for r in rows]
    return groups.join(assign_splits(groups, weights, shares), "group_id").select("cluster_id", "group_id", "split")


def p5_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares reached: entities and assemblies by split."""
    splits = stage(p5_splits(spark, sf), "splits").select("cluster_id", "split")
    entities = _clusters(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("entity"))
    pairs = _ties(spark, sf).select(F.coalesce("a", "b").alias("cluster_id")).where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"))
    both = entities.unionByName(pairs.withColumn("what", F.lit("assembly"))).join(splits, "cluster_id").groupBy("what", "split").agg(F.sum("n").alias("n"))
    whole = both.groupBy("what").agg(F.sum("n").alias("total"))
    return both.join(whole, "what").select("what", "split", "n", (F.col("n") / F.col("total")).alias("share"))


# p3: clusters whose sequences are nearly the same

WINDOW = 5
BITS_OF_WINDOW = (26**WINDOW).bit_length()


def windows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of a column of residues: the distinct runs of WINDOW letters without X, as numbers, in order."""
    data = pa.array(column.fill_null("")) if column.null_count else column
    sizes = np.diff(np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1])
    start = np.frombuffer(data.buffers()[1], np.int32)[data.offset]
    total = int(sizes.sum())
    if total < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters = np.frombuffer(data.buffers()[2], np.uint8)[start : start + total].astype(np.int64) - 65
    row = np.repeat(np.arange(len(data)), sizes)
    code, clean = np.zeros(total - WINDOW + 1, np.int64), row[: total - WINDOW + 1] == row[WINDOW - 1 :]
    for k in range(WINDOW):
        part = letters[k : total - WINDOW + 1 + k]
        code = code * 26 + part
        clean &= part != 23
    both = np.sort((row[: len(code)] << BITS_OF_WINDOW | code)[clean])
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    return both >> BITS_OF_WINDOW, both & (1 << BITS_OF_WINDOW) - 1


def residues(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z]", "")


#: Up to so many clusters with several sequences are sent to the sequences; more are joined.
BROADCAST_KINDS = 100_000


def _sequences(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences with an id, their only cluster, if there is one, and as ``kind`` that
    cluster if it has other sequences too; (id, cluster_id) of all."""
    rows = table(spark, sf, "entity_sequences").select("cluster_id", residues(F.col("sequence")).alias("sequence"))
    rows = rows.where(f"cluster_id is not null and length(sequence) >= {WINDOW}")
    grouped = rows.groupBy("sequence").agg(F.collect_set("cluster_id").alias("clusters"))
    grouped = stage(spread(grouped).withColumn("id", F.monotonically_increasing_id()), "sequences")
    distinct = grouped.select("id", "sequence", F.when(F.size("clusters") == 1, F.get("clusters", F.lit(0))).alias("alike"))
    several = distinct.where("alike is not null").groupBy("alike").agg(F.count("*").alias("n")).where("n > 1").select("alike", F.col("alike").alias("kind"))
    several = stage(several, "kinds")
    few = several.limit(BROADCAST_KINDS + 1).count() <= BROADCAST_KINDS
    return distinct.join(F.broadcast(several) if few else several, "alike", "left"), grouped.select("id", F.explode("clusters").alias("cluster_id"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    distinct, members = _sequences(spark, sf)
    pairs = similar_pairs(distinct, Fraction(1, 2), "kind", column="sequence", read=windows, runs=runs).select("a", "b")
    whole = F.col("sequence").rlike(f"[A-WYZ]{{{WINDOW}}}")  # has a window
    own = distinct.where(F.col("alike").isNull() & whole).select(F.col("id").alias("a"), F.col("id").alias("b"))
    sides = [members.select(F.col("id").alias(k), F.col("cluster_id").alias(f"cluster_{k}")) for k in "ab"]
    found = pairs.unionByName(own).join(sides[0], "a").join(sides[1], "b").where("cluster_a <> cluster_b")
    return found.select(F.least("cluster_a", "cluster_b").alias("cluster_a"), F.greatest("cluster_a", "cluster_b").alias("cluster_b")).distinct()


def p3_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """One row per row of the table: its class of equal sequences and how many other classes are similar to it.

    The cluster plays no part. Sequences without a window have a class and no links; a row in
    which no residue is left has neither.
    """
    rows = table(spark, sf, "entity_sequences").select("row_id", residues(F.col("sequence")).alias("sequence"))
    distinct = rows.where("sequence <> ''").select("sequence", F.lit(None).cast("string").alias("alike")).distinct()
    distinct = stage(spread(distinct).withColumn("id", F.monotonically_increasing_id()), "sequences")
    pairs = stage(similar_pairs(distinct, Fraction(1, 2), column="sequence", read=windows, runs=runs).select("a", "b"), "links")
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("links"))
    classes = distinct.join(ends, "id", "left").select("sequence", F.sha2("sequence", 256).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return rows.join(classes, "sequence", "left").select("row_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


SQL["p3_found"] = r"""
WITH s AS (
  SELECT DISTINCT cluster_id, regexp_replace(upper(sequence), '[^A-Z]', '', 'g') AS q FROM entity_sequences WHERE cluster_id IS NOT NULL
), w AS (
  SELECT DISTINCT q, substr(q, i::int, 5) AS t FROM (SELECT DISTINCT q FROM s WHERE length(q) >= 5), range(1, length(q) - 3) r(i)
), v AS (
  SELECT * FROM w WHERE NOT contains(t, 'X')
), n AS (
  SELECT q, count(*) AS n FROM v GROUP BY q
), pairs AS (
  SELECT a.q AS x, b.q AS y, count(*) AS c FROM v a JOIN v b ON a.t = b.t GROUP BY 1, 2
), near AS (
  SELECT x, y FROM pairs JOIN n AS p ON p.q = x JOIN n AS r ON r.q = y WHERE 2 * c >= p.n + r.n - c
)
SELECT DISTINCT k.cluster_id AS cluster_a, l.cluster_id AS cluster_b
FROM near JOIN s AS k ON k.q = x JOIN s AS l ON l.q = y WHERE k.cluster_id < l.cluster_id
"""


SQL["p3_sequences"] = r"""
WITH s AS (
  SELECT row_id, nullif(regexp_replace(upper(sequence), '[^A-Z]', '', 'g'), '') AS q FROM entity_sequences
), v AS (
  SELECT * FROM (SELECT DISTINCT q, substr(q, i::int, 5) AS t FROM (SELECT DISTINCT q FROM s WHERE length(q) >= 5), range(1, length(q) - 3) r(i)) WHERE NOT contains(t, 'X')
), n AS (
  SELECT q, count(*) AS n FROM v GROUP BY q
), pairs AS (
  SELECT a.q AS x, b.q AS y, count(*) AS c FROM v a JOIN v b ON a.t = b.t AND a.q <> b.q GROUP BY 1, 2
), links AS (
  SELECT x AS q, count(*) AS links FROM pairs JOIN n AS p ON p.q = x JOIN n AS r ON r.q = y WHERE 2 * c >= p.n + r.n - c GROUP BY 1
)
SELECT row_id, sha256(s.q) AS class_id, coalesce(links, 0) AS links FROM s LEFT JOIN links USING (q)
"""


# p6: held-out items in documents


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p6_renamed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold an item's passage with other numbers and names in its slots."""
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), renamed=True)


#: DuckDB has no NFKC; of its compatibility forms these are the ones in the supplied texts: full width, superscript digits, ligatures, the Thai sara am.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000\u00a0\u00b2\u00b3\u00b9"
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + "  231"
_NORMAL = f"lower(nfc_normalize(replace(replace(replace(translate(text, '{_WIDE}', '{_PLAIN}'), chr(64257), 'fi'), chr(64258), 'fl'), chr(3635), chr(3661) || chr(3634))))"
_ALONE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}"
SQL["p6_found"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(x, '([{_ALONE}])', ' \1 ', 'g'), '[\p{{L}}\p{{M}}\p{{Nd}}]+') AS w FROM (SELECT doc_id, {_NORMAL} AS x FROM documents WHERE doc_id IS NOT NULL)
), i AS (
  SELECT item_id, CASE WHEN substr(lower(trim(coalesce(lang, ''))), 1, 2) IN ('zh', 'ja') THEN 30 ELSE 12 END AS k,
    regexp_extract_all(regexp_replace(x, '([{_ALONE}])', ' \1 ', 'g'), '[\p{{L}}\p{{M}}\p{{Nd}}]+') AS w FROM (SELECT item_id, lang, {_NORMAL} AS x FROM eval_items WHERE item_id IS NOT NULL)
), dw AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[a : a + k - 1], ' ') AS run FROM d, (VALUES (12), (30)) AS s(k), range(1, len(w) - k + 2) r(a)
), iw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[a : a + k - 1], ' ') AS run FROM i, range(1, len(w) - k + 2) r(a)
)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (k, run)
"""


# p7: a mix of sources with target shares


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    measured = stage(measure(table(spark, sf, "documents"), "doc_id", "text", "source"), "measured")
    return mix(measured, targets_of(table(spark, sf, "mix_targets"), "source", "target_share", "max_repeats"))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The report: target and reached share of every source that has a target."""
    targets = table(spark, sf, "mix_targets").where("target_share > 0").groupBy(source_name(F.col("source")).alias("source"))
    targets = targets.agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    got = p7_mix(spark, sf).groupBy("source").agg(F.sum(F.col("uses") * F.col("tokens")).alias("tokens"), F.count("*").alias("texts"), F.max("uses").alias("most_uses"))
    got = targets.join(got, "source", "left").na.fill(0, ["tokens", "texts", "most_uses"])
    return got.withColumn("share", F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy(F.lit(1)))))  # a row a source


# p8: sentence units


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences(table(spark, sf, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p2_found, p2_records, p3_found, p3_sequences, p5_found, p5_splits, p5_shares, p6_found, p6_renamed, p7_mix, p7_shares, p8_found)}
