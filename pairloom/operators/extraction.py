"""Entity sequences and per-chain presence masks from selected assemblies and structure files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.residues import mask, mask_text, one_letter
from pairloom.functions.text import strip

MISSING = "-"


def first_entities(selected: DataFrame, order: list[str], *, aligned: bool = False) -> DataFrame:
    """(entity, cluster_id, file, ord..., pos): each entity once, from the first row that names it.

    The cluster stands at the entity's place in ``cluster_pair_100pct``, which is sorted by
    itself, so the two of a hetero pair may be swapped; with ``aligned`` it comes from
    ``entity_clusters``, which follows the entities. Rows without a pair and blank parts give
    nothing; ``order`` says what comes first.
    """
    source = "entity_clusters" if aligned else "cluster_pair_100pct"
    clusters = F.split(source, ",", -1)
    parts = selected.select(
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        F.concat(F.lower("pdb_id"), F.lit("-assembly"), F.col("assembly_number"), F.lit(".cif.gz")).alias("file"),
        clusters.alias("_clusters"),
        F.posexplode(F.split("entity_pair", ",", -1)).alias("pos", "part"),
    )
    one = parts.select(
        *[f"_o{i}" for i in range(len(order))], "file", "pos", strip(F.col("part")).alias("entity"), strip(F.get("_clusters", F.when(F.col("pos") == 0, 0).otherwise(1))).alias("cluster_id")
    ).where("entity <> ''")
    by = [F.col(f"_o{i}") for i in range(len(order))] + [F.col("pos"), F.col("file"), F.col("cluster_id")]
    ranked = one.withColumn("_rank", F.row_number().over(Window.partitionBy("entity").orderBy(*by)))
    return ranked.where("_rank = 1").drop("_rank")


def entity_number(entity) -> F.Column:
    """The second part of a name like 1BCK_2; null without one."""
    return strip(F.get(F.split(entity, "_", -1), F.lit(1)))


def extract(selected: DataFrame, structures: DataFrame, order: list[str] | None = None, *, aligned: bool = False) -> DataFrame:
    """(entity_name, cluster_id, sequence, binary_mask), one row an entity.

    A missing or unreadable file gives the sequence ``-`` and a null mask, an entity without
    residues ``-`` and masks of no places. Remapped entity numbers are followed once (the first
    row that changes the number). Residue numbers that are no numbers, below 1 or beyond the
    sequence are left out of the masks (``overflow`` counts the last kind). Names without a number give no row
    (``unnumbered``).
    """
    wanted = first_entities(selected, order or ["pdb_id", "assembly_number"], aligned=aligned)
    wanted = wanted.select("entity", "cluster_id", "file", entity_number(F.col("entity")).alias("number")).where("number is not null")
    good = structures.where("category <> 'error'").select("file").distinct().withColumn("has_file", F.lit(True))
    def part(category: str) -> DataFrame:
        return structures.where(F.col("category") == category)

    remap = part("remap").where("a <> b").groupBy("file", F.col("b").alias("number")).agg(F.min_by("a", "ord").alias("new"))
    keyed = wanted.join(good, "file", "left").join(remap, ["file", "number"], "left").withColumn("number", F.coalesce("new", "number")).drop("new")
    codes = part("poly_seq").groupBy("file", F.col("a").alias("number")).agg(F.sort_array(F.collect_list(F.struct("ord", "b"))).alias("codes"))  # an entity's own residues
    codes = codes.select("file", "number", one_letter(F.col("codes.b")).alias("letters"))
    keyed = keyed.join(codes, ["file", "number"], "left")
    chains = part("asym").select("file", F.col("b").alias("number"), F.col("a").alias("asym_id"), "ord")
    here = keyed.select("entity", "file", "number", F.coalesce(F.length("letters"), F.lit(0)).alias("n")).join(chains, ["file", "number"])
    places = part("residue").select("file", F.col("a").alias("asym_id"), F.expr("try_cast(b as int)").alias("place")).where("place >= 1")
    present = places.groupBy("file", "asym_id").agg(F.collect_set("place").alias("places"))  # a chain's own residues
    masks = here.join(present, ["file", "asym_id"], "left").withColumn("places", F.coalesce("places", F.array().cast("array<int>")))
    masks = masks.select("entity", F.struct("ord", "asym_id", mask(F.col("places"), F.col("n")).alias("mask")).alias("m"))
    text = masks.groupBy("entity").agg(mask_text(F.sort_array(F.collect_list("m"))).alias("text"))
    return keyed.join(text, "entity", "left").select(
        F.col("entity").alias("entity_name"), "cluster_id", F.coalesce("letters", F.lit(MISSING)).alias("sequence"), F.when(F.col("has_file"), F.coalesce("text", F.lit(""))).alias("binary_mask")
    )


def overflow(structures: DataFrame) -> DataFrame:
    """(file, asym_id, beyond): residue numbers beyond the sequence of the chain's entity."""
    def part(category: str) -> DataFrame:
        return structures.where(F.col("category") == category)

    length = part("poly_seq").groupBy("file", F.col("a").alias("number")).agg(F.count("*").alias("n"))
    chains = part("asym").select("file", F.col("b").alias("number"), F.col("a").alias("asym_id"))
    places = part("residue").select("file", F.col("a").alias("asym_id"), F.expr("try_cast(b as int)").alias("place"))
    met = places.join(chains, ["file", "asym_id"]).join(length, ["file", "number"], "left").where(F.col("place") > F.coalesce("n", F.lit(0)))
    return met.groupBy("file", "asym_id").agg(F.count("*").alias("beyond"))


def unnumbered(selected: DataFrame) -> DataFrame:
    """Entity names that hold no number, once each."""
    names = selected.select(F.explode(F.split("entity_pair", ",", -1)).alias("part")).select(strip(F.col("part")).alias("entity")).where("entity <> ''")
    return names.where(entity_number(F.col("entity")).isNull()).distinct()
