"""Columns over residues: one-letter codes and presence masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter residue names and their letters; the second line holds common modified residues.
LETTERS = dict(
    zip(
        "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL SEC PYL ASX GLX".split()
        + "MSE SEP TPO PTR CSO CME HYP KCX MLY M3L CSD OCS PCA LLP SEC".split(),
        "A R N D C Q E G H I L K M F P S T W Y V U O B Z".split() + "M S T Y C C P K K K C C Q K U".split(),
    )
)
UNKNOWN = "X"


def one_letter(codes: Column) -> Column:
    """An array of residue names as letters; unknown and null names give X."""
    table = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    return F.array_join(F.transform(codes, lambda c: F.coalesce(F.try_element_at(table, F.upper(c)), F.lit(UNKNOWN))), "")


def mask(present: Column, length: Column) -> Column:
    """0/1 text of ``length`` places; ``present`` is an array of 1-based places. Places outside
    1..length are ignored, repeats count once, a length of 0 gives an empty text."""
    places = F.array_sort(F.array_distinct(F.filter(present, lambda i: (i >= 1) & (i <= length))))
    before = F.concat(F.array(F.lit(0)), places)
    runs = F.zip_with(places, F.slice(before, F.lit(1), F.size(places)), lambda i, j: F.concat(F.repeat(F.lit("0"), i - j - 1), F.lit("1")))
    last = F.coalesce(F.array_max(places), F.lit(0))
    return F.when(length > 0, F.concat(F.array_join(runs, ""), F.repeat(F.lit("0"), length - last))).otherwise("")


def mask_text(chains: Column) -> Column:
    """``A: 1101; B: 1111;`` of an array of (asym_id, mask) structs."""
    return F.array_join(F.transform(chains, lambda c: F.concat(c["asym_id"], F.lit(": "), c["mask"], F.lit(";"))), " ")
