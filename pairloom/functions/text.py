"""Column helpers for text: strip, split and guarded casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as in Unicode, and the no-break spaces that Java's class leaves out.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def strip(c: Column) -> Column:
    """Removes white space of any kind at both ends; ``trim`` removes blanks only."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def split_ids(c: Column) -> Column:
    """Comma text to an array of stripped, non-blank parts; null gives an empty array."""
    parts = F.transform(F.split(c, ",", -1), strip)
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def before_last(c: Column, sep: str) -> Column:
    """What stands before the last ``sep``; null where there is none."""
    return F.when(c.contains(sep), F.regexp_extract(c, f"(?s)^(.*)\\Q{sep}\\E", 1))


def after_last(c: Column, sep: str) -> Column:
    """What stands after the last ``sep``; null where there is none."""
    return F.when(c.contains(sep), F.substring_index(c, sep, -1))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)
