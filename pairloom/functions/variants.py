"""Reading polymorphic JSON: fields that hold a scalar, a list or nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.text import split_ids


def items(v: Column, path: str = "$") -> Column:
    """What lies at ``path`` as array<variant>: a list's elements, a lone value as one, nothing as none."""
    value = F.try_variant_get(v, path, "variant")
    return F.when(value.isNull() | F.is_variant_null(value), F.array().cast("array<variant>")).otherwise(
        F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array(value))
    )


def kind(v: Column) -> Column:
    """The JSON type: OBJECT<..>, ARRAY<..>, STRING, BIGINT, DOUBLE, DECIMAL(..), BOOLEAN or VOID; null if absent."""
    return F.schema_of_variant(v)


def is_number(v: Column) -> Column:
    k = kind(v)
    return F.coalesce((k == "BIGINT") | (k == "DOUBLE") | (k == "FLOAT") | k.startswith("DECIMAL"), F.lit(False))


def truthy_text(v: Column, path: str = "$") -> Column:
    """A non-empty text, non-zero number or true as text, else null (lists and objects too)."""
    value = F.try_variant_get(v, path, "variant")
    k = kind(value)
    number = F.try_variant_get(v, path, "double")
    text = F.try_variant_get(v, path, "string")
    return F.when(k == "STRING", F.when(text != "", text)).when(is_number(value), F.when(number != 0, text)).when(k == "BOOLEAN", F.when(text == "true", F.lit("True")))


def truthy_texts(v: Column, path: str) -> Column:
    """The texts of a scalar or list, without empty ones and zeros."""
    return F.array_compact(F.transform(items(v, path), lambda x: truthy_text(x)))


def ids(v: Column, path: str) -> Column:
    """Comma texts, lists of them, or lists of lists, as one list of stripped ids."""
    return F.flatten(F.transform(items(v, path), lambda x: F.flatten(F.transform(items(x), lambda y: split_ids(F.try_variant_get(y, "$", "string"))))))


def joined(texts: Column) -> Column:
    """Distinct texts in order, joined by semicolons."""
    return F.array_join(F.array_sort(F.array_distinct(texts)), ";")
