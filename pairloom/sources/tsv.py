"""Tab-separated tables with explicit schemas, read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that one common reader takes for missing by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_tsv(spark: SparkSession, path: str, schema: T.StructType, na_tokens: tuple[str, ...] = ()) -> DataFrame:
    """A TSV with a header. Types are never inferred. Empty cells are null; with ``na_tokens``
    (off by default, so that a sequence NA stays) those texts are null too."""
    df = spark.read.csv(path, sep="\t", header=True, schema=schema, escape='"', multiLine=False)
    if na_tokens:
        texts = [f.name for f in schema if isinstance(f.dataType, T.StringType)]
        df = df.withColumns({c: F.when(~F.col(c).isin(*na_tokens), F.col(c)) for c in texts})
    return df


def write_tsv(df: DataFrame, path: str, *, one_file: bool = False, line_end: str = "\r\n") -> None:
    """Header and rows; quotes are doubled and nulls are empty. ``one_file`` is for small tables
    at the edge; the order of the rows is that of ``df`` within each part."""
    out = df.coalesce(1) if one_file else df
    out.write.csv(path, sep="\t", header=True, emptyValue="", nullValue="", escape='"', lineSep=line_end)
