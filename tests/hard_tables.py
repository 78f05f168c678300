"""Tables that are empty, or hold rows of nulls, repeated rows and columns with clashing names."""

from pyspark.sql import functions as F

TABLES = "assembly candidate selected_assemblies entity_sequences organism documents eval_items mix_targets split_shares".split()
CLASHING = "doc node parent owner path value n id key tokens a b u v source_ s cell role alike label weight side_1 side_2 pair start_pos end_pos item_id_ sequence_ h line bucket uses".split()


def empty(spark, sf, folder):
    for t in TABLES:
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def hard(spark, sf, folder):
    for t in TABLES:
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        nothing = df.limit(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
        rows = df.unionByName(df.limit(5)).unionByName(nothing) if t not in ("split_shares", "mix_targets") else df.unionByName(nothing)
        for k in df.columns:  # one row with a null in this column
            rows = rows.unionByName(df.limit(1).withColumn(k, F.lit(None).cast(df.schema[k].dataType))) if t not in ("split_shares", "mix_targets") else rows
        more = {c: F.lit("x") for c in CLASHING if c not in df.columns}
        rows.withColumns(more).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)
