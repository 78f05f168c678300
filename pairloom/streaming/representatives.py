"""Representatives kept up to date as documents land.

The choice of the best candidate is an associative minimum, so each micro-batch's winners are
merged into the stored table and the result is that of one pass over all documents seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators import candidates as cand
from pairloom.operators.representatives import select_representatives
from pairloom.schemas import CANDIDATE_COLUMNS

LANDED = T.StructType([T.StructField("value", T.StringType())])


def read_landed(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of landed documents, one JSON text a line (column ``payload``)."""
    stream = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files_per_batch).text(path)
    return stream.withColumnRenamed("value", "payload")


def latest_version(spark: SparkSession, table: str) -> tuple[int, DataFrame | None]:
    """(number, rows) of the newest complete version below ``table``; (-1, None) if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return -1, None
    done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return (max(done), spark.read.parquet(f"{table}/v{max(done)}")) if done else (-1, None)


def merge(batch: DataFrame, table: str, batch_id: int, keep: int = 2) -> None:
    """Writes version ``batch_id`` of ``table``: the best of the stored rows and this batch's.

    A batch that is run again after a failure finds its version written and does nothing, or
    writes it anew from the version before; older versions beyond ``keep`` are removed.
    """
    spark = batch.sparkSession
    number, stored = latest_version(spark, table)
    if number >= batch_id:
        return
    fresh = cand.candidates(cand.derive(batch.select("payload"))).select(*CANDIDATE_COLUMNS, "entity_clusters")
    rows = select_representatives(fresh) if stored is None else select_representatives(stored.unionByName(fresh))
    rows.write.mode("overwrite").parquet(f"{table}/v{batch_id}")
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        if name.startswith("v") and int(name[1:]) <= batch_id - keep:
            fs.delete(s.getPath(), True)


def follow(docs: DataFrame, table: str, checkpoint: str, **trigger):
    """Starts the stream; ``trigger`` is that of ``DataStreamWriter.trigger`` (e.g. ``availableNow=True``)."""
    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: merge(batch, table, n))
    return (writer.trigger(**trigger) if trigger else writer).start()


def windowed_counts(docs: DataFrame, stamp: str = "fetched_at", late: str = "1 day", size: str = "1 day") -> DataFrame:
    """(start, documents, rejected) by window of landing time; rows later than the watermark are left out."""
    derived = cand.derive(docs.select("payload", stamp)).withWatermark(stamp, late)
    counted = derived.groupBy(F.window(stamp, size)).agg(F.count("*").alias("documents"), F.count("reject").alias("rejected"))
    return counted.select(F.col("window.start").alias("start"), "documents", "rejected")
