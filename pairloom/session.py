"""Session helpers: where lineage is cut, and how small tables are proven small."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster session
    without it is an error, as a machine-local folder would lose data with its executor.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("pairloom.shared.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="pairloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.conf.set("pairloom.shared.dir", own)
    return own


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here,
    later readers prune columns, and the loss of an executor costs nothing.

    The files stay until ``unstage`` or ``clean``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pairloom/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


#: The stages of each application that still exist.
_written: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def unstage(*stages: DataFrame | None) -> None:
    """Removes stages that nothing reads any more, as the earlier rounds of a loop."""
    for df in stages:
        path = getattr(df, "_staged", None)
        own = _written.get(df.sparkSession.sparkContext.applicationId, []) if path else []
        if path in own:
            own.remove(path)
            _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Removes all stages of this application; results that read them can't be used any more."""
    own = _written.pop(spark.sparkContext.applicationId, [])
    for path in own:
        _delete(spark, path)


#: Inputs of fewer bytes a core are small: their files are read in fewer partitions than there are cores.
SMALL = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if by the sizes of its files it is small and may lie in few partitions.

    Nothing is run to find out: what is read has its size in the plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores) if size < SMALL * cores else df


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """All rows if there are at most ``limit`` of them, else None (never a cut-off list)."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
