"""Intermediate tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN = "caseloom.staging.dir"
_WRITTEN: dict[str, set[str]] = {}


def staging_dir(spark: SparkSession) -> str:
    """The shared folder for intermediates: ``spark.checkpoint.dir`` where it is set.

    Only a local session without that setting gets a temporary folder of its own; on a
    cluster a folder of one machine would not be readable by the other executors, so
    its absence is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="caseloom-")
    spark.conf.set(_OWN, base)
    return base


def staged(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns the table read back.

    Unlike ``checkpoint()`` the plan runs once, the result is columnar, and readers
    prune columns and push filters down.  An empty frame keeps its schema.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_counting(df: DataFrame, condition, name: str = "stage") -> tuple[DataFrame, int]:
    """The staged table and how many of its rows meet ``condition``, counted by the write itself."""
    seen = Observation()
    out = staged(df.observe(seen, F.count_if(condition).alias("n"), F.count(F.lit(1)).alias("rows")), name)
    return out, seen.get["n"]


def unstage(df: DataFrame) -> None:
    """Removes the files of a staged frame that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    base = staging_dir(spark)
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        if base.split(":", 1)[-1].strip("/") in f:
            p = jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def let_go(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more.

    It does so only when the driver collects its garbage, which may be after the job.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sweep(spark: SparkSession) -> int:
    """Removes every intermediate this application has written; returns their number.

    For the end of a job: results that are still to be read from intermediates are lost.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, set())
    jvm = spark.sparkContext._jvm
    for f in paths:
        p = jvm.org.apache.hadoop.fs.Path(f)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer partitions than that (a small table in
    one file); a scan that already feeds every core is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
