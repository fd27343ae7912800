"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a temporary one, on a single machine only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = getattr(spark, "_lamina_shared", None)
        if where is None:
            where = spark._lamina_shared = tempfile.mkdtemp(prefix="lamina-")
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    This cuts the lineage as checkpoint() does, but computes the plan once. The files survive the loss of
    any executor, and go when the driver ends if they have not been discarded before. No empty file marks success, as
    nothing looks for it: on local disks the driver starts a process for each file's rights, which shares its memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lamina/{name}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    written(spark).append(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """The paths of this session's intermediate tables that have not been discarded."""
    if not hasattr(spark, "_lamina_written"):
        spark._lamina_written = []
    return spark._lamina_written


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables that no plan reads any more."""
    conf = spark._jsc.hadoopConfiguration()
    for path in list(paths):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in written(spark):
            written(spark).remove(path)


def release(spark: SparkSession) -> None:
    """Let the driver forget finished jobs, so that Spark's cleaner removes their shuffle files from the executors'
    disks now; otherwise they stay until the driver's heap fills."""
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer tasks than half the cores, such as one file of one row group, is dealt out to all cores; scans
    of more tasks, as of any large table, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if 2 * df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input's size: used to size filters and tasks, never to choose results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
