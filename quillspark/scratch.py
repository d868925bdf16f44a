"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where the cluster names one; only a local session without it (tests) gets a temporary folder."""
    for conf in (spark.conf, spark.sparkContext.getConf()):
        if found := conf.get("spark.checkpoint.dir", None):
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quillspark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system, as the driver's JVM knows them."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder, all of which goes when the driver's JVM ends."""
    context, own = spark.sparkContext, _own_dir(spark)
    if getattr(context, "_quillspark_scratch", None) != own:
        path, system = _hadoop(spark, own)
        system.mkdirs(path)
        system.deleteOnExit(path)
        context._quillspark_scratch = own
    return f"{own}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    found, system = _hadoop(spark, path)
    system.delete(found, True)


def release(spark: SparkSession) -> None:
    """Deletes all scratch tables of the application so far, for long sessions: results made of them must have been written, and their indexes saved."""
    drop(spark, _own_dir(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and fixes what later branches see."""
    spark = df.sparkSession
    df.write.parquet(path := scratch_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


#: A table below this size mostly stands in one row group, which one task scans.
SMALL_BYTES = 16 << 20
#: Tasks that share such a table, on any number of cores, so that what a partition decides doesn't depend on these.
PARTS = 8


def spread(df: DataFrame) -> DataFrame:
    """df dealt over PARTS tasks if it is too small for its scan to be split; larger tables stay as they are scanned, without a shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(PARTS) if size < SMALL_BYTES else df
