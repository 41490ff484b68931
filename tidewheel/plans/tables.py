"""Working tables that cut lineage: Parquet in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

WORK_KEY = "spark.checkpoint.dir"
LOCAL_WORK = "file:///tmp/checkpoints"
#: Shuffle files of a finished write serve nobody: what it wrote is read from the table.
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder named by ``spark.checkpoint.dir``; a local default only for local masters."""
    base = spark.conf.get(WORK_KEY, None)
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {WORK_KEY} to a folder that all executors share")
        base = LOCAL_WORK
    return f"{base}/tidewheel/{spark.sparkContext.applicationId}"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def store(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """Write ``df``; return it reread, and its path.

    The table cuts the lineage and outlives lost executors; the shuffle files behind
    it go once it is written.  All tables of an application lie in one folder, which
    goes when the driver's JVM ends; single ones go earlier by :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_KEY, "false")
    spark.conf.set(CLEAN_KEY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_KEY, before)
    at, fs = _file_system(spark, work_dir(spark))
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at, fs = _file_system(spark, path)
        fs.delete(at, True)
