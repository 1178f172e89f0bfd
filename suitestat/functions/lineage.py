"""The folder that driver and executors share, and cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or on one machine (tests) a folder of our own where that is unset; elsewhere it must be set."""
    sc = spark.sparkContext
    set_by_cluster = sc.getConf().get("spark.checkpoint.dir")
    made = sc._jsc.sc().getCheckpointDir()
    if set_by_cluster:
        if not made.isDefined():
            sc.setCheckpointDir(set_by_cluster)
        return set_by_cluster.rstrip("/")
    if not made.isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Spark deletes the shuffle files of a plan once it has run.
CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, free: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: as cut(), but Spark knows its size, so a join with it shuffles the other side only if it is large.

    free: the shuffle files of the write go when it ends, not when the driver's memory is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_SETTING)
    try:
        if free:
            spark.conf.set(CLEAN_SETTING, "true")
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)
