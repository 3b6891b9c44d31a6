"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting by which a query's shuffled files are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, or the session's checkpoint folder; on one machine a temporary folder becomes it.

    Raises RuntimeError where a cluster has neither: executors do not see each other's local folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("korrel.scratch.dir", None)
    if not found:
        context = spark.sparkContext
        set_by_hand = context._jsc.sc().getCheckpointDir()
        if set_by_hand.isDefined():
            found = set_by_hand.get()
        elif context.master.startswith("local"):
            found = "file://" + tempfile.mkdtemp(prefix="korrel-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("korrel.scratch.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/korrel/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read from there.

    A lost executor costs a re-read, never a recomputation, and plans stay short. The files that were shuffled for it
    are removed as soon as it is there, not when the driver next collects garbage, so they don't add up over steps.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Removes all stored tables of the shared folder; for when no frame that reads them is in use any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/korrel")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
