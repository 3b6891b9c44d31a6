"""Work for every core where a table comes in fewer pieces than there are cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt out by keys if it has fewer partitions than the session runs tasks at once; else df as it is.

    A file of one row group is one task. A large table has more pieces than there are cores and is never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


#: Rows that one task holds of a table that is dealt out in portions.
PORTION = 1 << 19


def portions(df: DataFrame, *keys: str) -> DataFrame:
    """df, dealt out by keys in portions of about PORTION rows where the session's shuffles make larger ones; else df as it is.

    What is then grouped or joined by these keys takes as much memory a task as before, however large df grows. df is
    counted for it, so it should be a table that is read and not computed.
    """
    tasks = -(-df.count() // PORTION)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
