"""First, last and running rows of ordered groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korrel.functions.text import compact


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per non-empty key, that of the smallest order. Pre-aggregated, so hot keys do not meet in one task."""
    kept = df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return kept.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r")).select(key, "r.*")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, that of the largest order."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r")).select(key, "r.*")


def history(messages: DataFrame, last: int = 6, width: int = 700) -> DataFrame:
    """(conv_id, history): the last non-blank messages, each "role: text", collapsed and cut, by line."""
    said = messages.withColumn("text", compact(F.col("text"))).filter("text <> ''")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    lines = said.withColumn("k", rank).filter(F.col("k") <= last).select("conv_id", "turn", F.concat_ws(": ", "role", F.substring("text", 1, width)).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    return lines.groupBy("conv_id").agg(F.array_join(ordered, "\n").alias("history"))


def last_question(messages: DataFrame) -> DataFrame:
    """messages with the user's most recent earlier text."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return messages.withColumn("previous", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before))


def newer_only(events: DataFrame, room: str, revision: str, order: str) -> DataFrame:
    """Events whose revision is above all earlier ones of their room."""
    before = Window.partitionBy(room).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    highest = F.max(revision).over(before)
    return events.withColumn("highest", highest).filter(F.col("highest").isNull() | (F.col(revision) > F.col("highest"))).drop("highest")


def phase_changes(events: DataFrame, room: str, phase: str, order: str) -> DataFrame:
    """Events whose phase differs from the one before in their room; the first counts."""
    was = F.lag(phase).over(Window.partitionBy(room).orderBy(order))
    return events.withColumn("was", was).filter(~F.col("was").eqNullSafe(F.col(phase))).drop("was")


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, first): distinct values with the order in which they come up."""
    return df.groupBy(value).agg(F.min(order).alias("first"))
