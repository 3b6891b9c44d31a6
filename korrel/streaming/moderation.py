"""Suggestions that a host decides on, committed to the user's graph once each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions import text as t
from korrel.operators import merge


def decided(suggestions: DataFrame, decisions: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(room, id, topic, accepted, at): suggestions (room, id, topic, ts) with the decision (room, id, accepted, ts) on them.

    Works on streams and on tables. A decision counts from its suggestion's time on, for so long; streams keep rows no
    longer than that and what may come late. A decision without a suggestion gives nothing.
    """
    s = suggestions.select("room", "id", "topic", F.col("ts").alias("asked")).withWatermark("asked", late)
    d = decisions.select(F.col("room").alias("r"), F.col("id").alias("i"), "accepted", F.col("ts").alias("at")).withWatermark("at", late)
    on = (F.col("room") == F.col("r")) & (F.col("id") == F.col("i")) & (F.col("at") >= F.col("asked")) & (F.col("at") <= F.col("asked") + F.expr(f"INTERVAL {within}"))
    return s.join(d, on).select("room", "id", "topic", "accepted", "at")


def nodes_of(accepted: DataFrame, like: DataFrame) -> DataFrame:
    """Accepted topics as nodes with the columns of `like`; of equal topics the first by time."""
    kind = like.schema["provenance"].dataType
    first = accepted.filter("accepted").withColumn("node", t.slug(F.col("topic"))).groupBy("node").agg(F.min(F.struct("at", "id", "topic", "room")).alias("r")).select("node", "r.*")
    source = F.concat(F.lit("seminar:"), F.col("room").cast("string"))
    fields = {"sourceId": source, "importScopeId": source, "sourceKind": F.lit("seminar"), "sourceTitle": F.col("topic"), "method": F.lit("moderated"), "confidence": F.lit("verified"), "evidence": F.col("id")}
    entry = F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.elementType])
    own = {"id": F.col("node"), "title": F.col("topic"), "type": F.lit("konzept"), "community": F.lit("custom"), "summary": F.lit(""), "provenance": F.array(entry)}
    return first.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def graph(spark: SparkSession, folder: str, before: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """The newest committed (nodes, edges) of a folder, or the newest under a number below `before`; None if there is none."""
    try:
        done = spark.read.parquet(f"{folder}/done")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    newest = (done if before is None else done.filter(F.col("batch") < before)).agg(F.max("batch").alias("n")).first()["n"]
    return None if newest is None else tuple(spark.read.parquet(f"{folder}/{what}/{newest}") for what in ("nodes", "edges"))


def committer(folder: str, base: DataFrame, nodes: DataFrame, edges: DataFrame) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that merges each batch of decided suggestions into the user's graph, once.

    nodes and edges are the graph before the first batch; base (id) is the frozen one. A batch reads the version before
    its own number and writes its own anew, so that one which comes again, after a failure at any point, leaves what it
    left the first time. A version is seen once its number stands in `done`.
    """

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        had = graph(spark, folder, number) or (nodes, edges)
        made = merge.applied(base, *had, nodes_of(batch, nodes), edges.limit(0))
        for what, rows in (("nodes", made.nodes), ("edges", made.edges), ("delta", made.delta)):
            rows.write.mode("overwrite").parquet(f"{folder}/{what}/{number}")
        spark.range(1).select(F.lit(number).cast("long").alias("number")).write.mode("overwrite").parquet(f"{folder}/done/batch={number}")

    return commit
