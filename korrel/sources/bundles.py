"""Exports of whole runs and stores of a user's graph: folders of parts, none of which one task must hold."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.operators import merge
from korrel.sources import io

SCHEMA_VERSION, REPORTS = 3, 30
# What an export says of its times, its order and its parts.
TIMING = {
    "latencyMs": "End-to-End: Vorbereitung einschließlich Retrieval plus Generierung",
    "prepareMs": "Vorbereitung einschließlich Retrieval und Promptaufbau",
    "retrievalMs": "Retrieval bzw. Subgraph-Extraktion innerhalb der Vorbereitung",
    "generationMs": "reine Modellgenerierung",
    "legacyNote": "latencyScope=generation-only kennzeichnet migrierte Altdaten ohne End-to-End-Messung",
}
ORDERING = "runId, repetitionId, repetition, order und seed erlauben die Rekonstruktion jedes Messlaufs"
README = "Reproduzierbarkeitspaket: metadata_and_results enthält Rohdaten und Messstand; csv ist die flache Prüftabelle. Quizdaten sind ausgeschlossen."


def _one(spark: SparkSession, text: str, path: str) -> None:
    """A small text as the only file of a folder."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def header(spark: SparkSession, tool: str, strategy: str, prompt: str, conditions: list[str], nodes: DataFrame, edges: DataFrame, questions: DataFrame, results: int) -> dict:
    """What an export says besides its results: where, how and on what they were made. questions (id) are a catalogue, whose ids it lists."""
    ids = [r["id"] for r in questions.select(F.col("id").cast("string").alias("id")).orderBy("id").collect()]  # a catalogue of questions
    context = spark.sparkContext
    return {
        "exportedAt": datetime.now(UTC).isoformat(), "tool": tool, "schemaVersion": SCHEMA_VERSION,
        "reproducibility": {
            "systemPrompt": prompt, "conditions": conditions, "corpus": {"nodes": nodes.count(), "edges": edges.count(), "frozen": True}, "questions": {"n": len(ids), "ids": ids},
            "environment": {"spark": spark.version, "master": context.master.split("://")[0], "parallelism": context.defaultParallelism, "timeZone": spark.conf.get("spark.sql.session.timeZone")},
        },
        "timing": TIMING, "ordering": {"strategy": strategy, "note": ORDERING}, "results": {"folder": "results", "n": results},
    }


def write_results(trials: DataFrame, path: str, about: dict, order: str = "ord") -> None:
    """Trials as a folder: `document` with what `about` says, `results` with a JSON line for each, in order.

    Ranges of the order are written apart; names of files follow it.
    """
    trials.repartitionByRange(order).sortWithinPartitions(order).drop(order).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/results")
    _one(trials.sparkSession, json.dumps(about, ensure_ascii=False), f"{path}/document")


def write_bundle(trials: DataFrame, path: str, about: dict, order: str = "ord") -> None:
    """A package to hand in: README, `metadata_and_results` as write_results makes it, and `csv` with the flat table."""
    write_results(trials, f"{path}/metadata_and_results", about, order)
    io.write_csv(trials, f"{path}/csv", order)
    _one(trials.sparkSession, README, f"{path}/README")


def read_bundle(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """(about, trials, lines) of a bundle: its document, its results, and its table's lines (value) without headers."""
    about = json.loads(spark.read.text(f"{path}/metadata_and_results/document").first()["value"])
    lines = spark.read.text(f"{path}/csv").filter(F.col("value") != ";".join(io.EXPORTED))
    return about, spark.read.schema(io.TRIAL).json(f"{path}/metadata_and_results/results"), lines


def save_graph(folder: str, version: int, nodes: DataFrame, edges: DataFrame, reports: DataFrame | None = None) -> None:
    """A user's graph as a new version of a folder: valid nodes and edges only, equal ones united, the last REPORTS import reports.

    Nodes that repeat an id are the first by their fields with all provenance valid; loops and edges without a valid
    end, relation or label go. Without reports (at, report), those of the newest version stay. A version is seen once all
    of it is written; one that is written again replaces itself.
    """
    spark = nodes.sparkSession
    had = saved_graph(spark, folder, version)
    kept = reports if reports is not None else had[2] if had else spark.createDataFrame([], "at long, report string")
    newest = kept.orderBy(F.desc("at"), "report").limit(REPORTS)
    rest = [c for c in nodes.columns if c not in ("id", "provenance")]
    once = merge.valid_nodes(nodes).groupBy("id").agg(F.min_by(F.struct("provenance", *rest), F.to_json(F.struct(*rest))).alias("r")).select("id", "r.*")
    once = once.withColumn("provenance", merge.merged_provenance(F.col("provenance"))).select(nodes.columns)
    fine = merge.valid_edges(edges)
    whole = merge.merged_edges(fine, fine.limit(0))
    for name, rows in (("nodes", once), ("edges", whole), ("reports", newest)):
        rows.write.mode("overwrite").parquet(f"{folder}/{name}/{version}")
    spark.range(1).select(F.lit(version).cast("long").alias("number")).write.mode("overwrite").parquet(f"{folder}/done/version={version}")


def saved_graph(spark: SparkSession, folder: str, before: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(nodes, edges, reports) of the newest version of a folder, or of the newest below `before`; None if there is none."""
    try:
        done = spark.read.parquet(f"{folder}/done")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    newest = (done if before is None else done.filter(F.col("version") < before)).agg(F.max("version").alias("n")).first()["n"]
    return None if newest is None else tuple(spark.read.parquet(f"{folder}/{x}/{newest}") for x in ("nodes", "edges", "reports"))


def kept_research(nodes: DataFrame, edges: DataFrame, session_nodes: DataFrame, session_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A session's findings made durable: its nodes with new ids, and all its edges, united with those that are there."""
    new = session_nodes.join(nodes.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return nodes.unionByName(new), merge.merged_edges(edges, session_edges)
