"""The tables of a folder as the relations of the graph: nodes, typed edges, questions, trials, ratings, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.plans.spread import portions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nodes (ord, id, title, type, community, summary); whole texts."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("ord"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), F.concat(F.lit("Dokument "), F.col("doc_id").cast("string")).alias("title"),
        F.col("lang").alias("type"), F.col("source").alias("community"), F.col("text").alias("summary"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions (ord, id, text)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("item_id").alias("id"), "text")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges (source, target, relation, label) between places, people, goods and their makers."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))

    def made(df: DataFrame, s: str, sc: str, t: str, tc: str, relation: str, label: str) -> DataFrame:
        return df.select(node(s, sc).alias("source"), node(t, tc).alias("target"), F.lit(relation).alias("relation"), F.lit(label).alias("label"))

    return (
        made(t("nation"), "n", "n_nationkey", "r", "n_regionkey", "teil_von", "ist Teil von")
        .union(made(t("customer"), "c", "c_custkey", "n", "c_nationkey", "wirkte_in", "wirkte in"))
        .union(made(t("supplier"), "s", "s_suppkey", "n", "s_nationkey", "verortet_in", "ist verortet in"))
        .union(made(portions(t("lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").distinct(), "s", "l_suppkey", "p", "l_partkey", "liefert", "liefert"))
    )


EDGES_SQL = """
SELECT 'n' || n_nationkey AS source, 'r' || n_regionkey AS target, 'teil_von' AS relation, 'ist Teil von' AS label FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'wirkte_in', 'wirkte in' FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'verortet_in', 'ist verortet in' FROM supplier
UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'liefert', 'liefert' FROM lineitem
"""


def entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, type) of the ends of edges()."""
    t = lambda name: table(spark, sf_dir, name)
    made = lambda df, p, k, n, kind: df.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.col(n).cast("string").alias("title"), F.lit(kind).alias("type"))
    return (
        made(t("region"), "r", "r_regionkey", "r_name", "place").union(made(t("nation"), "n", "n_nationkey", "n_name", "place"))
        .union(made(t("customer"), "c", "c_custkey", "c_name", "person")).union(made(t("supplier"), "s", "s_suppkey", "s_name", "institution"))
        .union(made(t("part"), "p", "p_partkey", "p_name", "work"))
    )


NAMES_SQL = """
SELECT 'r' || r_regionkey AS id, r_name AS title, 'place' AS type FROM region
UNION ALL SELECT 'n' || n_nationkey, n_name, 'place' FROM nation
UNION ALL SELECT 'c' || c_custkey, c_name, 'person' FROM customer
UNION ALL SELECT 's' || s_suppkey, s_name, 'institution' FROM supplier
UNION ALL SELECT 'p' || p_partkey, p_name, 'work' FROM part
"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trials of an experiment."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        F.col("event_id").alias("ord"), F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("user_id").alias("question_id"), F.col("event_type").alias("condition"),
        F.col("value").cast("double").alias("latency_ms"), k.alias("context_chars"), (k % 2 == 0).alias("correct"), F.when(k % 5 != 0, (k % 11) / 10.0).alias("recall"),
        F.when(k % 2 == 0, "korrekt").when(k % 3 == 0, "teilweise").when(k % 7 == 0, "enthaltung").otherwise("falsch").alias("score"), F.when(k % 4 != 3, "end-to-end").otherwise("legacy").alias("scope"),
    )


TRIALS_SQL = """
SELECT event_id AS ord, strftime(ts, '%Y-%m-%d') AS run_id, user_id AS question_id, event_type AS condition, CAST(value AS DOUBLE) AS latency_ms, k AS context_chars,
  k % 2 = 0 AS correct, CASE WHEN k % 5 <> 0 THEN (k % 11) / 10.0::DOUBLE END AS recall,
  CASE WHEN k % 2 = 0 THEN 'korrekt' WHEN k % 3 = 0 THEN 'teilweise' WHEN k % 7 = 0 THEN 'enthaltung' ELSE 'falsch' END AS score,
  CASE WHEN k % 4 <> 3 THEN 'end-to-end' ELSE 'legacy' END AS scope
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
