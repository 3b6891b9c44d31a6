"""Queries of evidence: sentences, sources, coverage, layers, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.functions import chat
from korrel.operators import evidence as e
from korrel.operators import graph, retrieval
from korrel.queries import build
from korrel.queries import sql as s
from korrel.queries import graph as graphs
from korrel.sources import bindings as b


def matched_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The four documents behind every sentence of the benchmark."""
    return e.matched_nodes(e.answer_sentences(b.questions(spark, d)), b.nodes(spark, d))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Whether any document covers a conversation's question."""
    asked = b.messages(spark, d).filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return e.coverage(retrieval.most_hits(retrieval.term_index(b.nodes(spark, d)), asked), asked)


def source_refs(spark: SparkSession, d: str) -> DataFrame:
    """Sources of every benchmark item: documents that hold most of its terms, then those that rank by cosine."""
    index, asked = retrieval.term_index(b.nodes(spark, d)), b.questions(spark, d)
    first = retrieval.lexical_seeds(index, asked).select("question_id", "rank", "id")
    then = retrieval.tfidf_topk(index, asked).select("question_id", (F.col("rank") + 2).alias("rank"), "id")
    return e.source_refs(first.union(then), b.nodes(spark, d))


def edge_layers(spark: SparkSession, d: str) -> DataFrame:
    """Verified and heuristic edges by relation."""
    return e.edge_layers(graphs.with_provenance(b.edges(spark, d)))


def recognized_topics(spark: SparkSession, d: str) -> DataFrame:
    """The five benchmark items that most documents hold."""
    items = b.table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("title"))
    return e.recognized(build.mention_edges(spark, d), items).select("target", "n", "rank")


def import_log(spark: SparkSession, d: str) -> DataFrame:
    """The last thirty imports, with users as imports."""
    return e.import_log(b.table(spark, d, "events").select(F.col("user_id").alias("import_id"), F.col("event_id").alias("ord"), "event_type"))


def blind_order(spark: SparkSession, d: str) -> DataFrame:
    """Customers in blind order."""
    return e.blind_order(b.table(spark, d, "customer").select(F.col("c_name").cast("string").alias("id"), F.col("c_custkey").alias("ord")))


def route_linked(spark: SparkSession, d: str) -> DataFrame:
    """The retrieval condition of questions with two, one or no linked entities."""
    n = b.table(spark, d, "nation").join(b.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("Was liefert "), "n_name", F.lit(" nach "), "r_name")).when(k % 3 == 1, F.concat(F.lit("Wer war Lehrer in "), "n_name")).otherwise("Worum geht es hier")
    q = n.select(k.alias("id"), text.alias("text"))
    linked = graph.link_entities(q, b.entity_names(spark, d)).groupBy("question_id").agg(F.count("*").alias("n"))
    both = q.join(linked, q["id"] == linked["question_id"], "left")
    return both.select("id", chat.route(F.lit(None).cast("string"), F.coalesce("n", F.lit(0)), F.col("text")).alias("condition"))


_SENTENCES = f"SELECT item_id AS id, CAST(generate_subscripts({s.sentences('text')}, 1) - 1 AS INTEGER) AS pos, unnest({s.sentences('text')}) AS sentence FROM benchmark"
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, [CAST(ord(c) AS BIGINT) FOR c IN string_split(c_name, '')]), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_SEED2 = f"hits AS (SELECT question_id, id, count(*) AS hits FROM (SELECT item_id AS question_id, unnest(list_distinct({s.terms('text')})) AS term FROM benchmark) JOIN posts USING (term) GROUP BY ALL), two AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, id) AS rank FROM hits QUALIFY rank <= 2)"

QUERIES = {
    "matched_nodes": (matched_nodes, f"WITH nodes AS ({s.DOCUMENTS}), a AS (SELECT DISTINCT id, pos, unnest({s.terms('sentence')}) AS term FROM ({_SENTENCES})), w AS (SELECT node, term, max(points) AS points FROM (SELECT id AS node, unnest({s.terms('title')}) AS term, 4 AS points FROM nodes UNION ALL SELECT id, unnest({s.terms('summary')}), 1 FROM nodes) GROUP BY ALL) SELECT id, pos, node, CAST(sum(points) AS BIGINT) AS points, CAST(row_number() OVER (PARTITION BY id, pos ORDER BY sum(points) DESC, node) AS INTEGER) AS rank FROM a JOIN w USING (term) GROUP BY id, pos, node QUALIFY rank <= 4"),
    "coverage": (coverage, f"WITH {s.POSTINGS}, q AS (SELECT conv_id || '-' || turn AS question_id, text FROM conversations WHERE role = 'user'), h AS (SELECT question_id, id, count(*) AS hits FROM (SELECT question_id, unnest(list_distinct({s.terms('text')})) AS term FROM q) JOIN posts USING (term) GROUP BY ALL), m AS (SELECT question_id, max(hits) AS most FROM h GROUP BY question_id) SELECT question_id, coalesce(most, 0) AS most, coalesce(most, 0) < 2 AS uncovered FROM q LEFT JOIN m USING (question_id)"),
    "source_refs": (source_refs, f"WITH {s.TFIDF}, {_SEED2}, every AS (SELECT question_id, id, rank FROM two UNION ALL SELECT question_id, id, rank + 2 FROM ranked WHERE rank <= 4), f AS (SELECT question_id, id, min(rank) AS rank FROM every GROUP BY ALL) SELECT question_id, id, title, CAST(row_number() OVER (PARTITION BY question_id ORDER BY rank, id) AS INTEGER) AS place FROM f JOIN nodes USING (id)"),
    "edge_layers": (edge_layers, f"SELECT relation, count(*) AS n, count(*) FILTER (c = 2) AS verified, count(*) FILTER (c > 0) AS heuristic FROM (SELECT relation, {graphs._P} AS c FROM ({b.EDGES_SQL})) GROUP BY relation"),
    "recognized_topics": (recognized_topics, f"WITH m AS ({build.QUERIES['mention_edges'][1]}), c AS (SELECT target, count(DISTINCT source) AS n FROM m GROUP BY target) SELECT target, n, CAST(row_number() OVER (ORDER BY n DESC, text, target) AS INTEGER) AS rank FROM c JOIN benchmark ON 'b' || item_id = target QUALIFY rank <= 5"),
    "import_log": (import_log, "SELECT user_id AS import_id, max(event_id) AS ord, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id ORDER BY ord DESC LIMIT 30"),
    "blind_order": (blind_order, f"SELECT c_name AS id, row_number() OVER (ORDER BY {_FNV}, c_custkey) AS place FROM customer"),
    "route_linked": (route_linked, "SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'graph' ELSE 'vector' END AS condition FROM nation"),
}
