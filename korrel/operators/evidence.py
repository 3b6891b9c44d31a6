"""What supports an answer: nodes behind its sentences, sources, coverage, and layers of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from korrel.functions import text as t
from korrel.operators.retrieval import token_counts, top
from korrel.plans.scratch import stored
from korrel.plans.spread import spread

#: Points of a term in a title and in a text, nodes of a sentence, and shared stems from which a question is covered.
TITLE, BODY, NODES, COVERED = 4, 1, 4, 2


def answer_sentences(answers: DataFrame) -> DataFrame:
    """(id, pos, sentence) of answers (id, text)."""
    return answers.select("id", F.posexplode(t.sentences("text")).alias("pos", "sentence"))


def matched_nodes(sentences: DataFrame, nodes: DataFrame, k: int = NODES) -> DataFrame:
    """(id, pos, node, points, rank): of every sentence (id, pos, sentence) the k nodes (id, title, summary) with most points.

    A distinct term gives TITLE points where the title has it, else BODY where the text does. Sentences without any
    such node have no row; a left join keeps them.
    """
    asked = token_counts(sentences, ["id", "pos"], F.col("sentence")).select("id", "pos", "term")
    own = lambda c, points: token_counts(spread(nodes.select(F.col("id").alias("node"), c), "node"), ["node"], F.col(c)).select("node", "term", F.lit(points).alias("points"))
    worth = own("title", TITLE).union(own("summary", BODY)).groupBy("node", "term").agg(F.max("points").alias("points"))
    scored = asked.join(worth, "term").groupBy("id", "pos", "node").agg(F.sum("points").cast("long").alias("points"))
    rank = F.row_number().over(Window.partitionBy("id", "pos").orderBy(F.desc("points"), "node"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def coverage(hits: DataFrame, questions: DataFrame, least: int = COVERED) -> DataFrame:
    """(question_id, most, uncovered) of questions (id): the largest number of stems that a node shares (question_id, hits)."""
    most = hits.groupBy("question_id").agg(F.max("hits").alias("most"))
    every = questions.select(F.col("id").alias("question_id")).join(most, "question_id", "left").withColumn("most", F.coalesce("most", F.lit(0)))
    return every.withColumn("uncovered", F.col("most") < least)


def source_refs(retrieved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(question_id, place, id, title) of retrieved (question_id, rank, id): each known node once, where it first stands, from 1."""
    first = retrieved.groupBy("question_id", "id").agg(F.min("rank").alias("rank")).join(nodes.select("id", "title"), "id")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "id"))).drop("rank")


def edge_layers(edges: DataFrame) -> DataFrame:
    """(relation, n, verified, heuristic): edges with any verified and with any heuristic entry; one may have both."""
    any_ = lambda c: F.count_if(F.exists(F.coalesce("provenance", F.array().cast(edges.schema["provenance"].dataType)), lambda p: p["confidence"] == c))
    return edges.groupBy("relation").agg(F.count("*").alias("n"), any_("verified").alias("verified"), any_("heuristic").alias("heuristic"))


def recognized(mentions: DataFrame, names: DataFrame, k: int = 5) -> DataFrame:
    """(target, title, n, rank): the k names that most documents mention; ties by title."""
    counted = mentions.groupBy("target").agg(F.count_distinct("source").alias("n")).join(names.select(F.col("id").alias("target"), "title"), "target")
    return top(counted.withColumn("all", F.lit(1)), "all", [F.desc("n"), F.asc("title"), F.asc("target")], k).drop("all")


def import_log(reports: DataFrame, keep: int = 30) -> DataFrame:
    """reports (import_id, ord, ...): the newest of each id, and of those the last `keep`."""
    newest = stored(reports.groupBy("import_id").agg(F.max_by(F.struct(*[c for c in reports.columns if c != "import_id"]), "ord").alias("r")).select("import_id", "r.*"), "reports")
    return newest.orderBy(F.desc("ord")).limit(keep)


def blind_order(trials: DataFrame) -> DataFrame:
    """(id, place) of trials (id, ord) by the hash of their id; equal hashes by ord. Ranges are sorted apart and counted up."""
    hashed = trials.select("id", "ord", t.fnv1a(F.col("id")).alias("h"))
    part = hashed.withColumn("range", F.floor(F.col("h") / 65536).cast("int"))
    sizes = part.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("range")) - F.col("n")).select("range", "before")  # 65536 rows at most
    place = F.row_number().over(Window.partitionBy("range").orderBy("h", "ord"))
    return part.join(before, "range").select("id", (place + F.col("before")).alias("place"))
