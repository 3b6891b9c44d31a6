"""The retrieval planner: from questions to contexts and prompts, under six conditions that share their parts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.operators import graph, retrieval
from korrel.operators.embeddings import Model, embedded
from korrel.plans.scratch import scratch_path, stored

CONDITIONS = ("baseline", "vector", "vector_budget", "graph", "graph_no_edges", "hybrid")
#: Hits of a vector context, of the pool that a budget is filled from, and added to a subgraph.
K, POOL, EXTRA = 4, 16, 3
# The parts of a prompt.
CONTEXT, CONTEXT_NODES, QUESTION = "KONTEXT:\n", "KONTEXT (KNOTEN OHNE RELATIONEN):\n", "FRAGE: "


@dataclass
class Retrieved:
    """What the conditions are made of; each part is computed and stored when a condition first asks for it.

    nodes (id, title, summary), edges, and names (id, title) with aliases; without names, the titles. With a model,
    hits are dense: by inner product of embeddings, which `cache` keeps; else by TF-IDF.
    """

    questions: DataFrame
    nodes: DataFrame
    edges: DataFrame
    names: DataFrame | None = None
    depth: int = 3
    beam: int = 4
    most: int = 14
    model: Model | None = None
    cache: str | None = None

    @cached_property
    def index(self) -> retrieval.TermIndex:
        """The TF-IDF index of the nodes."""
        return retrieval.term_index(self.nodes)

    @cached_property
    def hits(self) -> DataFrame:
        """(question_id, id, rank): the pool of ranked nodes."""
        if self.model is not None:
            return stored(self._dense().select("question_id", "id", "rank"), "hits")
        return stored(retrieval.tfidf_topk(self.index, self.questions, POOL).select("question_id", "id", "rank"), "hits")

    def _dense(self) -> DataFrame:
        cache = self.cache or scratch_path(self.questions.sparkSession, "embeddings")
        text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("summary", F.lit("")))
        vectors = embedded(self.nodes.select("id", text.alias("text")), self.model, cache)
        asked = embedded(self.questions.select("id", "text"), self.model, cache)
        found = retrieval.dense_topk(vectors, asked.select(F.col("id").cast("string").alias("query_id"), F.col("v").alias("q")), POOL)
        return found.select(F.col("query_id").cast(self.questions.schema["id"].dataType).alias("question_id"), "id", "rank")

    @cached_property
    def sub(self) -> graph.Subgraph:
        """The subgraph around linked nodes, or around the lexically best where none is linked."""
        names = self.nodes.select("id", "title") if self.names is None else self.names
        linked = stored(graph.link_entities(self.questions, names), "linked")
        alone = self.questions.join(linked.select(F.col("question_id").alias("id")).distinct(), "id", "left_anti")
        seeds = linked if alone.isEmpty() else graph.with_fallback(linked, retrieval.lexical_seeds(self.index, alone))
        found = graph.traverse(seeds, self.edges, self.questions, self.nodes.select("id", "title"), self.depth, self.beam, self.most)
        return graph.Subgraph(stored(found.nodes, "nodes"), stored(found.edges, "edges"))

    @cached_property
    def graph_context(self) -> DataFrame:
        """(question_id, context) of the subgraph."""
        return stored(graph.linearized(self.sub, self.nodes, self.questions), "contexts")


def _listed(rows: DataFrame, order: str) -> DataFrame:
    """(question_id, ids) in an order."""
    held = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(order, "id"))).alias("all"))
    return held.select("question_id", F.transform("all", lambda x: x["id"]).alias("ids"))


def _shaped(r: Retrieved, condition: str, context: DataFrame | None, ids: DataFrame | None, heading: str) -> DataFrame:
    """(question_id, condition, context, ids, prompt) of every question, empty where nothing was found."""
    out = r.questions.select(F.col("id").alias("question_id"), "text")
    out = out.join(context, "question_id", "left") if context is not None else out.withColumn("context", F.lit(""))
    out = out.join(ids, "question_id", "left") if ids is not None else out.withColumn("ids", F.array().cast("array<string>"))
    text = F.coalesce("context", F.lit(""))
    asked = F.concat(F.lit(QUESTION), "text")
    prompt: Column = asked if context is None else F.concat(F.lit(heading), text, F.lit("\n\n"), asked)
    return out.select("question_id", F.lit(condition).alias("condition"), text.alias("context"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"), prompt.alias("prompt"))


def prepared(r: Retrieved, condition: str, k: int = K, extra: int = EXTRA) -> DataFrame:
    """(question_id, condition, context, ids, prompt) of one condition."""
    if condition == "baseline":
        return _shaped(r, condition, None, None, "")
    if condition in ("vector", "vector_budget"):
        chosen = r.hits.filter(F.col("rank") <= k)
        if condition == "vector_budget":
            length = F.length("title") + F.length(F.coalesce("summary", F.lit("")))
            lengths = r.nodes.select("id", length.alias("chars"))
            budgets = r.graph_context.select("question_id", F.length("context").alias("budget"))
            chosen = retrieval.within_budget(r.hits, lengths, budgets, k)
        return _shaped(r, condition, retrieval.context(chosen, r.nodes), _listed(chosen, "rank"), CONTEXT)
    ids = _listed(r.sub.nodes, "pos")
    if condition == "graph":
        return _shaped(r, condition, r.graph_context, ids, CONTEXT)
    if condition == "graph_no_edges":
        return _shaped(r, condition, graph.excerpts(r.nodes, r.sub.nodes, to="context"), ids, CONTEXT_NODES)
    if condition == "hybrid":
        near = r.hits.filter(F.col("rank") <= k + max(2, extra))
        more = near.join(r.sub.nodes.select("question_id", "id"), ["question_id", "id"], "left_anti").withColumnRenamed("rank", "was")
        more = more.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("was"))).filter(F.col("place") <= extra)
        added = graph.excerpts(r.nodes, more, "place", "added")
        context = r.graph_context.join(added, "question_id", "left").select("question_id", F.concat("context", F.coalesce(F.concat(F.lit(graph.MORE), "added"), F.lit(""))).alias("context"))
        every = ids.join(_listed(more, "place").withColumnRenamed("ids", "extra"), "question_id", "full").select("question_id", F.concat(F.coalesce("ids", F.array().cast("array<string>")), F.coalesce("extra", F.array().cast("array<string>"))).alias("ids"))
        return _shaped(r, condition, context, every, CONTEXT)
    raise ValueError(f"no condition {condition}")


def schedule_of(r: Retrieved, trials: DataFrame, conditions: tuple[str, ...] = CONDITIONS, done: DataFrame | None = None) -> DataFrame:
    """trials (question_id, condition, ...) with context, ids and prompt; those that `done` has (same keys) are left out.

    So a run that was ended goes on with what is missing.
    """
    plans = None
    for condition in conditions:
        made = prepared(r, condition)
        plans = made if plans is None else plans.union(made)
    keys = [c for c in trials.columns if done is not None and c in done.columns]
    left = trials if done is None else trials.join(done.select(*keys).distinct(), keys, "left_anti")
    return left.join(plans, ["question_id", "condition"])
