"""Graph reads: adjacency, neighbourhoods, subgraphs, filters, entity linking, scored traversal."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.functions import text as t
from korrel.operators.retrieval import top
from korrel.plans.scratch import stored
from korrel.plans.spread import PORTION


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, other, direction, relation, label): every edge once from each of its ends."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), F.lit("out").alias("direction"), "relation", "label")
    return out.union(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), F.lit("in").alias("direction"), "relation", "label"))


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree): incident edges; a loop counts once."""
    return adjacency(edges).filter("direction = 'out' or node <> other").groupBy("node").agg(F.count("*").alias("degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, n): nodes by type and edges by relation."""
    return nodes.groupBy(F.concat(F.lit("node:"), "type").alias("kind")).agg(F.count("*").alias("n")).union(edges.groupBy(F.concat(F.lit("edge:"), "relation").alias("kind")).agg(F.count("*").alias("n")))


#: Edges of one node that a task joins to paths, and paths whose ends are looked up among the edges before these are dealt.
PART, FEW = 1 << 16, 1 << 16


def paths(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, path): simple paths of so many hops from starts (node), over edges in either direction.

    Edges are stored with their ends only, and dealt by node in portions, those of a hub in parts of about PART; a path
    that comes to a hub meets all its parts. So what a task holds does not grow with the edges.
    """
    ends = stored(edges.select("source", "target"), "ends")
    both = ends.select(F.col("source").alias("node"), F.col("target").alias("other")).union(ends.select("target", "source"))
    found = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("path"))
    for _ in range(hops):
        found, near = stored(found, "paths"), both
        n = found.count()
        if n <= FEW:
            near = stored(both.join(F.broadcast(found.select(F.col("at").alias("node"))), "node", "left_semi"), "near")
        tasks = max(1, -(-max(n, near.count()) // PORTION))
        parts = stored(near.groupBy("node").agg(F.ceil(F.count("*") / PART).alias("parts")).filter("parts > 1"), "parts")
        cut = F.pmod(F.xxhash64("other"), F.coalesce("parts", F.lit(1))).alias("cut")
        step = near.join(parts, "node", "left").select("node", cut, "other").repartition(tasks, "node", "cut").distinct()
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("cut")
        come = found.join(parts.withColumnRenamed("node", "at"), "at", "left").select("start", "path", F.col("at").alias("node"), each)
        met = come.repartition(tasks, "node", "cut").join(step, ["node", "cut"]).filter(~F.array_contains("path", F.col("other")))
        found = met.select("start", F.col("other").alias("at"), F.concat("path", F.array("other")).alias("path"))
    return found.select("start", F.array_join("path", ">").alias("path"))


def induced(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of ids (id) and the edges with both ends among them."""
    one, two = ids.select(F.col("id").alias("source")).distinct(), ids.select(F.col("id").alias("target")).distinct()
    return nodes.join(ids.select("id").distinct(), "id", "left_semi"), edges.join(one, "source", "left_semi").join(two, "target", "left_semi").select(edges.columns)


def bridges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with exactly one end in ids (id)."""
    own = ids.select("id").distinct()
    a, b = own.select(F.col("id").alias("source"), F.lit(True).alias("in_s")), own.select(F.col("id").alias("target"), F.lit(True).alias("in_t"))
    flagged = edges.join(a, "source", "left").join(b, "target", "left")
    return flagged.filter(F.coalesce("in_s", F.lit(False)) != F.coalesce("in_t", F.lit(False))).select(edges.columns)


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with at least one end in ids (id)."""
    own = ids.select("id").distinct()
    a, b = own.select(F.col("id").alias("source"), F.lit(True).alias("in_s")), own.select(F.col("id").alias("target"), F.lit(True).alias("in_t"))
    return edges.join(a, "source", "left").join(b, "target", "left").filter("in_s or in_t").select(edges.columns)


def without_edge(edges: DataFrame, source: str, relation: str, target: str) -> DataFrame:
    """All edges but that of one key."""
    return edges.filter(~((F.col("source") == source) & (F.col("relation") == relation) & (F.col("target") == target)))


def incident(edges: DataFrame, node: str) -> DataFrame:
    """Edges that begin or end at a node."""
    return edges.filter((F.col("source") == node) | (F.col("target") == node))


def is_private(provenance: Column) -> Column:
    """Whether any entry comes from a manual text, a PDF or a local model."""
    return F.exists(provenance, lambda p: p["sourceKind"].isin("manual-text", "pdf", "local-llm"))


def without_private(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes outside community custom and edges between them, without private entries; edges left without any go."""
    public = nodes.filter("community is null or community <> 'custom'")
    _, between = induced(public, edges, public.select("id"))
    had = F.coalesce(F.size("provenance"), F.lit(0)) > 0
    left = F.filter("provenance", lambda p: ~p["sourceKind"].isin("manual-text", "pdf", "local-llm"))
    cleaned = between.withColumns({"had": had, "provenance": left}).filter(~F.col("had") | (F.size("provenance") > 0)).drop("had")
    return public, cleaned


def visible(edges: DataFrame, heuristic: bool, links: bool, link_relation: str = "verlinkt_auf") -> DataFrame:
    """Edges of the chosen layers: with heuristic entries, and of the link relation."""
    out = edges
    if not heuristic:
        out = out.filter(~F.exists(F.coalesce("provenance", F.array().cast(edges.schema["provenance"].dataType)), lambda p: p["confidence"] == "heuristic"))
    return out if links else out.filter(F.col("relation") != link_relation)


def highlighted(nodes: DataFrame, years: DataFrame, community: str | None, query: str | None, year: int | None) -> DataFrame:
    """Ids of nodes by community, text and year; nodes without an interval pass every year."""
    out = nodes.join(years, "id", "left")
    if community is not None:
        out = out.filter(F.col("community") == community)
    if query:
        out = out.filter(F.lower("title").contains(query.lower()) | F.lower("summary").contains(query.lower()))
    if year is not None:
        out = out.filter(F.col("y0").isNull() | F.lit(year).between(F.col("y0"), F.col("y1")))
    return out.select("id")


def name_index(names: DataFrame) -> DataFrame:
    """(key, id): normalised names of nodes (id, title), with the number of nodes that share each."""
    keyed = names.select("id", t.compact(t.normalize(F.col("title"))).alias("key")).filter("key <> ''").distinct()
    return keyed.join(keyed.groupBy("key").agg(F.count("*").alias("owners")), "key")


def lookup_titles(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(line): "source — label → target" by titles, ids where there is none."""
    s, g = names.select(F.col("id").alias("source"), F.col("title").alias("s_title")), names.select(F.col("id").alias("target"), F.col("title").alias("t_title"))
    joined = edges.join(s, "source", "left").join(g, "target", "left")
    return joined.select("source", "relation", "target", F.concat(F.coalesce("s_title", "source"), F.lit(" — "), "label", F.lit(" → "), F.coalesce("t_title", "target")).alias("line"))


def aliased(nodes: DataFrame) -> DataFrame:
    """(id, title) of nodes (id, title, aliases): a row for the title and one for each alias."""
    every = F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    return nodes.select("id", F.explode(every).alias("title"))


def link_entities(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, id, pos): nodes whose name (id, title; several rows for aliases) a question holds as whole words.

    Longest names first, each stretch of the question once, in that order from 0; of a name only the first occurrence
    counts. The question's word runs, of the lengths that names have, are joined to the names, so no question is
    compared with every name; what lies in an accepted longer name is dropped in a fold over one question's hits.
    """
    keyed = names.select("id", F.trim(F.regexp_replace(t.normalize(F.col("title")), "[^a-z0-9#]+", " ")).alias("key"))
    plain = stored(keyed.filter("key <> ''").groupBy("key").agg(F.min("id").alias("id")), "keys")  # names are folded once
    lengths = plain.agg(F.collect_set(F.size(F.split("key", " "))).alias("lengths"))  # one row: the word counts that occur
    folded = questions.select(F.col("id").alias("question_id"), F.filter(F.split(t.normalize(F.col("text")), "[^a-z0-9#]+"), lambda w: w != "").alias("words")).filter("size(words) > 0")
    each = folded.crossJoin(F.broadcast(lengths)).select("question_id", "words", "lengths", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("at"))
    runs = each.select("question_id", "words", "at", F.explode("lengths").alias("n")).filter(F.col("at") + F.col("n") <= F.size("words") + 1)
    hits = runs.select("question_id", "at", "n", F.array_join(F.slice("words", F.col("at"), F.col("n")), " ").alias("key")).join(plain, "key")
    first = hits.groupBy("question_id", "key", "id").agg(F.min("at").alias("at"), F.first("n").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.length("key")).alias("k"), "id", "at", "n")))

    def accept(state: Column, x: Column) -> Column:
        clear = ~F.exists(state, lambda y: (x["at"] < y["at"] + y["n"]) & (y["at"] < x["at"] + x["n"]))
        return F.when(clear, F.concat(state, F.array(x))).otherwise(state)

    none = F.array().cast("array<struct<k:int,id:string,at:int,n:int>>")
    found = first.groupBy("question_id").agg(F.aggregate(ordered, none, accept).alias("hits")).select("question_id", F.posexplode("hits").alias("pos", "h"))
    return found.groupBy("question_id", F.col("h.id").alias("id")).agg(F.min("pos").alias("pos"))


def with_fallback(linked: DataFrame, best: DataFrame) -> DataFrame:
    """Seeds (question_id, id, pos): linked ones, and for questions without any the lexically best (question_id, id, rank)."""
    alone = best.join(linked.select("question_id").distinct(), "question_id", "left_anti")
    return linked.select("question_id", "id", "pos").union(alone.select("question_id", "id", (F.col("rank") - 1).alias("pos")))


@dataclass
class Subgraph:
    """Per question: nodes (question_id, id, level, pos) and edges (question_id, step, source, relation, target, label, level)."""

    nodes: DataFrame
    edges: DataFrame


def _around(frontier: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """(node, other, source, relation, target, label, own, far): edges at nodes of frontier (node), stored, with stems of
    their kind (own) and of the far title (far); these are made once per title and per kind, not once per edge."""
    near = stored(adjacency(edges).join(frontier.select("node"), "node", "left_semi"), "near")
    tasks = max(near.sparkSession.sparkContext.defaultParallelism, -(-near.count() // PORTION))
    kinds = stored(near.select("label", "relation").distinct().withColumn("own", F.array_distinct(t.terms(F.concat_ws(" ", "label", "relation")))), "kinds")
    titles = names.select(F.col("id").alias("other"), "title").join(near.select("other").distinct(), "other", "left_semi").repartition(tasks, "other")
    titles = stored(titles.select("other", F.array_distinct(t.terms("title")).alias("far")), "titles")
    out = F.col("direction") == "out"
    ends = near.join(kinds, ["label", "relation"]).join(titles, "other").repartition(tasks, "node", "other")
    return stored(ends.select("node", "other", F.when(out, F.col("node")).otherwise(F.col("other")).alias("source"), "relation", F.when(out, F.col("other")).otherwise(F.col("node")).alias("target"), "label", "own", "far"), "around")


def traverse(seeds: DataFrame, edges: DataFrame, questions: DataFrame, names: DataFrame, depth: int = 3, beam: int = 4, most: int = 14) -> Subgraph:
    """The subgraph of a scored beam search from seeds (question_id, id, pos), which have level -1.

    A candidate edge scores a point per question term in its relation, label and far title, two where the far node was
    in the subgraph at the level's start, and half a point at the first level; ties go by source, relation, target.
    A level takes the `beam` new nodes with the best edges, and every edge to these and to known nodes, best first,
    up to the edge that brings in the last node that `most` allows. All levels are joins and aggregations by question
    and node: what a hub adds is reduced to one row per node before nodes are ranked. Of the edges, a level reads those
    at its own nodes; the others are never moved.
    """
    asked = stored(questions.select(F.col("id").alias("question_id"), F.array_distinct(t.terms("text")).alias("wanted")), "asked")
    inside = stored(seeds.select("question_id", "id", F.lit(-1).alias("level"), F.struct(F.col("pos").cast("double").alias("s"), F.lit("").alias("source"), F.lit("").alias("relation"), F.lit("").alias("target"), F.lit("").alias("node"), F.lit("").alias("label")).alias("key")), "inside")
    taken = None
    for level in range(depth):
        sizes = inside.groupBy("question_id").agg(F.count("*").alias("n")).filter(F.col("n") < most)
        frontier = stored(inside.filter(F.col("level") == level - 1).select("question_id", F.col("id").alias("node")).join(sizes, "question_id"), "frontier")
        around = _around(frontier, edges, names)
        rows = frontier.join(around.groupBy("node").agg(F.count("*").alias("k")), "node").agg(F.sum("k").alias("k")).first()["k"] or 0
        known = inside.select("question_id", F.col("id").alias("other"), F.lit(True).alias("known"))
        near = frontier.join(around, "node").join(known, ["question_id", "other"], "left").join(asked, "question_id")
        score = F.size(F.array_intersect("wanted", F.array_union("own", "far"))) + F.when(F.col("known"), 2.0).otherwise(0.0) + (0.5 if level == 0 else 0.0)
        options = near.select("question_id", "other", "n", "known", F.struct((-score).alias("s"), "source", "relation", "target", "node", "label").alias("key")).repartition(max(1, -(-rows // PORTION)), "question_id", "other")
        best = options.filter("known is null").groupBy("question_id", "other").agg(F.min("key").alias("key"), F.first("n").alias("n"))
        chosen = stored(top(best, "question_id", [F.asc("key")], beam).filter(F.col("rank") <= most - F.col("n")), "chosen")
        last = chosen.groupBy("question_id").agg(F.when(F.first("n") + F.count("*") >= most, F.max("key")).alias("cut"))
        reached = options.join(chosen.select("question_id", "other", F.lit(True).alias("chosen")), ["question_id", "other"], "left").filter("known or chosen")
        reached = reached.join(last, "question_id", "left").filter("cut is null or key <= cut")
        new = reached.groupBy("question_id", "key.source", "key.relation", "key.target").agg(F.min("key").alias("key")).withColumn("level", F.lit(level))
        new = stored(new if taken is None else new.join(taken, ["question_id", "source", "relation", "target"], "left_anti"), "taken")
        taken = new if taken is None else taken.union(new)
        inside = stored(inside.union(chosen.select("question_id", F.col("other").alias("id"), F.lit(level).alias("level"), "key")), "inside")
    place = lambda: (F.row_number().over(Window.partitionBy("question_id").orderBy("level", "key")) - 1).cast("int")  # noqa: E731  a few rows a question
    steps = taken.select("question_id", place().alias("step"), "source", "relation", "target", F.col("key.label").alias("label"), "level")
    return Subgraph(inside.select("question_id", "id", "level", place().alias("pos")), steps)


# Headings and signs of a context.
RELATIONS, EXCERPTS, MORE = "BEZIEHUNGEN (Wissensgraph):\n", "ARTIKEL-AUSZÜGE:\n", "\n\nZUSÄTZLICHE ARTIKEL (Ähnlichkeitssuche):\n"


def ordered_text(rows: DataFrame, order: str, line: Column, gap: str, to: str) -> DataFrame:
    """(question_id, to): lines of each question in order, with a gap between them."""
    held = rows.select("question_id", order, line.alias("line")).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("all"))
    return held.select("question_id", F.array_join(F.transform("all", lambda x: x["line"]), gap).alias(to))


def excerpts(nodes: DataFrame, of: DataFrame, order: str = "pos", to: str = "excerpts") -> DataFrame:
    """(question_id, to): "[title] summary" of the nodes of each question, blank lines between."""
    rows = of.join(nodes.select("id", "title", "summary"), "id")
    return ordered_text(rows, order, F.concat(F.lit("["), "title", F.lit("] "), F.coalesce("summary", F.lit(""))), "\n\n", to)


def linearized(sub: Subgraph, nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, context): relations in the order in which they were taken, where there are any, then excerpts of
    nodes (id, title, summary), seeds first. A question without any node keeps the heading of the excerpts."""
    name = lambda side: nodes.select(F.col("id").alias(side), F.col("title").alias(f"{side}_title"))
    ends = sub.edges.select(F.col("source").alias("id")).union(sub.edges.select(F.col("target").alias("id")))
    nodes = stored(nodes.select("id", "title", "summary").join(ends.union(sub.nodes.select("id")), "id", "left_semi"), "inner")
    lines = sub.edges.join(name("source"), "source", "left").join(name("target"), "target", "left")
    relations = ordered_text(lines, "step", F.concat(F.lit("• "), "source_title", F.lit(" — "), "label", F.lit(" → "), "target_title"), "\n", "relations")
    both = questions.select(F.col("id").alias("question_id")).join(relations, "question_id", "left").join(excerpts(nodes, sub.nodes), "question_id", "left")
    head = F.when(F.col("relations").isNotNull(), F.concat(F.lit(RELATIONS), "relations", F.lit("\n\n"))).otherwise("")
    return both.select("question_id", F.concat(head, F.lit(EXCERPTS), F.coalesce("excerpts", F.lit(""))).alias("context"))
