"""Queries over the typed graph of the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korrel.operators import graph as g
from korrel.operators import merge as m
from korrel.operators import planner, schedule, scoring, trials
from korrel.operators.embeddings import Model, character_shares
from korrel.plans.scratch import scratch_path
from korrel.queries import sql as s
from korrel.sources import bindings as b

_G = f"WITH edges AS ({b.EDGES_SQL}), names AS ({b.NAMES_SQL})"
_PROV = "array<struct<sourceId:string,importScopeId:string,sourceKind:string,method:string,confidence:string,evidence:string,page:int,pageEnd:int,section:int,charStart:int,charEnd:int,revisionId:bigint,targetTitle:string,score:double,threshold:double,sharedTerms:array<string>,contentFingerprint:string>>"
_REST = [("page", "int"), ("pageEnd", "int"), ("section", "int"), ("charStart", "int"), ("charEnd", "int"), ("revisionId", "bigint"), ("targetTitle", "string"), ("score", "double"), ("threshold", "double"), ("sharedTerms", "array<string>"), ("contentFingerprint", "string")]


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return b.entity_names(spark, d).filter("type in ('institution', 'place')")


def _even(ids: DataFrame) -> DataFrame:
    """A third of the nodes as one import, by the length of their titles."""
    return ids.filter(F.length("title") % 3 == 0)


def with_provenance(edges: DataFrame) -> DataFrame:
    """Edges with entries that follow from their relation and target."""
    entry = lambda kind, conf: F.struct(F.concat(F.lit("src:"), "relation").alias("sourceId"), F.concat(F.lit("scope:"), "relation").alias("importScopeId"), F.lit(kind).alias("sourceKind"), F.lit("explicit").alias("method"), F.lit(conf).alias("confidence"), F.col("label").alias("evidence"), *[F.lit(None).cast(kind).alias(c) for c, kind in _REST])
    some = F.when(F.length("target") % 2 == 0, F.array(entry("wikipedia", "verified"), entry("pdf", "heuristic"))).when(F.length("source") % 2 == 0, F.array(entry("pdf", "heuristic"))).otherwise(F.array().cast(_PROV))
    return edges.withColumn("provenance", some.cast(_PROV))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Every edge from both ends."""
    return g.adjacency(b.edges(spark, d))


def degree(spark: SparkSession, d: str) -> DataFrame:
    """Degree of every node."""
    return g.degree(b.edges(spark, d))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of nodes and edges by kind."""
    return g.graph_stats(b.entity_names(spark, d), b.edges(spark, d))


def khop_paths(spark: SparkSession, d: str) -> DataFrame:
    """Two-hop simple paths from every region and nation, over all edges."""
    return g.paths(b.edges(spark, d), b.entity_names(spark, d).filter("type = 'place'").select(F.col("id").alias("node")), 2)


def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Edges among suppliers and places."""
    names = _suppliers(spark, d)
    return g.induced(names, b.edges(spark, d), names.select("id"))[1]


def bridge_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that leave an import."""
    return g.bridges(b.edges(spark, d), _even(b.entity_names(spark, d)))


def touching_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that touch an import."""
    return g.touching(b.edges(spark, d), _even(b.entity_names(spark, d)))


def counterfactual(spark: SparkSession, d: str) -> DataFrame:
    """The graph without one edge."""
    return g.without_edge(b.edges(spark, d), "n0", "teil_von", "r0")


def incident_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of one nation."""
    return g.incident(b.edges(spark, d), "n1")


def privacy_filter(spark: SparkSession, d: str) -> DataFrame:
    """Public edges and how many entries each keeps."""
    nodes = b.entity_names(spark, d).withColumn("community", F.when(F.length("title") % 5 == 0, "custom").otherwise("base"))
    return g.without_private(nodes, with_provenance(b.edges(spark, d)))[1].select("source", "relation", "target", F.size("provenance").cast("long").alias("n_entries"))


def visible_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges without heuristic entries."""
    return g.visible(with_provenance(b.edges(spark, d)), False, True).select("source", "relation", "target")


def interval_filter(spark: SparkSession, d: str) -> DataFrame:
    """Customers whose years of orders hold 1995, or who have none."""
    years = b.table(spark, d, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id")).agg(F.min(F.year("o_orderdate")).alias("y0"), F.max(F.year("o_orderdate")).alias("y1"))
    people = b.entity_names(spark, d).filter("type = 'person'").select("id", "title", F.lit("x").alias("community"), F.lit("").alias("summary"))
    return g.highlighted(people, years, "x", "customer", 1995)


def source_relations(spark: SparkSession, d: str) -> DataFrame:
    """Every edge as a line of titles."""
    return g.lookup_titles(b.edges(spark, d), b.entity_names(spark, d))


def name_index(spark: SparkSession, d: str) -> DataFrame:
    """Normalised names and how many nodes own each."""
    return g.name_index(b.entity_names(spark, d))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """A question about every nation and its region."""
    t = b.table(spark, d, "nation").join(b.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Was liefert "), "n_name", F.lit(" nach "), "r_name", F.lit("?")).alias("text"))


def _summarised(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with a text: their kind and name."""
    return b.entity_names(spark, d).withColumn("summary", F.concat("type", F.lit(" mit dem Namen "), "title"))


def link_entities(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that every question names."""
    return g.link_entities(_questions(spark, d), b.entity_names(spark, d))


def _subgraph(spark: SparkSession, d: str) -> g.Subgraph:
    q, names = _questions(spark, d), b.entity_names(spark, d)
    return g.traverse(g.link_entities(q, names), b.edges(spark, d), q, names)


def beam_traverse(spark: SparkSession, d: str) -> DataFrame:
    """The scored subgraph of every question."""
    return _subgraph(spark, d).edges


def subgraph_context(spark: SparkSession, d: str) -> DataFrame:
    """The same as text, with excerpts."""
    return g.linearized(_subgraph(spark, d), _summarised(spark, d), _questions(spark, d))


def _planned(condition: str, model: Model | None = None):
    def planned(spark: SparkSession, d: str) -> DataFrame:
        """Contexts and prompts of every question under one condition."""
        r = planner.Retrieved(_questions(spark, d), _summarised(spark, d), b.edges(spark, d), model=model)
        made = planner.prepared(r, condition)
        return made.select("question_id", "condition", F.array_join("ids", ",").alias("ids"), F.length("context").cast("long").alias("n_chars"), F.sha2("prompt", 256).alias("prompt_sha256"))

    return planned


def trial_run(spark: SparkSession, d: str) -> DataFrame:
    """Scheduled trials of every question, without those of the first repetition, which are done."""
    q = _questions(spark, d)
    trials = schedule.schedule(q.select(F.col("id").alias("question")), spark.createDataFrame([(c,) for c in planner.CONDITIONS], "condition string"), 2, 20260616)
    trials = trials.withColumnRenamed("question", "question_id")
    r = planner.Retrieved(q, _summarised(spark, d), b.edges(spark, d))
    done = trials.filter("repetition = 1").select("repetition", "question_id", "condition")
    return planner.schedule_of(r, trials, done=done).select("repetition", "question_id", "condition", F.length("prompt").cast("long").alias("n_chars"))


def _opening(prompt: str) -> str:
    """An engine that says the opening of its context, and fails without one."""
    heading, _, rest = prompt.partition("\n")
    if not heading.startswith("KONTEXT"):
        raise ValueError("no context")
    return rest[:200]


def trial_results(spark: SparkSession, d: str) -> DataFrame:
    """Every question under every condition, run and scored; the trials without context fail alone."""
    q = _questions(spark, d)
    r = planner.Retrieved(q, _summarised(spark, d), b.edges(spark, d))
    plans = [planner.prepared(r, c) for c in planner.CONDITIONS]
    planned = reduce(DataFrame.union, plans).select(F.lit("run").alias("run_id"), F.lit(1).alias("repetition"), "question_id", "condition", "ids", "context", "prompt")
    name = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("question_id"), F.array("n_name").alias("must"), F.lit(None).cast("array<string>").alias("any_of"), F.lit(False).alias("abstain"), F.array(F.concat(F.lit("n"), "n_nationkey")).alias("gold"))
    folder = scratch_path(spark, "trials")
    trials.executed(planned, name, _opening, "opening", folder)
    made = trials.results(spark, folder)
    return made.select("repetition", "question_id", "condition", F.length("answer").alias("answer_chars"), "context_chars", "auto_score", "recall", F.round("precision", 6).alias("precision"))


def merge_delta(spark: SparkSession, d: str) -> DataFrame:
    """What an import changes about nodes."""
    names = b.entity_names(spark, d)
    base, old = names.filter("type = 'place'"), names.filter("type = 'person'")
    new = names.withColumn("title", F.when(F.length("title") % 2 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return m.node_delta(old, new, base, ["title", "type"])


def edge_delta(spark: SparkSession, d: str) -> DataFrame:
    """What an import changes about edges, counted."""
    edges = with_provenance(b.edges(spark, d))
    names = b.entity_names(spark, d).filter("type <> 'work' or length(title) % 2 = 0")
    made = m.edge_delta(edges.filter(F.length("source") % 2 == 0), edges, names.select("id"))
    return made.groupBy("relation", "change").agg(F.count("*").alias("n"))


def scope_delete(spark: SparkSession, d: str) -> DataFrame:
    """Edges that stay when one scope is withdrawn."""
    return m.without_scope(with_provenance(b.edges(spark, d)), "scope:liefert").select("source", "relation", "target")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Edges that stay when an import's nodes are removed."""
    names = b.entity_names(spark, d)
    return m.removed(names, b.edges(spark, d), _even(names))[1]


def evidence_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall and precision of each supplier's parts against those of the even order lines."""
    lines = b.table(spark, d, "lineitem")
    of = lambda df, name: df.groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_partkey")).alias(name))
    both = of(lines, "retrieved").join(of(lines.filter("l_linenumber % 2 = 0"), "gold"), "l_suppkey", "left")
    recall, precision = scoring.evidence(F.col("gold"), F.col("retrieved"))
    return both.select("l_suppkey", F.round(recall, 6).alias("recall"), F.round(precision, 6).alias("precision"))


_P = "CASE WHEN length(target) % 2 = 0 THEN 2 WHEN length(source) % 2 = 0 THEN 1 ELSE 0 END"
_EVEN = "SELECT id FROM names WHERE length(title) % 3 = 0"
_ASK = "SELECT n_nationkey AS question_id, 'Was liefert ' || n_name || ' nach ' || r_name || '?' AS text FROM nation JOIN region ON n_regionkey = r_regionkey"
_LINKED = s.linked(b.NAMES_SQL, _ASK)
_SUB = f"{_LINKED}, seeds AS (SELECT * FROM linked), {s.subgraph(b.EDGES_SQL, b.NAMES_SQL, _ASK)}"
_NODES = f"SELECT *, type || ' mit dem Namen ' || title AS summary FROM ({b.NAMES_SQL})"
_TEXT = f"""lines AS (SELECT question_id, string_agg('• ' || a.title || ' — ' || label || ' → ' || z.title, chr(10) ORDER BY step) AS x FROM subedges JOIN ({_NODES}) a ON a.id = source JOIN ({_NODES}) z ON z.id = target GROUP BY question_id),
cuts AS (SELECT question_id, string_agg('[' || title || '] ' || summary, chr(10) || chr(10) ORDER BY pos) AS x FROM subnodes JOIN ({_NODES}) USING (id) GROUP BY question_id),
graphtext AS (SELECT question_id, CASE WHEN l.x IS NULL THEN '' ELSE 'BEZIEHUNGEN (Wissensgraph):' || chr(10) || l.x || chr(10) || chr(10) END || 'ARTIKEL-AUSZÜGE:' || chr(10) || coalesce(c.x, '') AS context FROM ({_ASK}) LEFT JOIN lines l USING (question_id) LEFT JOIN cuts c USING (question_id))"""
_VECTOR = "SELECT question_id, string_agg('[' || rank || '] ' || title || chr(10) || summary, chr(10) || chr(10) ORDER BY rank) AS context, string_agg(id, ',' ORDER BY rank) AS ids FROM {} JOIN nodes USING (id) GROUP BY question_id"
_PLANS = f"""{_SUB}, {_TEXT}, {s.tfidf(_NODES, _ASK)},
run AS (SELECT question_id, id, rank, sum(length(title) + length(summary) + 4 + length(CAST(rank AS VARCHAR))) OVER (PARTITION BY question_id ORDER BY rank) + 2 * (rank - 1) AS len, length(context) AS budget FROM ranked JOIN nodes USING (id) JOIN graphtext USING (question_id) WHERE rank <= 16),
budgeted AS (SELECT question_id, id, rank FROM (SELECT *, min(CASE WHEN len >= budget AND rank >= 4 THEN rank END) OVER (PARTITION BY question_id) AS stop FROM run) WHERE stop IS NULL OR rank <= stop),
more AS (SELECT question_id, id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS k FROM ranked WHERE rank <= 7 AND (question_id, id) NOT IN (SELECT (question_id, id) FROM subnodes) QUALIFY k <= 3),
moretext AS (SELECT question_id, chr(10) || chr(10) || 'ZUSÄTZLICHE ARTIKEL (Ähnlichkeitssuche):' || chr(10) || string_agg('[' || title || '] ' || summary, chr(10) || chr(10) ORDER BY k) AS x, ',' || string_agg(id, ',' ORDER BY k) AS ids FROM more JOIN nodes USING (id) GROUP BY question_id),
subids AS (SELECT question_id, string_agg(id, ',' ORDER BY pos) AS ids FROM subnodes GROUP BY question_id)"""
_CONTEXTS = {
    "vector": _VECTOR.format("(SELECT * FROM ranked WHERE rank <= 4)"), "vector_budget": _VECTOR.format("budgeted"),
    "graph": "SELECT question_id, context, ids FROM graphtext LEFT JOIN subids USING (question_id)", "graph_no_edges": "SELECT question_id, x AS context, ids FROM cuts LEFT JOIN subids USING (question_id)",
    "hybrid": "SELECT question_id, context || coalesce(m.x, '') AS context, coalesce(i.ids, '') || coalesce(m.ids, '') AS ids FROM graphtext LEFT JOIN subids i USING (question_id) LEFT JOIN moretext m USING (question_id)",
}
_HEADS = {"graph_no_edges": "KONTEXT (KNOTEN OHNE RELATIONEN):"}
_PLAN = {c: f"SELECT q.question_id, coalesce(ids, '') AS ids, coalesce(context, '') AS context, '{_HEADS.get(c, 'KONTEXT:')}' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'FRAGE: ' || text AS prompt FROM ({_ASK}) q LEFT JOIN ({x}) USING (question_id)" for c, x in _CONTEXTS.items()}
_PLAN["baseline"] = f"SELECT question_id, '' AS ids, '' AS context, 'FRAGE: ' || text AS prompt FROM ({_ASK})"


# Shares of characters instead of terms.
_SHARES = lambda x: "[" + ", ".join(f"length({x}) - length(replace({x}, '{c}', ''))" for c in "abcdefghijklmnopqrstuvwxyz0123456789") + "]"
_DENSE = f"""nodes AS ({_NODES}), shares AS MATERIALIZED (SELECT 'n' AS side, id, {_SHARES("x")} AS c FROM (SELECT id, lower(title || '. ' || summary) AS x FROM nodes) UNION ALL SELECT 'q', CAST(question_id AS VARCHAR), {_SHARES("x")} FROM (SELECT question_id, lower(text) AS x FROM ({_ASK}))),
vectors AS MATERIALIZED (SELECT side, id, [y / sqrt(list_sum([z * z FOR z IN c])) FOR y IN c] AS v FROM shares), ranked AS MATERIALIZED (SELECT CAST(q.id AS INTEGER) AS question_id, n.id, round(list_dot_product(q.v, n.v), 6) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v, n.v), 6) DESC, n.id) AS rank FROM vectors q, vectors n WHERE q.side = 'q' AND n.side = 'n')"""


def _plan_sql(condition: str, dense: bool = False) -> str:
    if dense:
        return _plan_sql(condition).replace(s.tfidf(_NODES, _ASK), _DENSE)
    return f"WITH {_PLANS} SELECT question_id, '{condition}' AS condition, ids, length(context) AS n_chars, sha256(prompt) AS prompt_sha256 FROM ({_PLAN[condition]})"


QUERIES = {
    "adjacency": (adjacency, f"{_G} SELECT source AS node, target AS other, 'out' AS direction, relation, label FROM edges UNION ALL SELECT target, source, 'in', relation, label FROM edges"),
    "degree": (degree, f"{_G} SELECT node, count(*) AS degree FROM (SELECT source AS node FROM edges UNION ALL SELECT target FROM edges WHERE source <> target) GROUP BY node"),
    "graph_stats": (graph_stats, f"{_G} SELECT 'node:' || type AS kind, count(*) AS n FROM names GROUP BY ALL UNION ALL SELECT 'edge:' || relation, count(*) FROM edges GROUP BY ALL"),
    "khop_paths": (khop_paths, f"{_G}, s AS MATERIALIZED (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), x AS MATERIALIZED (SELECT a, b FROM s JOIN (SELECT DISTINCT id FROM names WHERE type = 'place') ON a = id) SELECT x.a AS start, x.a || '>' || x.b || '>' || y.b AS path FROM x JOIN s y ON x.b = y.a WHERE y.b <> x.a"),
    "induced_subgraph": (induced_subgraph, f"{_G}, k AS (SELECT id FROM names WHERE type IN ('institution', 'place')) SELECT * FROM edges WHERE source IN (FROM k) AND target IN (FROM k)"),
    "bridge_edges": (bridge_edges, f"{_G}, k AS ({_EVEN}) SELECT * FROM edges WHERE (source IN (FROM k)) <> (target IN (FROM k))"),
    "touching_edges": (touching_edges, f"{_G}, k AS ({_EVEN}) SELECT * FROM edges WHERE source IN (FROM k) OR target IN (FROM k)"),
    "counterfactual": (counterfactual, f"{_G} SELECT * FROM edges WHERE NOT (source = 'n0' AND relation = 'teil_von' AND target = 'r0')"),
    "incident_edges": (incident_edges, f"{_G} SELECT * FROM edges WHERE source = 'n1' OR target = 'n1'"),
    "privacy_filter": (privacy_filter, f"{_G}, k AS (SELECT id FROM names WHERE length(title) % 5 <> 0), p AS (SELECT *, {_P} AS c FROM edges WHERE source IN (FROM k) AND target IN (FROM k)) SELECT source, relation, target, CASE WHEN c = 2 THEN 1 ELSE 0 END::BIGINT AS n_entries FROM p WHERE c <> 1"),
    "visible_edges": (visible_edges, f"{_G} SELECT source, relation, target FROM edges WHERE ({_P}) = 0"),
    "interval_filter": (interval_filter, "SELECT 'c' || c_custkey AS id FROM customer LEFT JOIN (SELECT o_custkey, min(year(o_orderdate)) AS y0, max(year(o_orderdate)) AS y1 FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE contains(lower(c_name), 'customer') AND (y0 IS NULL OR 1995 BETWEEN y0 AND y1)"),
    "source_relations": (source_relations, f"{_G} SELECT source, relation, target, coalesce(a.title, source) || ' — ' || label || ' → ' || coalesce(b.title, target) AS line FROM edges LEFT JOIN names a ON a.id = source LEFT JOIN names b ON b.id = target"),
    "name_index": (name_index, f"WITH names AS ({b.NAMES_SQL}), k AS (SELECT DISTINCT id, trim(regexp_replace(strip_accents(replace(lower(title), 'ß', 'ss')), '\\s+', ' ', 'g')) AS key FROM names) SELECT id, key, count(*) OVER (PARTITION BY key) AS owners FROM k WHERE key <> ''"),
    "link_entities": (link_entities, f"WITH {_LINKED} SELECT question_id, id, pos FROM linked"),
    "beam_traverse": (beam_traverse, f"WITH {_SUB} SELECT * FROM subedges"),
    "subgraph_context": (subgraph_context, f"WITH {_SUB}, {_TEXT} SELECT question_id, context FROM graphtext"),
    **{f"plan_{c}": (_planned(c), _plan_sql(c)) for c in planner.CONDITIONS},
    **{f"plan_{c}_dense": (_planned(c, Model("character shares", character_shares)), _plan_sql(c, True)) for c in ("vector", "hybrid")},
    "trial_results": (trial_results, f"WITH {_PLANS}, p AS (" + " UNION ALL ".join(f"SELECT question_id, '{c}' AS condition, context, ids, prompt FROM ({_PLAN[c]})" for c in planner.CONDITIONS if c != "baseline") + f"), a AS (SELECT p.*, n_name, substring(prompt, instr(prompt, chr(10)) + 1, 200) AS answer, [x FOR x IN string_split(ids, ',') IF x <> ''] AS got, 'n' || question_id AS gold FROM p JOIN nation ON n_nationkey = question_id) SELECT 1 AS repetition, question_id, condition, length(answer) AS answer_chars, length(context) AS context_chars, CASE WHEN contains({s.normalize('answer')}, {s.normalize('n_name')}) THEN 'korrekt' ELSE 'falsch' END AS auto_score, CASE WHEN list_contains(got, gold) THEN 1.0 ELSE 0.0 END::DOUBLE AS recall, CASE WHEN len(got) > 0 THEN round(CASE WHEN list_contains(got, gold) THEN 1.0 ELSE 0.0 END::DOUBLE / len(got), 6) END AS precision FROM a"),
    "trial_run": (trial_run, f"WITH {_PLANS} SELECT 2 AS repetition, question_id, condition, length(prompt) AS n_chars FROM (" + " UNION ALL ".join(f"SELECT question_id, '{c}' AS condition, prompt FROM ({_PLAN[c]})" for c in planner.CONDITIONS) + ")"),
    "merge_delta": (merge_delta, f"{_G}, n AS (SELECT id, type, length(title) % 2 = 0 AS changed FROM names) SELECT id, CASE WHEN type = 'place' THEN 'rejected' WHEN type <> 'person' THEN 'added' WHEN changed THEN 'updated' ELSE 'unchanged' END AS change FROM n"),
    "edge_delta": (edge_delta, f"{_G}, k AS (SELECT id FROM names WHERE type <> 'work' OR length(title) % 2 = 0), c AS (SELECT relation, CASE WHEN source NOT IN (FROM k) OR target NOT IN (FROM k) OR ({_P}) = 0 THEN 'skipped' WHEN length(source) % 2 <> 0 THEN 'added' ELSE 'unchanged' END AS change FROM edges) SELECT relation, change, count(*) AS n FROM c GROUP BY ALL"),
    "scope_delete": (scope_delete, f"{_G} SELECT source, relation, target FROM edges WHERE relation <> 'liefert' AND ({_P}) > 0"),
    "cascade_delete": (cascade_delete, f"{_G}, k AS ({_EVEN}) SELECT * FROM edges WHERE source NOT IN (FROM k) AND target NOT IN (FROM k)"),
    "evidence_recall": (evidence_recall, "WITH r AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS r, count(DISTINCT l_partkey) FILTER (l_linenumber % 2 = 0) AS g FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, CASE WHEN g > 0 THEN 1.0::DOUBLE END AS recall, CASE WHEN g > 0 THEN round(g / r, 6) END AS precision FROM r"),
}
