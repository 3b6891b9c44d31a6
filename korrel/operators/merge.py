"""Provenance-aware union, upsert with exact delta, and deletes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from korrel.functions.text import bound
from korrel.operators.graph import induced
from korrel.plans.scratch import stored

#: Fields that tell one provenance entry from another; null and "" are the same. The kind, the confidence and the time
#: of the import are none of them.
IDENTITY = ("sourceId", "importScopeId", "method", "page", "pageEnd", "section", "charStart", "charEnd", "revisionId", "targetTitle", "score", "threshold", "sharedTerms", "contentFingerprint", "evidence")
KEY = ["source", "relation", "target"]


def provenance_key(p: Column) -> Column:
    """What tells an entry apart, as one string: its fields with NUL between, shared terms with the unit separator."""
    parts = [F.array_join(p[c], "\x1f") if c == "sharedTerms" else p[c].cast("string") for c in IDENTITY]
    return F.concat_ws("\0", *[F.coalesce(x, F.lit("")) for x in parts])


def _valid(p: Column) -> Column:
    """Whether an entry has a source and a method."""
    return (F.coalesce(p["sourceId"], F.lit("")) != "") & (F.coalesce(p["method"], F.lit("")) != "")


def merged_provenance(entries: Column) -> Column:
    """Entries in order without repeats of an identity; those without source or method are dropped. Null counts as none."""

    def first(all_: Column) -> Column:
        keys = F.transform(all_, provenance_key)
        return bound(F.struct(all_.alias("all"), keys.alias("keys")), lambda b: F.filter(b["all"], lambda p, i: F.array_position(b["keys"], F.get(b["keys"], i)) == i + 1))

    return bound(F.filter(entries, _valid), first)


def merged_edges(base: DataFrame, added: DataFrame) -> DataFrame:
    """Edges of both by key: the base's label wins, provenance is united, base first. Loops are left out.

    Entries are reduced to one per edge and identity before they are gathered, so an edge that many imports prove is
    no hot row.
    """
    kind = base.schema["provenance"].dataType
    both = base.withColumn("part", F.lit(0)).unionByName(added.withColumn("part", F.lit(1))).filter("source <> target")
    attributes = both.groupBy(*KEY).agg(F.min(F.struct("part", "label")).alias("first"))
    entries = both.select(*KEY, "part", F.posexplode("provenance").alias("pos", "p")).filter(_valid(F.col("p")))
    once = entries.groupBy(*KEY, provenance_key(F.col("p")).alias("identity")).agg(F.min_by("p", F.struct("part", "pos")).alias("p"), F.min(F.struct("part", "pos")).alias("at"))
    lists = once.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "identity", "p"))).alias("all")).select(*KEY, F.transform("all", lambda x: x["p"]).alias("provenance"))
    return attributes.join(lists, KEY, "left").select(*KEY, F.col("first.label").alias("label"), F.coalesce("provenance", F.array().cast(kind)).alias("provenance"))


def merged_graph(base_nodes: DataFrame, base_edges: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base and user graph: base nodes win by id; edges need both ends."""
    own = nodes.join(base_nodes.select("id"), "id", "left_anti")
    every = base_nodes.unionByName(own)
    _, between = induced(every, merged_edges(base_edges, edges), every.select("id"))
    return every, between


def node_delta(old: DataFrame, new: DataFrame, base: DataFrame, core: list[str]) -> DataFrame:
    """(id, change) of new nodes against old: rejected (an id of the base), added, updated or unchanged."""
    mark = lambda: F.to_json(F.struct(*core))
    was = old.select("id", mark().alias("was"))
    now = new.select("id", mark().alias("now"))
    taken = base.select("id", F.lit(True).alias("taken"))
    change = F.when(F.col("taken"), "rejected").when(F.col("was").isNull(), "added").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("updated")
    return now.join(was, "id", "left").join(taken, "id", "left").select("id", change.alias("change"))


def edge_delta(old: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
    """(key, change) of new edges: skipped (a loop, an unknown end or no provenance), added, updated or unchanged."""
    a, b = known.select(F.col("id").alias("source"), F.lit(True).alias("has_s")), known.select(F.col("id").alias("target"), F.lit(True).alias("has_t"))
    was = old.select(*KEY, F.size("provenance").alias("n_was"), F.col("provenance").alias("p_was"))
    rows = new.join(a, "source", "left").join(b, "target", "left").join(was, KEY, "left")
    bad = F.col("has_s").isNull() | F.col("has_t").isNull() | (F.col("source") == F.col("target")) | (F.coalesce(F.size("provenance"), F.lit(0)) <= 0)
    grown = F.size(merged_provenance(F.concat("p_was", "provenance"))) > F.col("n_was")
    return rows.select(*KEY, F.when(bad, "skipped").when(F.col("p_was").isNull(), "added").when(grown, "updated").otherwise("unchanged").alias("change"))


@dataclass
class Import:
    """The graph after an import, and what it changed: delta has (what, id, source, relation, target, change, reason)."""

    nodes: DataFrame
    edges: DataFrame
    delta: DataFrame


#: What makes a node another one, apart from its provenance.
CORE = ("title", "type", "community", "aliases", "summary")


def _core(row: str) -> Column:
    """A node's own fields as one string; no aliases are the same as an empty list."""
    return F.to_json(F.struct(*[F.coalesce(F.col(f"{row}.aliases"), F.array().cast("array<string>")).alias("aliases") if c == "aliases" else F.col(f"{row}.{c}").alias(c) for c in CORE]), {"ignoreNullFields": "false"})


def _in_scope(scope: str):
    return lambda p: F.coalesce(p["importScopeId"] == scope, F.lit(False)) | F.coalesce(p["sourceId"] == scope, F.lit(False))


def _stripped(rows: DataFrame, scope: str | None) -> DataFrame:
    """rows with what is left of their provenance without the scope, and whether nothing of it is."""
    none = F.array().cast(rows.schema["provenance"].dataType)
    own = F.coalesce("provenance", none)
    if scope is None:
        return rows.withColumns({"left": own, "gone": F.lit(False)})
    mine = _in_scope(scope)
    left = F.filter(own, lambda p: ~mine(p))
    return rows.withColumns({"left": left, "gone": F.exists(own, mine) & (F.size(left) == 0)})


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with an id, a title and a summary, which may be empty."""
    return nodes.filter((F.coalesce("id", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & F.col("summary").isNotNull())


def valid_edges(edges: DataFrame) -> DataFrame:
    """Edges with a source, a target, a relation and a label that are not empty."""
    empty = [F.coalesce(F.col(c), F.lit("")) == "" for c in (*KEY, "label")]
    return edges.filter(~(empty[0] | empty[1] | empty[2] | empty[3]))


def applied(base: DataFrame, nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, scope: str | None = None) -> Import:
    """An import committed as one merge, with its exact delta.

    nodes and edges are the user's, keyed by id and by (source, relation, target); base (id) is the frozen graph. With
    a scope, all its provenance is withdrawn first, and rows that had no other are removed unless they come again. A
    new node is skipped if its id is the base's, or if its kinds of sources share nothing with the ones that the row
    still has; a new edge if it is a loop, an end is unknown or was skipped for its kinds, or it has no provenance. At
    last edges without both ends are removed. Invalid nodes and edges (valid_nodes, valid_edges) are no candidates. All of it are joins by key; nothing is looked up row by row.
    """
    row = lambda df, name: df.select("id", F.struct(*df.columns).alias(name))
    fresh = valid_nodes(new_nodes).select(nodes.columns)
    kinds = lambda p: F.array_distinct(F.transform(F.coalesce(p, F.array().cast(nodes.schema["provenance"].dataType)), lambda x: x["sourceKind"]))
    met = row(_stripped(nodes, scope), "o").join(row(fresh, "c"), "id", "full").join(base.select("id", F.lit(True).alias("based")).distinct(), "id", "left")
    was, now, left = F.col("o.id").isNotNull(), F.col("c.id").isNotNull(), F.coalesce("o.left", F.array().cast(nodes.schema["provenance"].dataType))
    gone = F.coalesce("o.gone", F.lit(False))
    stays = was & ~gone
    foreign = stays & (F.size(kinds(left)) > 0) & (F.size(kinds(F.col("c.provenance"))) > 0) & ~F.arrays_overlap(kinds(left), kinds(F.col("c.provenance")))
    same = _core("o") == _core("c")
    change = F.when(~now, F.when(gone, "removed")).when(F.col("based"), "skipped").when(~was, "added").when(~gone & foreign, "skipped").when(same, "unchanged").otherwise("updated")
    reason = F.when(now & F.col("based"), "base id").when(now & foreign, "source kinds")
    judged = stored(met.select("id", "o", "c", F.coalesce("based", F.lit(False)).alias("based"), left.alias("left"), stays.alias("stays"), change.alias("change"), reason.alias("reason")), "nodes")
    taken = F.col("c.id").isNotNull() & (F.coalesce("change", F.lit("")) != "skipped")
    provenance = F.when(taken & F.col("stays"), merged_provenance(F.concat("left", F.coalesce("c.provenance", F.array().cast(nodes.schema["provenance"].dataType))))).when(taken, F.col("c.provenance")).otherwise(F.col("left"))
    after = judged.filter(taken | F.col("stays")).select("id", *[provenance.alias(c) if c == "provenance" else F.when(taken, F.col(f"c.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in nodes.columns if c != "id"])
    known = base.select("id").union(after.select("id")).distinct()
    refused = judged.filter("reason = 'source kinds'").select("id")

    pack = lambda df, name: df.select(*KEY, F.struct(*df.columns).alias(name))
    end = lambda side, df, name: df.select(F.col("id").alias(side), F.lit(True).alias(name))
    ends = pack(_stripped(edges, scope), "o").join(pack(valid_edges(new_edges).select(edges.columns), "c"), KEY, "full")
    ends = ends.join(end("source", known, "ks"), "source", "left").join(end("target", known, "kt"), "target", "left").join(end("source", refused, "rs"), "source", "left").join(end("target", refused, "rt"), "target", "left")
    none = F.array().cast(edges.schema["provenance"].dataType)
    was, now, gone = F.col("o.source").isNotNull(), F.col("c.source").isNotNull(), F.coalesce("o.gone", F.lit(False))
    whole = F.coalesce(F.col("ks") & F.col("kt"), F.lit(False))
    fine = now & (F.col("source") != F.col("target")) & whole & F.col("rs").isNull() & F.col("rt").isNull() & (F.size(F.coalesce("c.provenance", none)) > 0)
    before = F.when(gone, F.coalesce("o.provenance", none)).otherwise(F.coalesce("o.left", none))
    united = merged_provenance(F.concat(before, F.coalesce("c.provenance", none)))
    kept = was & ~gone
    change = F.when(fine & ~was, "added").when(fine & (F.size(united) == F.size(before)), "unchanged").when(fine, "updated")
    judged_edges = stored(ends.select(*KEY, "o", "c", fine.alias("fine"), (now & ~fine).alias("skipped"), (kept & whole).alias("kept"), (was & ~fine & (gone | ~whole)).alias("removed"), change.alias("change"), F.when(gone, F.col("c.provenance")).otherwise(united).alias("united"), F.coalesce("o.left", none).alias("left")), "edges")
    rest = [c for c in edges.columns if c not in KEY]
    after_edges = judged_edges.filter("fine or kept").select(*KEY, *[(F.when(F.col("fine"), F.col("united")).otherwise(F.col("left")) if c == "provenance" else F.when(F.col("fine"), F.col(f"c.{c}")).otherwise(F.col(f"o.{c}"))).alias(c) for c in rest])

    text = F.lit(None).cast("string")
    changed = judged_edges.select(*KEY, F.explode(F.filter(F.array(F.when(F.col("skipped"), "skipped"), F.when(F.col("removed"), "removed"), F.col("change")), lambda x: x.isNotNull())).alias("change"))
    delta = judged.filter("change is not null").select(F.lit("node").alias("what"), "id", text.alias("source"), text.alias("relation"), text.alias("target"), "change", "reason")
    delta = delta.union(changed.select(F.lit("edge").alias("what"), text.alias("id"), *KEY, "change", text.alias("reason")))
    return Import(after, after_edges, delta)


def without_scope(rows: DataFrame, scope: str) -> DataFrame:
    """rows without the provenance of a scope; those left without any are removed."""
    mine = lambda p: F.coalesce(p["importScopeId"] == scope, F.lit(False)) | F.coalesce(p["sourceId"] == scope, F.lit(False))
    left = rows.withColumn("provenance", F.filter("provenance", lambda p: ~mine(p)))
    return left.filter(F.size("provenance") > 0)


def removed(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without nodes of ids (id) and the edges that touch them."""
    left = nodes.join(ids.select("id"), "id", "left_anti")
    _, between = induced(left, edges, left.select("id"))
    return left, between


def new_edges(have: DataFrame, more: DataFrame, order: str) -> DataFrame:
    """Edges of more whose key is new; the first of equal ones."""
    first = more.groupBy(*KEY).agg(F.min_by(F.struct(*[c for c in more.columns if c not in KEY]), order).alias("r")).select(*KEY, "r.*")
    return first.join(have.select(*KEY), KEY, "left_anti")


def newest_snapshot(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per key the row of a or b with the larger updated_at; a's where they are equal."""
    both = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(0)))
    return both.groupBy("key").agg(F.max_by(F.struct(*[c for c in a.columns if c != "key"]), F.struct("updated_at", "side")).alias("r")).select("key", "r.*")
