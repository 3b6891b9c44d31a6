"""Bounded pulls of pages around chosen roots: neighbours by rank, pages resolved to known nodes, relations up to a budget."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.functions import text as t
from korrel.plans.scratch import stored

#: Roots of a pull, neighbours of a root, links of a page that are looked at, relations of a pull, letters of a usable extract, of a title.
ROOTS, NEIGHBOURS, LINKS, RELATIONS, EXTRACT, TITLE = 3, 2, 500, 48, 80, 120
# Titles that are no articles.
NO_ARTICLE = r"(?i)^(liste|portal|kategorie)\b|^[0-9]{1,4}$"


def name_key(name: Column) -> Column:
    """What equal names have in common."""
    return t.compact(t.normalize(name))


def neighbour_score(label: Column, extract: Column) -> Column:
    """How well a link's label fits the extract: 100 and its length if it stands there, else its terms that do; -1 for none."""
    folded = t.normalize(label)
    own = F.array_distinct(t.terms(label))
    common = F.size(F.array_intersect(own, t.terms(extract)))
    by_terms = F.when(F.size(own) == 0, -1).when(common == F.size(own), 20 + common).when(common > 0, common).otherwise(-1)
    return F.when(label.rlike(NO_ARTICLE), -1).when(F.contains(t.normalize(extract), folded), 100 + F.length(folded)).otherwise(by_terms)


def first_links(links: DataFrame, most: int = LINKS) -> DataFrame:
    """(page_id, pos, label, key): the first links of each page, one per name."""
    named = links.select("page_id", "pos", t.compact(F.col("label")).alias("label")).filter("label <> ''").withColumn("key", name_key(F.col("label")))
    once = named.groupBy("page_id", "key").agg(F.min(F.struct("pos", "label")).alias("l")).select("page_id", "l.*", "key")
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos", "key"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def continued(responses: DataFrame, most: int = LINKS) -> DataFrame:
    """(title, pos, label): links of stored answers (title, token, labels, next), which each title's first one (null token) leads to.

    An answer's next token names the one that goes on; they are followed by joins, all titles at once, until none is left
    or a title has `most` labels. An answer that leads back to an earlier one ends its title there.
    """
    answers = stored(responses.select("title", "token", "labels", "next").dropDuplicates(["title", "token"]), "answers")
    at = stored(answers.filter("token is null").select("title", "labels", "next", F.lit(0).alias("before"), F.array().cast("array<string>").alias("seen")), "answers-at")
    found = at.select("title", F.posexplode("labels").alias("k", "label"), "before").select("title", (F.col("before") + F.col("k")).alias("pos"), "label")
    while True:
        more = at.filter("next is not null").withColumn("total", F.col("before") + F.size("labels")).filter(F.col("total") < most)
        step = more.filter(~F.array_contains("seen", F.col("next"))).select("title", F.col("next").alias("token"), F.col("total").alias("before"), F.array_append("seen", F.col("next")).alias("seen"))
        at = stored(step.join(answers, ["title", "token"]).select("title", "labels", "next", "before", "seen"), "answers-at")
        if at.isEmpty():
            return found.filter(F.col("pos") < most)
        found = found.union(at.select("title", F.posexplode("labels").alias("k", "label"), "before").select("title", (F.col("before") + F.col("k")).alias("pos"), "label"))


@dataclass
class Pull:
    """Pulls of roots (pull, ord, page_id) from pages, links and redirects, against a graph's nodes.

    pages: (page_id, title, extract, disambiguation), ids unique; redirects: (name, page_id), other names of pages;
    links: (page_id, pos, label); nodes: (id, title, custom, page_id), with page_id where a node came from a page and custom for
    personal ones. A page is usable if it is no disambiguation and has EXTRACT letters. All pulls run together; each
    has at most ROOTS times (1 + NEIGHBOURS) pages of LINKS links, so no group is larger than that. Pages, nodes and
    links with null keys take no part. An empty table gives empty parts.
    """

    pages: DataFrame
    redirects: DataFrame
    links: DataFrame
    nodes: DataFrame
    roots: DataFrame
    relations: int = RELATIONS

    @cached_property
    def _usable(self) -> DataFrame:
        fine = ~F.coalesce("disambiguation", F.lit(False)) & (F.length(F.coalesce("extract", F.lit(""))) >= EXTRACT)
        return stored(self.pages.filter(fine & F.col("page_id").isNotNull()).select("page_id", "title", "extract"), "usable")

    @cached_property
    def _links(self) -> DataFrame:
        return stored(first_links(self.links), "links")

    @cached_property
    def _page_names(self) -> DataFrame:
        """(key, page_id): a title leads to its page, another name only where no page is called so; shared ones lead nowhere."""
        titles = self.pages.select(F.lit(0).alias("kind"), name_key(F.substring(t.compact(F.col("title")), 1, TITLE)).alias("key"), "page_id")
        every = titles.union(self.redirects.select(F.lit(1), name_key(F.col("name")), "page_id")).filter("key <> '' and page_id is not null")
        best = every.groupBy("key", "kind").agg(F.min("page_id").alias("page_id"), F.max("page_id").alias("other")).groupBy("key").agg(F.min(F.struct("kind", "page_id", "other")).alias("b"))
        return best.filter("b.page_id = b.other").select("key", "b.page_id")

    @cached_property
    def _chosen(self) -> DataFrame:
        """(pull, ord, page_id) of the roots that count."""
        rank = F.row_number().over(Window.partitionBy("pull").orderBy("ord", "page_id"))
        first = self.roots.dropDuplicates(["pull", "page_id"]).withColumn("rank", rank)
        return stored(first.select("pull", F.col("rank").alias("ord"), "page_id"), "roots")

    @cached_property
    def _neighbours(self) -> DataFrame:
        """(pull, ord, rank, label, page_id): the best links of each root, and the usable page they lead to, if any."""
        root = self._chosen.filter(F.col("ord") <= ROOTS).join(self._usable, "page_id").select("pull", "ord", "page_id", "extract")
        scored = root.join(self._links.select("page_id", "label", "key"), "page_id").withColumn("score", neighbour_score(F.col("label"), F.col("extract"))).filter("score > 0").select("pull", "ord", "label", "key", "score")
        rank = F.row_number().over(Window.partitionBy("pull", "ord").orderBy(F.desc("score"), "key"))
        best = scored.withColumn("rank", rank).filter(F.col("rank") <= NEIGHBOURS)
        led = best.join(self._page_names, "key", "left").join(self._usable.select("page_id", F.lit(True).alias("fine")), "page_id", "left")
        return stored(led.select("pull", "ord", "rank", "label", F.when(F.col("fine"), F.col("page_id")).alias("page_id")), "neighbours")

    @cached_property
    def members(self) -> DataFrame:
        """(pull, place, page_id, title, requested, id): a pull's pages in order, each with the node that it is or becomes.

        A page is the node that came from it, else the only one of its title, else of the name it was asked for by; else
        it becomes wiki_ and its id.
        """
        roots = self._chosen.filter(F.col("ord") <= ROOTS).join(self._usable.select("page_id", F.col("title").alias("requested")), "page_id").select("pull", F.col("ord").alias("place"), "page_id", "requested")
        near = self._neighbours.filter("page_id is not null").select("pull", (F.lit(ROOTS) + F.col("ord") * (NEIGHBOURS + 1) + F.col("rank")).alias("place"), "page_id", F.col("label").alias("requested"))
        once = roots.union(near).groupBy("pull", "page_id").agg(F.min(F.struct("place", "requested")).alias("r")).select("pull", "page_id", "r.*").join(self._usable.select("page_id", "title"), "page_id")
        by_page = self.nodes.filter("page_id is not null").groupBy("page_id").agg(F.min("id").alias("known"))
        named = self._node_names
        name = lambda c, to: named.select(F.col("key").alias(c), F.col("node").alias(to))
        found = once.join(by_page, "page_id", "left").withColumns({"k1": name_key(F.col("title")), "k2": name_key(F.col("requested"))}).join(name("k1", "n1"), "k1", "left").join(name("k2", "n2"), "k2", "left")
        return stored(found.select("pull", "place", "page_id", "title", "requested", F.coalesce("known", "n1", "n2", F.concat(F.lit("wiki_"), F.col("page_id").cast("string"))).alias("id")), "members")

    @cached_property
    def _node_names(self) -> DataFrame:
        """(key, node): names of exactly one node among those that are not personal or came from a page."""
        keys = self.nodes.filter(~F.coalesce("custom", F.lit(False)) | F.col("page_id").isNotNull()).select(name_key(F.col("title")).alias("key"), "id").filter("key <> ''")
        return stored(keys.groupBy("key").agg(F.min("id").alias("node"), F.max("id").alias("other")).filter("node = other").select("key", "node"), "node-names")

    @cached_property
    def _found(self) -> DataFrame:
        """(pull, source, target, rank): every relation once, in the order in which it is found."""
        m = self.members
        linked = m.select("pull", F.col("place").alias("from"), "page_id", F.col("id").alias("source")).join(self._links.select("page_id", "key"), "page_id")
        names = F.explode(F.array_distinct(F.array(name_key(F.col("title")), name_key(F.col("requested")))))
        inside = linked.join(m.select("pull", F.col("place").alias("to"), F.col("id").alias("target"), names.alias("key")), ["pull", "key"]).filter("from <> to")
        inside = inside.select("pull", "source", "target", F.struct("from", F.lit(0).alias("phase"), F.lpad(F.col("to").cast("string"), 4, "0").alias("to")).alias("o"))
        bridges = linked.join(self._node_names, "key").select("pull", "source", F.col("node").alias("target"), F.struct("from", F.lit(1).alias("phase"), F.col("node").alias("to")).alias("o"))
        once = inside.union(bridges).filter("source <> target").groupBy("pull", "source", "target").agg(F.min("o").alias("o"))
        return stored(once.withColumn("rank", F.row_number().over(Window.partitionBy("pull").orderBy("o", "source"))).drop("o"), "relations")

    @cached_property
    def edges(self) -> DataFrame:
        """(pull, source, target, rank): relations within the budget, those of earlier pages and to pulled pages first."""
        return self._found.filter(F.col("rank") <= self.relations)

    @cached_property
    def report(self) -> DataFrame:
        """One row per pull: scope, pages, new nodes, relations kept and omitted, failures, and whether a limit took something.

        The scope is that of the set of usable roots, so that the same pull replaces itself.
        """
        usable = self._chosen.filter(F.col("ord") <= ROOTS).join(self._usable.select("page_id", F.lit(True).alias("fine")), "page_id", "left")
        sign = F.array_join(F.array_sort(F.collect_list(F.when(F.col("fine"), F.col("page_id").cast("string")))), "|")
        rows = usable.groupBy("pull").agg(sign.alias("sign"), F.count_if(F.col("fine").isNull()).alias("failed_roots"))
        lost = self._neighbours.groupBy("pull").agg(F.count_if(F.col("page_id").isNull()).alias("failed_neighbours"))
        had = self.members.groupBy("pull").agg(F.count("*").alias("pages"), F.count_if(F.col("id").startswith("wiki_")).alias("new_nodes"))
        kept = self._found.groupBy("pull").agg(F.count_if(F.col("rank") <= self.relations).alias("kept"), F.count_if(F.col("rank") > self.relations).alias("omitted"))
        more = self._chosen.groupBy("pull").agg((F.max("ord") > ROOTS).alias("more"))
        out = rows.join(lost, "pull", "left").join(had, "pull", "left").join(kept, "pull", "left").join(more, "pull").na.fill(0)
        scope = F.when(F.col("sign") != "", F.concat(F.lit("wikipedia-personal:"), t.stable_hash(F.col("sign"))))
        return out.select("pull", scope.alias("scope"), "pages", "new_nodes", F.col("kept").alias("relations"), F.col("omitted").alias("omitted_relations"), (F.col("failed_roots") + F.col("failed_neighbours")).alias("failed_pages"), (F.col("more") | (F.col("omitted") > 0)).alias("truncated"))
