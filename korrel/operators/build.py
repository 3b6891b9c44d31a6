"""Graph construction: mentions, topic and similarity pairs with degree caps, chunks, links."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from korrel.functions import text as t
from korrel.operators.retrieval import top
from korrel.plans.components import components
from korrel.plans.scratch import stored
from korrel.plans.spread import spread

#: Limits of topic and similarity edges.
TOPIC_OVERLAP, TOPIC_SHARED, TOPIC_DEGREE = 0.22, 2, 2
COSINE, SHARED, PER_SOURCE, PER_TARGET = 0.26, 3, 2, 4
CHUNK, CUT_FROM = 1100, 0.55
#: Words of a name by which it is looked up, and first words of names that are broadcast.
ANCHOR, HEADS = 3, 20_000


def named_nodes(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(source, target, shared, start): nodes (id, title) whose names stand in docs (id, text) as whole words.

    The runs of up to ANCHOR words at each place of a document are joined to the names that begin with them, and the
    places found are then compared with whole names, of any number of words; no text is searched for every name. Where
    names have few first words, runs are only made at these. Names of fewer than three letters or digits link nothing.
    shared: several nodes own the name. start is the first word of the first mention, counted from 0.
    """
    words = lambda c: F.array_remove(F.split(t.normalize(F.col(c)), t.NOT_ALNUM), "")
    keys = names.select(F.col("id").alias("target"), F.array_join(words("title"), " ").alias("key")).filter("length(replace(key, ' ', '')) >= 3").distinct()
    owners = keys.groupBy("key").agg((F.count("*") > 1).alias("shared"))
    n = F.size(F.split("key", " "))
    anchored = stored(keys.join(owners, "key").select("key", "target", "shared", n.alias("n"), F.substring_index("key", " ", ANCHOR).alias("anchor")), "names")
    texts = stored(spread(docs.select("id", "text"), "id").select(F.col("id").alias("source"), words("text").alias("words")).filter("size(words) > 0"), "words")
    # Runs that reach over the end are none, so each is there once and none is shuffled to be compared with others.
    n = F.size("words")
    places = texts.select("source", F.inline(F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("start"), *[F.slice("words", F.lit(k + 1), n).alias(f"w{k}") for k in range(ANCHOR)])))
    heads = stored(anchored.select(F.substring_index("anchor", " ", 1).alias("w0")).distinct(), "heads")
    if heads.count() <= HEADS:
        places = places.join(F.broadcast(heads), "w0", "left_semi")
    run = lambda k: F.when(F.col(f"w{k}").isNotNull(), F.concat_ws(" ", *[f"w{i}" for i in range(k + 1)]))
    runs = places.select("source", "start", F.explode(F.array(*[run(k) for k in range(ANCHOR)])).alias("anchor")).filter("anchor is not null")
    met = stored(runs.join(anchored, "anchor").filter("source <> target"), "places")
    hits = met.join(texts, "source").filter(F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ") == F.col("key"))
    return hits.groupBy("source", "target", "shared").agg(F.min("start").alias("start"))


def mention_edges(docs: DataFrame, names: DataFrame, shared: bool = False) -> DataFrame:
    """(source, target, start) of named_nodes by names that one node owns; with shared, by those that several own."""
    found = named_nodes(docs, names)
    return found.filter("shared" if shared else "not shared").select("source", "target", "start")


def profile_classes(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles (id, term, weight) of one member of each class of equal ones, and (id, class): copies are compared once."""
    marks = profiles.groupBy("id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("term", "weight")))), 256).alias("mark"))
    marks = stored(marks, "marks")
    classes = stored(marks.join(marks.groupBy("mark").agg(F.min("id").alias("class")), "mark").select("id", "class"), "classes")
    return profiles.join(classes.filter("id = class").select("id"), "id", "left_semi"), classes


#: Profiles of a term that one tile holds on either side, and what a bound may be off by: scores are rounded to six digits.
TILE, SLACK = 1024, 1e-6


def _held(profiles: DataFrame, shared: int) -> DataFrame:
    """Profiles of at least `shared` terms as one row each (id, w, left, total, norm), stored.

    w maps the numbers of its terms to their weights, rarest first, in an order that all profiles share. left has, for
    each of its terms that pairs can meet under (all but the shared - 1 most frequent): its number, into how many tiles
    its list of profiles is cut, and the sums of weights and of their squares from it on.
    """
    df = profiles.groupBy("term").agg(F.count("*").alias("df"))
    numbers = stored(df.withColumn("nr", F.monotonically_increasing_id()), "terms")  # stored, so a number stays
    rest = Window.partitionBy("id").orderBy(F.desc("df"), F.desc("nr"))
    placed = profiles.join(numbers, "term").withColumn("sum", F.sum("weight").over(rest)).withColumn("squares", F.sum(F.col("weight") ** 2).over(rest))
    terms = F.array_sort(F.collect_list(F.struct("df", "nr", "weight", F.ceil(F.col("df") / TILE).alias("tiles"), "sum", "squares")))
    held = placed.groupBy("id").agg(terms.alias("terms"), F.sum("weight").alias("total"), F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm")).filter(F.size("terms") >= shared)
    return stored(held.select("id", F.map_from_arrays("terms.nr", "terms.weight").alias("w"), F.slice("terms", F.lit(1), F.size("terms") - (shared - 1)).alias("left"), "total", "norm"), "profiles")


def _met(a: DataFrame, b: DataFrame, shared: int, reach: Column, once: bool) -> DataFrame:
    """Pairs of profiles (_held) that share `shared` terms: (a, b, common, and wa, ta, na, wb, tb, nb), each once.

    A pair meets where the rarest of its common terms is, and is judged there: no candidate is shuffled. Long lists of
    a term are cut into tiles, which meet each other. reach is a bound in the columns sa, qa, ta, na and sb, qb, tb, nb
    (sums and squares from the term on, total and length) that a pair must pass first. With once, a < b.
    """

    def at(held: DataFrame, x: str, own: str, every: str) -> DataFrame:
        rows = held.select(F.col("id").alias(x), F.col("w").alias(f"w{x}"), F.col("total").alias(f"t{x}"), F.col("norm").alias(f"n{x}"), F.explode("left").alias("l"))
        rows = rows.select("*", F.col("l.nr").alias("nr"), F.col("l.sum").alias(f"s{x}"), F.col("l.squares").alias(f"q{x}"), F.pmod(F.xxhash64(x), F.col("l.tiles")).alias(own))
        return rows.withColumn(every, F.explode(F.sequence(F.lit(0).cast("long"), F.col("l.tiles") - 1))).drop("l")

    met = at(a, "a", "x", "y").join(at(b, "b", "y", "x"), ["nr", "x", "y"])
    common = F.array_intersect(F.map_keys("wa"), F.map_keys("wb"))
    met = met.filter((F.col("a") < F.col("b") if once else F.col("a") != F.col("b")) & reach & (F.size(common) >= shared) & (F.get(common, F.lit(0)) == F.col("nr")))
    return met.select("a", "b", common.alias("common"), "wa", "ta", "na", "wb", "tb", "nb")


def _scored(met: DataFrame, name: str, value, by: Column, least: float) -> DataFrame:
    """(a, b, score, shared) of met pairs (_met): the sum of value(weight, weight) over the common terms, divided by `by`; from `least` on.

    The score is a generated row: as a filter it would be planned into the join, and would take that out of generated code.
    """
    total = F.aggregate("common", F.lit(0.0), lambda s, k: s + value(F.try_element_at("wa", k), F.try_element_at("wb", k)))
    row = F.struct(F.round(total / by, 6).alias(name), F.size("common").cast("long").alias("shared"))
    return met.select("a", "b", F.inline(F.filter(F.array(row), lambda x: x[name] >= least)))


def topic_pairs(profiles: DataFrame) -> DataFrame:
    """(a, b, overlap, shared), a < b, of profiles (id, term, weight) that share enough of their top terms.

    Give one member of each class of equal profiles (profile_classes): the lists of frequent terms are then short. What
    two profiles share from a term on is at most the lesser of what either has from there on.
    """
    held = _held(profiles, TOPIC_SHARED)
    reach = F.least("sa", "sb") >= (TOPIC_OVERLAP - SLACK) * F.least("ta", "tb")
    return _scored(_met(held, held, TOPIC_SHARED, reach, True), "overlap", F.least, F.least("ta", "tb"), TOPIC_OVERLAP)


def _greedy(order: list[str], per_a: int, per_b: int, symmetric: bool):
    """Takes the pairs of one group best first while both ends have room; used_a and used_b are gone from it already."""

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.sort_values(order, ascending=[False, False, True, True], kind="stable")
        side = "a" if symmetric else "b"
        used = {("a", x): n for x, n in zip(pairs["a"], pairs["used_a"])} | {(side, x): n for x, n in zip(pairs["b"], pairs["used_b"])}
        keep = []
        for x, y in zip(pairs["a"], pairs["b"]):
            p, q = ("a", x), (side, y)
            keep.append(used[p] < per_a and used[q] < per_b)
            if keep[-1]:
                used[p] += 1
                used[q] += 1
        return pairs[keep]

    return run


def settled(pairs: DataFrame, group: str, score: str, per_a: int, per_b: int, symmetric: bool) -> DataFrame:
    """capped within each group of a column of pairs; for groups of bounded size, whose ends are in no other group."""
    free = pairs if "used_a" in pairs.columns else pairs.withColumns({"used_a": F.lit(0), "used_b": F.lit(0)})
    return free.groupBy(group).applyInPandas(_greedy([score, "shared", "a", "b"], per_a, per_b, symmetric), free.schema).select(*[c for c in pairs.columns if c not in ("used_a", "used_b")])


#: Pairs that one task settles at once, cuts of the order, rounds before the rest of a larger block is looked at by
#: component, and pairs of a component that one task settles.
BLOCK, CUTS, ROUNDS, SETTLED = 500_000, 1000, 3, 20_000


def capped(pairs: DataFrame, score: str, per_a: int, per_b: int, symmetric: bool) -> DataFrame:
    """pairs (a, b, score, shared) accepted greedily, best first, while both ends have room.

    The order is score, shared (falling), a, b. Pairs are taken in blocks of falling scores: of a block, those with a
    full end are left out, and the rest, about BLOCK, is settled in one task. The more ends are full, the longer blocks
    become. Blocks that stay larger, as most of their scores are equal, are settled in rounds (_rounds). With symmetric,
    an id's pairs on both sides share one count.
    """
    spark, kind = pairs.sparkSession, pairs.schema
    left = stored(pairs, "pairs")
    n = left.count()
    parts = max(1, min(CUTS, -(-n // BLOCK) * 10))
    cuts = left.agg(F.percentile_approx(score, [k / parts for k in range(parts)], 10 * CUTS)).first()[0] if n > BLOCK else None
    cuts = sorted(set(cuts)) if cuts else [None]
    tag = lambda side: F.lit("x" if symmetric or side == "a" else "y")
    room = taken = None
    high, share = None, 1.0
    while cuts:
        own = max(1, int(BLOCK * parts / max(1, n) / share))
        low, cuts = cuts[-min(own, len(cuts))], cuts[: -min(own, len(cuts))]
        block = left if high is None else left.filter(F.col(score) < high)
        block = block.filter(F.col(score) >= low) if cuts else block
        if room is None:
            block = block.withColumns({"used_a": F.lit(0).cast("long"), "used_b": F.lit(0).cast("long")})
        else:
            used = lambda side: room.filter(F.col("side") == tag(side)).select(F.col("id").alias(side), F.col("used").alias(f"used_{side}"))
            block = block.join(used("a"), "a", "left").join(used("b"), "b", "left").na.fill(0, ["used_a", "used_b"]).filter((F.col("used_a") < per_a) & (F.col("used_b") < per_b))
        block = stored(block.select(*kind.names, "used_a", "used_b"), "blocks")
        m = block.count()
        if m <= 2 * BLOCK:
            new = stored(settled(block.withColumn("block", F.lit(0)), "block", score, per_a, per_b, symmetric).select(*kind.names), "taken")
        else:
            new = _rounds(block, score, per_a, per_b, symmetric)
        taken = new if taken is None else taken.union(new)
        if cuts:
            ends = new.select(F.explode(F.array(F.struct(tag("a").alias("side"), F.col("a").alias("id")), F.struct(tag("b").alias("side"), F.col("b").alias("id")))).alias("e")).select("e.*").groupBy("side", "id").agg(F.count("*").alias("used"))
            room = stored(ends if room is None else room.union(ends).groupBy("side", "id").agg(F.sum("used").alias("used")), "room")
        high, share = low, max(m / max(1, own * n / parts), 1 / parts)
    return taken if taken is not None else spark.createDataFrame([], kind)


def _rounds(block: DataFrame, score: str, per_a: int, per_b: int, symmetric: bool) -> DataFrame:
    """What capped takes of a block (pairs with used_a and used_b, what is gone of their ends' room).

    A pair that is among the best of what is left at both of its ends, as many as they have room for, is one that the
    greedy choice takes; so each round takes all such pairs at once, and drops the pairs of full ends. Chains of equal
    or falling scores give one pair a round, so after some rounds the components of what is left are settled apart,
    each of up to SETTLED pairs in one step; larger ones go on in rounds.
    """
    pairs = block.drop("used_a", "used_b")
    spark, kind = pairs.sparkSession, pairs.schema
    order = F.struct((-F.col(score)).alias("s"), (-F.col("shared")).alias("n"), F.col("a").alias("x"), F.col("b").alias("y"))
    left = stored(pairs.withColumn("o", order), "pairs")
    tag = lambda side: F.lit("x" if symmetric or side == "a" else "y")
    before = lambda side: block.select(tag(side).alias("side"), F.col(side).alias("id"), F.col(f"used_{side}").alias("used"))
    room = stored(before("a").union(before("b")).filter("used > 0").distinct(), "room")
    taken = spark.createDataFrame([], kind)
    rounds = 0
    while not left.isEmpty():
        if rounds and rounds % ROUNDS == 0:
            node = lambda side: F.concat(tag(side), F.col(side).cast("string"))
            part = components(left.select(node("a").alias("p"), node("b").alias("q")), "p", "q")
            placed = stored(left.withColumn("node", node("a")).join(part, "node").drop("node"), "components")
            small = placed.groupBy("component").count().filter(F.col("count") <= SETTLED).select("component")
            gone = lambda side: room.filter(F.col("side") == tag(side)).select(F.col("id").alias(side), F.col("used").cast("long").alias(f"used_{side}"))
            inside = placed.join(small, "component", "left_semi").join(gone("a"), "a", "left").join(gone("b"), "b", "left").na.fill(0, ["used_a", "used_b"])
            taken = taken.union(stored(settled(inside.drop("o"), "component", score, per_a, per_b, symmetric), "taken").select(*kind.names))
            left = stored(placed.join(small, "component", "left_anti").select(left.columns), "pairs")
            rounds += 1
            continue
        ends = left.select("a", "b", "o", F.explode(F.array(F.struct(tag("a").alias("side"), F.col("a").alias("id"), F.lit(per_a).alias("most")), F.struct(tag("b").alias("side"), F.col("b").alias("id"), F.lit(per_b).alias("most")))).alias("e")).select("a", "b", "o", "e.*")
        ends = ends.join(room, ["side", "id"], "left").withColumn("most", F.col("most") - F.coalesce("used", F.lit(0)))
        rank = F.row_number().over(Window.partitionBy("side", "id").orderBy("o"))
        sure = ends.withColumn("rank", rank).filter(F.col("rank") <= F.col("most")).groupBy("a", "b").count().filter("count = 2").select("a", "b")
        new = stored(left.join(sure, ["a", "b"], "left_semi"), "taken")
        taken = taken.union(new.select(*kind.names))
        used = lambda side: new.select(tag(side).alias("side"), F.col(side).alias("id"))
        more = used("a").union(used("b")).groupBy("side", "id").agg(F.count("*").alias("used"))
        room = stored(room.union(more).groupBy("side", "id").agg(F.sum("used").alias("used")), "room")
        full = lambda side, most: room.filter((F.col("side") == tag(side)) & (F.col("used") >= most)).select(F.col("id").alias(side))
        left = stored(left.join(sure, ["a", "b"], "left_anti").join(full("a", per_a), "a", "left_anti").join(full("b", per_b), "b", "left_anti").select(left.columns), "pairs")
        rounds += 1
    return taken


def similarity_pairs(profiles: DataFrame, sources: DataFrame, targets: DataFrame, exclude: DataFrame | None = None, once: bool = False) -> DataFrame:
    """(a, b, cosine, shared): sources (id) against targets (id), without equal ids and the excluded (a, b); with once, a < b.

    What two profiles share from a term on is at most the product of their lengths from there on.
    """
    held = _held(profiles, SHARED)
    of = lambda ids: held.join(ids.select("id"), "id", "left_semi")
    reach = F.sqrt(F.col("qa") * F.col("qb")) >= (COSINE - SLACK) * F.col("na") * F.col("nb")
    scored = _scored(_met(of(sources), of(targets), SHARED, reach, once), "cosine", lambda x, y: x * y, F.col("na") * F.col("nb"), COSINE)
    return scored if exclude is None else scored.join(exclude.select("a", "b"), ["a", "b"], "left_anti")


def best_per_end(pairs: DataFrame, score: str, k: int) -> DataFrame:
    """The k best pairs of each a."""
    return top(pairs, "a", [F.desc(score), F.desc("shared"), F.asc("b")], k)


# Where a chunk may end.
MARKS = re.compile(r"[.!?»] |\n\n|\n| ")


def chunk(text: str, size: int = CHUNK) -> Iterator[tuple[int, int, str]]:
    """(start, end, piece) of a text: at most `size` characters, cut after the last mark that begins past CUT_FROM of it.

    The places after the first signs of all marks are found in one scan; each cut is a binary search among them.
    """
    ends = [m.start() + 1 for m in MARKS.finditer(text)]
    inside = re.compile(r"\S")
    at = inside.search(text)
    while at:
        begin = at.start()
        stop = min(len(text), begin + size)
        if stop < len(text):
            k = bisect_right(ends, stop + 1) - 1  # a mark may begin at the limit itself
            if k >= 0 and ends[k] > begin + int(size * CUT_FROM):
                stop = ends[k]
        piece = text[begin:stop].rstrip()
        yield begin, begin + len(piece), piece
        at = inside.search(text, stop)


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(id, pos, start, end, text) of docs (id, text): one narrow pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, *c) for i, text in zip(batch["id"], batch["text"]) for k, c in enumerate(chunk(text or "", size))]
            yield pd.DataFrame(rows, columns=["id", "pos", "start", "end", "text"])

    return spread(docs.select("id", "text"), "id").mapInPandas(run, f"id {docs.schema['id'].dataType.simpleString()}, pos int, start int, end int, text string")


def page_titles(pages: DataFrame) -> DataFrame:
    """(page_id, url, title) of raw pages."""
    return pages.select("page_id", "url", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, label): the links of raw pages in order; the first of equal labels."""
    hrefs = F.regexp_extract_all("html", F.lit(r'(?i)<a\s+href="([^"]*)"[^>]*>'), F.lit(1))
    labels = F.regexp_extract_all("html", F.lit(r'(?is)<a\s+href="[^"]*"[^>]*>(.*?)</a>'), F.lit(1))
    each = pages.select("page_id", F.posexplode(F.arrays_zip(hrefs.alias("href"), labels.alias("label"))).alias("pos", "l"))
    rows = each.select("page_id", "pos", F.col("l.href").alias("href"), F.col("l.label").alias("label")).filter("label <> ''")
    return rows.groupBy("page_id", t.normalize(F.col("label")).alias("key")).agg(F.min(F.struct("pos", "href", "label")).alias("r")).select("page_id", "r.pos", "r.href", "r.label")


def verified_links(links: DataFrame, titles: DataFrame, most: int = 48) -> DataFrame:
    """(source, target, rank): pages linked by a label that is another page's title, at most `most` from each."""
    key = lambda c: t.compact(t.normalize(F.col(c)))
    owners = titles.groupBy(key("title").alias("key")).agg(F.min("page_id").alias("target"), F.count("*").alias("n")).filter("n = 1 and key <> ''")
    found = links.select(F.col("page_id").alias("source"), "pos", key("label").alias("key")).join(owners, "key").filter("source <> target").groupBy("source", "target").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("pos", "target"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).select("source", "target", "rank")


def triples(docs: DataFrame) -> DataFrame:
    """(id, pos, subject, relation, object): lines "subject | relation | object" of docs (id, text), the first eight."""
    line = F.regexp_replace(F.col("line"), r"^\s*(?:[-*•]|[0-9]+[.)])\s*", "")
    rows = docs.select("id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("id", "at", F.transform(F.split(line, r"\|"), lambda x: F.trim(x)).alias("p"))
    good = rows.filter((F.size("p") == 3) & F.forall("p", lambda x: x != "") & (F.length(F.col("p")[1]) < 60))
    return good.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("at"))).filter("pos <= 8").select("id", "pos", F.col("p")[0].alias("subject"), F.col("p")[1].alias("relation"), F.col("p")[2].alias("object"))
